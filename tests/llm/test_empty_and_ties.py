"""Every query on empty tables and without labels, and what each operator does with ties."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphloom.llm import language_id, licences, mixing, quality_rules, secrets_scan, simhash, token_files, toxicity
from glyphloom.llm.common import scratch_path, sole
from glyphloom.llm.op2 import tokenizer_path
from glyphloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
EVERY = QUERIES | {"pipeline": corpus_pipeline.run}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """A folder with empty tables, and one with documents but no labels, languages or ids."""
    empty, bare = str(tmp_path_factory.mktemp("empty")), str(tmp_path_factory.mktemp("bare"))
    spark.createDataFrame([], DOCS).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{empty}/labels.parquet")
    rows = [(None, "some plain words that say next to nothing at all", None, None, None), (None, None, None, None, None), (None, "", None, None, 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{bare}/documents.parquet")
    spark.createDataFrame([(None, None, None)], LABELS).write.parquet(f"{bare}/labels.parquet")
    return empty, bare


@pytest.mark.parametrize("name", sorted(EVERY))
def test_empty_tables(spark, sf, folders, name):
    found, usual = EVERY[name](spark, folders[0]), EVERY[name](spark, sf)
    assert found.dtypes == usual.dtypes and found.collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nothing_but_nulls(spark, folders, name):
    assert QUERIES[name](spark, folders[1]).count() == 3


def test_pipeline_of_nulls(spark, folders):
    assert corpus_pipeline.run(spark, folders[1]).collect() == []  # no language can be told


def test_language_tie(spark):
    rows = [(k, "the same few words in both", lang) for k in range(1, 40) for lang in ("xb", "xa")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ("xa", "xb") and model.predict("the same few words in both")[0] == "xa"


def test_fingerprint_tie():
    """A bit that half of the shingles set is 0."""
    words = "a b c d"
    both = [simhash.fingerprint(x) for x in ("a b c", "b c d")]
    assert simhash.fingerprint(words) == both[0] & both[1]


def test_licence_tie():
    twin = "these ten words are the notice of two licences alike"
    found = licences.LicenceScanner({"one": [twin], "two": [twin]}).scan(f"before {twin} after")
    assert found.labels == ["one", "two"] and found.score == 1 and found.spans[0][1:] == found.spans[1][1:]


def test_landmark_tie(spark):
    """Tokens that tell equally much come in the order of their letters."""
    rows = [(k, "zorg blim quux" if k % 2 else "plain harmless talk") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(400)], LABELS)
    assert toxicity.fit(docs, labels).landmarks == ["blim", "quux", "zorg"]
    assert toxicity.fit(docs, labels, landmarks=2).landmarks[:2] == ["blim", "quux"]


def test_lexicon_tie(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEXICON", 2)
    rows = [(k, "zorg blim quux" if k % 4 == 1 else "plain harmless talk") for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 1)) for k in range(800)], LABELS)
    assert sorted(mixing.fit(docs, labels)["toxic"].words) == ["blim", "quux"]


def test_format_tie():
    """A credential that two formats accept equally is one span."""
    values = [hashlib.sha256(str(k).encode()).hexdigest()[:24].upper() for k in range(300)]
    detector = secrets_scan.fit([(name, "key-" + v) for name in ("one", "two") for v in values])
    assert secrets_scan.grammar_spans("at key-" + values[3] + " end", detector, []) == [(3, 3, 31)]


def test_token_order_tie(spark):
    """Rows of one id stand in the order of their texts' hashes, equal ones side by side."""
    docs = spark.createDataFrame([(1, t) for t in ("b", "a", "c", "a", None)] + [(0, "z")], "doc_id long, text string")
    out = scratch_path(spark, "tokens")
    index = token_files.write(docs, out, tokenizer_path())
    wanted = [r.text for r in docs.sort("doc_id", F.xxhash64("text")).collect()]
    found = [r.ids for r in token_files.read_ids(index, out).sort("start").collect()]
    one = {t: found[wanted.index(t)] for t in wanted}
    assert found == [one[t] for t in wanted] and one[None] == [0] and len({tuple(x) for x in found}) == 5


def test_ledger_threshold_ties(spark):
    """Values at a rule's bound pass: ten words, and repeats that are exactly a fifth."""
    ten = " ".join(f"w{k}" for k in range(10))
    repeats = " ".join([f"x{k}" for k in range(5)] * 2 + [f"y{k}" for k in range(40)])
    rows = quality_rules.apply_policy(quality_rules.ledger(spark.createDataFrame([(1, ten), (2, repeats), (3, ten[:-3])], "doc_id long, text string")), "base")
    assert {r.doc_id: r.kept for r in rows.collect()} == {1: True, 2: True, 3: False}


def test_caches_let_go():
    """A worker that turns to another operator drops what it held, and makes the same of the same text afterwards."""
    text = "einige Wörter, some words"
    wanted = language_id.encode(text)
    assert language_id.memory().rows
    sole("language")
    assert language_id.memory().rows
    sole("secrets")
    assert language_id.memory.cache_info().currsize == 0
    assert (language_id.encode(text) == wanted).all()
