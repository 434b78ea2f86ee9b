"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names for every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphloom.llm import language_id, licences, media, mixing, op4, quality_rules, secrets_scan, sentencepiece_codec, simhash, token_files, toxicity
from glyphloom.llm.common import scratch_path
from glyphloom.llm.op2 import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["_p", "_scan", "_id", "_words", "score", "fp", "component_id", "failed", "n_words", "_language", "_text", "_w", "_n", "q", "t", "rate", "lang_pred", "media"]
LONG = "Einige lange Wörter stehen hier. " * 40_000
TEXTS = ["the cat sat on the mat today", None, "", "   \n\t ", LONG, "le chat est sur la table", "le chat est sur la table", "😀 ́ \x00   ﻿", "x" * 100_000, "der Hund und die Katze"]
LANGS = ["en", None, "en", "de", "de", "fr", "fr", None, "en", "de"]


def table(spark, extra=False):
    rows = [(k, t, lang, "s", len(t) if t is not None else None) for k, (t, lang) in enumerate(zip(TEXTS, LANGS, strict=True))]
    rows += [rows[0], (None, "the cat sat on the mat today", "en", None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.select("*", *(F.lit(7).alias(c) for c in EXTRA)) if extra else docs


def labels(spark):
    return spark.createDataFrame([(0, 1, 1), (0, 1, 0), (1, 0, 0), (4, 1, 0), (5, None, 1), (None, 0, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(params=["extra", "empty"])
def docs(request, spark):
    return empty(spark) if request.param == "empty" else table(spark, request.param == "extra")


def test_simhash(docs):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    if found:
        by = {r.doc_id: r for r in found if r.doc_id is not None}
        assert by[5].component_id == by[6].component_id == 5
        assert by[1].fp == by[2].fp == by[3].fp == 0 and by[2].component_id == 1
        assert [r.component_id for r in found if r.doc_id is None] == [0, 1] or [r.component_id for r in found if r.doc_id is None] == [1, 0]
        ids = [r.doc_id for r in kept.collect()]
        assert len(ids) == len(set(ids)) and {0, 1, 5} <= set(ids) and not {2, 3, 6} & set(ids)


def test_tokens(spark, docs):
    out = scratch_path(spark, "tokens")
    index = token_files.write(docs, out, tokenizer_path())
    found = token_files.read_digests(index, out).sort("start").collect()
    assert len(found) == docs.count()
    assert [r.doc_id for r in found] == sorted((r.doc_id for r in found), key=lambda x: (x is not None, x))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(found, found[1:]))
    if found:
        assert {r.doc_id: r.n_tokens for r in found}[1] == 1


def test_media(docs):
    found = media.inspected(media.stored(docs)).collect()
    assert len(found) == docs.count()
    assert all(r.error is None and r.payload_bytes % 192 == 0 and r.payload_bytes for r in found)


def test_media_errors(spark):
    rows = spark.createDataFrame([(1, None), (2, b""), (3, b"\0\0\0\x08free"), (4, b"junk"), (5, bytes(range(256)))], "doc_id long, media binary")
    assert all(r.error for r in media.inspected(rows).collect())


def test_codec(docs):
    path = op4.model_path()
    found = docs.select("text", sentencepiece_codec.encoded(F.col("text"), path).alias("ids")).withColumn("back", sentencepiece_codec.decoded(F.col("ids"), path)).collect()
    assert len(found) == docs.count()
    assert all(r.back == (r.text or "") for r in found)


def test_licences(docs):
    found = docs.select("doc_id", licences.scanned(F.col("text")).alias("s")).collect()
    assert len(found) == docs.count() and all(r.s.labels == "" and r.s.score == 0 for r in found)


def test_toxicity(spark, docs):
    model = toxicity.fit(docs, labels(spark))
    assert docs.select(toxicity.scored(F.col("text"), model).alias("x")).where("x between 0 and 1").count() == docs.count()
    none = toxicity.fit(docs, labels(spark).limit(0))
    assert docs.select(toxicity.scored(F.col("text"), none).alias("x")).where("x = 0").count() == docs.count()


def test_mixing(spark, docs):
    for known in (labels(spark), labels(spark).limit(0)):
        assert mixing.rated(docs, known).count() == docs.count()
        assert mixing.mixed(docs, known).columns == docs.columns
        mixing.mixed(docs, known).collect()


def test_secrets(docs):
    made = secrets_scan.redact(docs)
    assert made.columns == docs.columns and made.dtypes == docs.dtypes
    assert sorted(map(str, made.collect())) == sorted(map(str, docs.collect()))


def test_quality(docs):
    rows = quality_rules.apply_policy(quality_rules.ledger(docs))
    assert rows.count() == docs.count()
    assert rows.where("n_words = 0 and kept").isEmpty()
    assert quality_rules.ablation(rows).count() == (len(quality_rules.POLICIES["v1"]) if docs.count() else 0)


def test_language(docs):
    model = language_id.fit(docs)
    found = language_id.identify(docs, model).collect()
    assert len(found) == docs.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in found if r.text is None or not any(c.isalpha() for c in r.text))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, sf, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    made = stage(spark, docs, sf)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert made.columns == docs.columns
    made.collect()
