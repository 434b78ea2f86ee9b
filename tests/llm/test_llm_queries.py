"""The queries against brute force over the small tables, and against SQL where there is some."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash

import corpus_pipeline
from glyphloom.llm import language_id, media, mixing, op2, op4, secrets_scan
from glyphloom.llm.common import materialise
from glyphloom.llm.queries import QUERIES, SQL
from tests.compare import same, tables
from tests.llm.test_near_copies import named


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}


def run(spark, sf, name):
    return {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    assert same(QUERIES[name](spark, sf), tables(sf), SQL[name])


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Component of each key by comparing all pairs."""
    codes = sorted(set(prints.values()))
    parent = {c: c for c in codes}

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for k, c in prints.items():
        least[find(c)] = min(least.get(find(c), k), k)
    return {k: least[find(c)] for k, c in prints.items()}


def test_op1(spark, sf, docs):
    found = run(spark, sf, "op1_simhash_near_dedup")
    prints = {k: fingerprint(r.text) for k, r in docs.items()}
    assert {k: int(r.fingerprint, 16) for k, r in found.items()} == prints
    assert {k: r.component_id for k, r in found.items()} == components(prints)


def test_op2(spark, sf, docs):
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(op2.tokenizer_path()), 0
    found = run(spark, sf, "op2_token_files")
    for k in sorted(docs):
        ids = np.array([*t.encode(docs[k].text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (found[k].start, found[k].n_tokens, found[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(found) == len(docs)


def test_op3(spark, sf, docs):
    found = run(spark, sf, "op3_media_columns")
    for k, d in docs.items():
        raw = (d.text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        r = found[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = media.mux(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        n, at = len(payload) // 192, stored.index(payload)
        ranges = ",".join(f"{at + 192 * i}-{at + 192 * i + 192}" for i in range(0, n, media.KEYFRAME_EVERY))
        assert r.feature == f"codec=raw;seconds={n * 192 / 48000:.6f};samples={n};keyframes={-(-n // 16)};ranges={ranges}"


def test_op4(spark, sf, docs):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=op4.model_path())
    found = run(spark, sf, "op4_sentencepiece_codec")
    for k, d in docs.items():
        ids = p.encode(d.text or "")
        assert (found[k].n_tokens, found[k].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        assert found[k].round_trip and found[k].parity


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def test_op5(spark, sf, docs):
    found = run(spark, sf, "op5_licence_scan")
    for k, d in docs.items():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d.text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        hits = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        r = found[k]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert {x for _, x in hits} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_op6(spark, docs, labels):
    """Held-out accuracy, on the larger table."""
    sf = "/root/testdata/sf0.01"
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = run(spark, sf, "op6_toxicity")
    held = [(r, known[k]) for k, r in found.items() if r.held_out and k in known]
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in found.items())
    assert sum(r.predicted == t for r, t in held) >= 0.9 * len(held)
    assert all(r.predicted == (r.score >= 0.5) for r in found.values())


def test_op7(spark, sf, docs):
    found = run(spark, sf, "op7_source_mixing")
    assert set(found) == set(docs)
    assert all(found[k].n_tokens == len((d.text or "").split()) or not (d.text or "").isascii() for k, d in docs.items())
    total = sum(r.n_tokens for r in found.values())
    memberships = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in found.values()])
    assert np.allclose(memberships.sum(axis=1), 1, atol=1e-6)
    n = np.array([r.n_tokens for r in found.values()], dtype=float)
    rates, goal = np.ones(len(n)), total * np.array([mixing.WEIGHTS[d] for d in mixing.DOMAINS])
    have = n @ memberships
    for _ in range(2000):  # the descent over documents instead of cells
        rates = np.maximum(0, rates - memberships @ (((n * rates) @ memberships - goal) / have))
    own = np.array([r.rate for r in found.values()])
    assert (own >= 0).all() and np.abs(((n * own) @ memberships - (n * rates) @ memberships) / total).max() < 2e-3


@pytest.mark.parametrize("weights", [None, {"clean": 0.6, "toxic": 0.1, "poor": 0.25, "poor_toxic": 0.05}])
def test_op7_reaches_targets(spark, weights):
    """On the larger table the expected totals of the exact, unrounded memberships are the targets."""
    sf = "/root/testdata/sf0.01"
    rows = mixing.rated(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), weights).collect()
    total = sum(r.n_tokens for r in rows)
    for d, share in (weights or mixing.WEIGHTS).items():
        assert sum(r.n_tokens * r.rate * r[f"p_{d}"] for r in rows) / total == pytest.approx(share, abs=2e-5)


def test_op7_classifier(spark, sf, docs, labels):
    """The memberships against naive Bayes written out over all labelled documents that aren't held out."""
    found = run(spark, sf, "op7_source_mixing")

    def measures(text):
        text = text or ""
        words, lines = re.findall("[^\x20\x09-\x0d]+", text), [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        values = {
            "symbols": sum(c in "#*$%&|<>" for c in text) / max(1, len(words)), "capitals": len(regex.findall(r"\p{Lu}", text)) / max(1, len(text)),
            "distinct": len(set(words)) / max(1, len(words)), "letters": len(regex.findall(r"\p{L}", text)) / max(1, len(text)),
            "length": len(text) / max(1, len(words)), "words": len(words), "repeats": (len(lines) - len(set(lines))) / max(1, len(lines)),
        }
        return {k: sum(v > b for b in mixing.BINS[k]) for k, v in values.items()}, set(regex.findall(r"\p{L}+", text.lower()))

    known = {k: measures(d.text) for k, d in docs.items()}
    learnt = [k for k in labels if k in docs and zlib.crc32(str(k).encode()) % 5]
    odds = {}
    for c in mixing.TARGETS_OF:
        y = {k: labels[k][c] == 1 for k in learnt}
        n1, n0 = sum(y.values()), len(y) - sum(y.values())
        own = {k: math.log((n1 + 0.5) / (n0 + 0.5)) for k in docs}
        for f, bounds in mixing.BINS.items():
            for k in docs:
                v = known[k][0][f]
                a, b = (sum(known[x][0][f] == v and y[x] == side for x in learnt) for side in (True, False))
                own[k] += math.log((a + 1) / (n1 + len(bounds) + 1)) - math.log((b + 1) / (n0 + len(bounds) + 1))
        chosen = []
        for w in {w for k in learnt for w in known[k][1] if len(w) > 2}:
            n, a = sum(w in known[k][1] for k in learnt), sum(w in known[k][1] and y[k] for k in learnt)
            p1, p0 = (a + 0.5) / (n1 + 1), (n - a + 0.5) / (n0 + 1)
            z = (p1 - p0) / math.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
            rare = (p1 >= 3 * p0 and a >= mixing.LEAST_DOCS) if n1 <= n0 else (p0 >= 3 * p1 and n - a >= mixing.LEAST_DOCS)
            if n >= mixing.LEAST_DOCS and rare and abs(z) >= mixing.LEAST_Z:
                chosen.append((-round(abs(z), 9), w, p1, p0))
        for _, w, p1, p0 in sorted(chosen)[: mixing.LEXICON]:
            for k in docs:
                own[k] += math.log(p1 / p0) if w in known[k][1] else math.log((1 - p1) / (1 - p0))
        odds[c] = {k: max(-mixing.LIMIT, min(mixing.LIMIT, x)) for k, x in own.items()}
    one = lambda x: 1 / (1 + math.exp(-x))
    for k, r in found.items():
        q, t = one(odds["quality"][k]), one(odds["toxic"][k])
        assert [r[f"p_{d}"] for d in mixing.DOMAINS] == pytest.approx([(q if a else 1 - q) * (t if b else 1 - t) for a, b in mixing.DOMAINS.values()], abs=1e-6)


def test_op8(spark, sf, docs):
    found = run(spark, sf, "op8_secret_scan")
    for k, d in docs.items():
        text, spans = d.text or "", []
        for m in re.finditer(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
            spans += [(m.start(), 0, m.end(), "assign")] * (len(m[2]) >= 8)
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        base = ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(spans))
        counts = Counter(s[3] for s in spans)
        r = found[k]
        assert (r.n_assign, r.n_access, r.n_hex) == (counts["assign"], counts["access"], counts["hex"])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_op10(spark, sf):
    sf = "/root/testdata/sf0.01"
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = run(spark, sf, "op10_language_id")
    held = [(r.lang_pred, known[k]) for k, r in found.items() if r.held_out]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)


def test_op10_by_definition(spark, sf, docs):
    """Predictions against profiles that are bound and bundled letter by letter."""
    letters = {}

    def vector(c, place):
        return letters.setdefault((c, place), np.roll(language_id.letter_vector(ord(c)), place).astype(np.int64))

    def profile(text):
        if not text or not any(c.isalpha() for c in text):
            return None
        low = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ")
        grams = Counter(low[i : i + 3] for i in range(len(low) - 2))
        out = sum(n * vector(g[2], 0) * vector(g[1], 1) * vector(g[0], 2) for g, n in grams.items())
        return out / np.linalg.norm(out)

    own = {k: profile(d.text) for k, d in docs.items()}
    sums = {}
    for k, d in docs.items():
        if zlib.crc32(str(k).encode()) % 5 and d.lang is not None and own[k] is not None:
            sums[d.lang] = sums.get(d.lang, 0) + np.round(own[k] * language_id.SCALE)
    names = sorted(sums)
    rows = np.stack([sums[n] / np.linalg.norm(sums[n]) for n in names])
    mean = rows.mean(axis=0)
    rows = (rows - mean) / np.linalg.norm(rows - mean, axis=1, keepdims=True)
    for k, r in run(spark, sf, "op10_language_id").items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
        if own[k] is None:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        cosines = rows @ (own[k] - mean) / np.linalg.norm(own[k] - mean)
        best = int(np.argmax(cosines))
        assert r.score == pytest.approx(max(0, cosines[best]), abs=1e-6) and (r.lang_pred == names[best] or abs(cosines[best] - cosines[names.index(r.lang_pred)]) < 1e-6)


def test_op10_small_memory(monkeypatch):
    """What is dropped from the memory is bound again to the same vectors."""
    text = "".join(chr(0x4E00 + (k * 7919) % 20_000) for k in range(12_000)) + " and some plain words"
    wanted = language_id.encode(text)
    monkeypatch.setattr(language_id, "KEPT_NGRAMS", 5000)
    language_id.memory.cache_clear()
    assert np.array_equal(language_id.encode(text), wanted)
    language_id.memory.cache_clear()


def test_pipeline(spark, sf):
    """Each stage on its predecessor's rows against brute force or the operator's own library, and the whole run."""
    import sentencepiece

    rows, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    stages, made = dict(corpus_pipeline.STAGES), {}
    assert list(stages) == ["language", "near_dedup", "secrets", "mixing", "encode"]
    for name, stage in stages.items():
        rows = materialise(stage(spark, rows, sf), name)
        made[name] = rows.collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    told = {r.doc_id for r in made["language"]}
    assert {d.doc_id for d in docs if not any(c.isalpha() for c in d.text or "")}.isdisjoint(told) and len(told) > 0.97 * len(docs)
    assert {r.doc_id for r in made["near_dedup"]} == named({r.doc_id: r.text for r in made["language"]})
    before = {r.doc_id: r.text for r in made["near_dedup"]}
    assert sorted(before) == sorted(r.doc_id for r in made["secrets"])
    for r in made["secrets"]:
        base = secrets_scan.base_spans(before[r.doc_id] or "")
        spans = base + secrets_scan.grammar_spans(before[r.doc_id] or "", secrets_scan.default_detector(), base)
        assert r.text == (secrets_scan.masked(before[r.doc_id], spans) if spans else before[r.doc_id])
    clean = {r.doc_id: r for r in made["secrets"]}
    rates = {r.doc_id: r.rate for r in mixing.rated(spark.createDataFrame(made["secrets"], docs_schema(spark, sf)), labels).collect()}
    mixed = Counter(r.doc_id for r in made["mixing"])
    assert all(int(rates[k]) <= mixed[k] <= int(rates[k]) + 1 for k in clean) and all(r == clean[r.doc_id] for r in made["mixing"])
    p = sentencepiece.SentencePieceProcessor(model_file=op4.model_path())
    wanted = Counter((r.doc_id, tuple(p.encode(r.text or ""))) for r in made["mixing"])
    assert wanted == Counter((r.doc_id, tuple(r.ids)) for r in made["encode"]) and all(r.n_tokens == len(r.ids) for r in made["encode"])
    assert Counter(map(str, corpus_pipeline.run(spark, sf).collect())) == Counter(map(str, made["encode"]))


def docs_schema(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").schema
