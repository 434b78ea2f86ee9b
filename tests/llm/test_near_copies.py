import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from glyphloom.llm import near_copies


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def named(rows):
    """Brute force: the smallest id of every component of pairs with Jaccard similarity 0.8 or more."""
    sets, post, top = {k: shingles(t) for k, t in rows.items()}, defaultdict(list), {k: k for k in rows}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for k in sorted(rows):
        common = Counter(o for s in sets[k] for o in post[s])
        for o, n in common.items():
            if 5 * n >= 4 * (len(sets[k]) + len(sets[o]) - n):
                a, b = sorted((find(k), find(o)))
                top[b] = a
        for s in sets[k]:
            post[s].append(k)
    blank = [k for k in sorted(rows) if not sets[k]]
    return {k for k in rows if find(k) == k} - set(blank[1:])


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_near_dedup_equals_jaccard(spark, size):
    rows = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, rows, "").select("doc_id").collect()]
    assert len(kept) == len(set(kept)) and set(kept) == named({r.doc_id: r.text for r in rows.select("doc_id", "text").collect()})


def edited(rnd, words, n):
    out = list(words)
    for k in rnd.sample(range(len(out)), n):
        out[k] = f"x{rnd.random()}"
    return out


@pytest.mark.parametrize("most", [2048, 4])
def test_large_group_and_common_line(spark, monkeypatch, most):
    monkeypatch.setattr(near_copies, "SHARD_MOST", most)
    rnd = random.Random(3)
    base, line = [f"w{k}" for k in range(120)], [f"c{k}" for k in range(12)]
    texts = [" ".join(edited(rnd, base, rnd.randrange(4))) for _ in range(150)]
    texts += [" ".join([*line, *(f"u{rnd.random()}" for _ in range(6))]) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == named(dict(enumerate(texts)))


@pytest.mark.parametrize("seed", range(4))
def test_tree_links(seed):
    """The trees' links against all pairs, and how far apart fingerprints of similar sets are."""
    rnd = random.Random(seed)
    base = [f"w{k}" for k in range(rnd.choice([8, 40, 300]))]
    sets = [near_copies.shingle_set(" ".join(edited(rnd, base, rnd.randrange(3)))) for _ in range(40)]
    sets += [near_copies.shingle_set(" ".join(f"u{rnd.random()}" for _ in range(30))) for _ in range(20)]
    prints = [near_copies.majority(s.view("uint8").reshape(-1, 8)) for s in sets]
    top = list(range(len(sets)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if near_copies.alike(sets[a], sets[b]):
                assert (prints[a] ^ prints[b]).bit_count() <= near_copies.RADIUS
                top[find(a)] = find(b)
    own = list(range(len(sets)))
    for a, b in near_copies.tree_links(own[:], own[:], prints, sets):
        assert near_copies.alike(sets[a], sets[b]) and find(a) == find(b)
        own = [own[b] if x == own[a] else x for x in own]
    assert len(set(own)) == len({find(k) for k in range(len(sets))})
