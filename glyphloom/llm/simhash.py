"""SimHash near-duplicates with BK-trees.

A document's fingerprint has the bits that are set in over half of the 64-bit hashes of its 3-word shingles. Two
documents are near-duplicates if their fingerprints differ in at most ``radius`` bits; groups are the connected
components of that relation.

Search. Fingerprints are first made distinct, so copies cost nothing. The 64 bits are cut into radius + 2 blocks; of two
fingerprints within the radius at least two blocks are equal, so each pair of blocks and their values names a shard, and
every link lies within a shard. Each shard's distinct fingerprints form a BK-tree (children keyed by their Hamming
distance to the parent); the shard's tree is held by the task that answers the shard's searches, and a search follows
only edges within the radius of its distance to the node. A task emits no pairs: it walks from fingerprint to fingerprint,
takes what it has reached out of the tree, and emits one link from each to the first of its group. A shard with
more than SHARD_MOST fingerprints is cut again: its other bits make radius + 1 blocks, of which at least one is equal in a
link, so each of these blocks and its value names a smaller shard. What is still larger is dealt into chunks; each pair of chunks
has a task of its own, so nothing is lost and no task grows. Local groups are then joined into components.

Trees are not broadcast: together they hold every fingerprint ten times, so they grow with the input, and broadcasting them a
bounded batch at a time would read all fingerprints once for each batch. They are shuffled to where they are searched instead.

Defined results: null and blank texts have fingerprint zero and are linked like any other; fewer than three words make
one shingle; repeated rows and ids are each given their component; rows whose id is null are members, but name a
component only if no member has an id (then it is null). Whole texts are read. Ties do not arise: half of the hashes is
not over half. An empty table gives an empty result; columns beside id and text may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.common import discard, fresh, materialise, sorted_groups, strings
from glyphloom.llm.components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Distinct fingerprints that one tree may hold.
SHARD_MOST = 4096
#: Shingles whose bits are counted at a time.
PIECE = 1 << 15


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles: Iterable[tuple] = [tuple(words)]
    else:
        shingles = zip(*(words[k:] for k in range(SHINGLE)), strict=False)
    digest, join = xxhash.xxh64_digest, b" ".join
    return majority(np.frombuffer(b"".join([digest(join(s), SEED) for s in shingles]), dtype=np.uint8).reshape(-1, 8))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the rows of eight bytes."""
    counts = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), PIECE):
        counts += np.unpackbits(hashes[a : a + PIECE], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprinted(text: Column) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.arrow_udf("bigint")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t) for t in strings(column)], dtype=np.uint64).view(np.int64))

    return run(text)


class BKTree:
    """Distinct codes under Hamming distance; codes can be taken out again, and emptied branches are not entered."""

    def __init__(self, codes: list[int]) -> None:
        self.codes = codes
        self.children: list[dict[int, int]] = [{} for _ in codes]
        self.parent = [-1] * len(codes)
        self.alive = [1] * len(codes)
        self.here = [True] * len(codes)
        for k in range(1, len(codes)):
            at, code = 0, codes[k]
            while True:
                self.alive[at] += 1
                d = (codes[at] ^ code).bit_count()
                if (nxt := self.children[at].get(d)) is None:
                    self.children[at][d] = k
                    self.parent[k] = at
                    break
                at = nxt

    def take(self, k: int) -> None:
        self.here[k] = False
        while k >= 0:
            self.alive[k] -= 1
            k = self.parent[k]

    def within(self, code: int, radius: int) -> list[int]:
        """Numbers of the codes still here that differ from ``code`` in at most ``radius`` bits."""
        found, todo = [], [0] if self.alive and self.alive[0] else []
        codes, children, alive, here = self.codes, self.children, self.alive, self.here
        while todo:
            at = todo.pop()
            d = (codes[at] ^ code).bit_count()
            if d <= radius and here[at]:
                found.append(at)
            below = children[at]
            if len(below) <= 2 * radius + 1:
                todo += [c for e, c in below.items() if d - radius <= e <= d + radius and alive[c]]
            else:
                todo += [c for e in range(max(0, d - radius), d + radius + 1) if (c := below.get(e)) is not None and alive[c]]
        return found


def local_links(codes: list[int], radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """For each code that isn't the first of its group: itself and the first. Groups: connected within the radius."""
    if len(codes) == 2:
        if (codes[0] ^ codes[1]).bit_count() <= radius:
            yield codes[1], codes[0]
        return
    tree = BKTree(codes)
    for k, code in enumerate(codes):
        if not tree.here[k]:
            continue
        tree.take(k)
        todo = [code]
        while todo:
            for j in tree.within(todo.pop(), radius):
                tree.take(j)
                todo.append(codes[j])
                yield codes[j], code


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cut(places: list[int], n: int) -> list[int]:
    """Masks of n blocks of about equally many of the bits."""
    edges = [len(places) * k // n for k in range(n + 1)]
    return [sum(1 << p for p in places[a:b]) for a, b in zip(edges, edges[1:])]


def shard_masks(radius: int = RADIUS) -> list[int]:
    """The bits that name a shard: all pairs of radius + 2 blocks."""
    return [a | b for a, b in combinations(cut(list(range(64)), radius + 2), 2)]


def shard_keys(fp: Column, radius: int = RADIUS) -> Column:
    """An array of shards: the number of the pair of blocks and the blocks' bits."""
    return F.array(*(F.struct(F.lit(k).alias("p"), fp.bitwiseAND(F.lit(signed(m))).alias("v")) for k, m in enumerate(shard_masks(radius))))


def finer_keys(fp: Column, p: Column, radius: int = RADIUS) -> Column:
    """An array of the parts of shard ``p``: the number of the third block, of the bits that don't name the shard, and its bits."""
    blocks = [cut([k for k in range(64) if not m >> k & 1], radius + 1) for m in shard_masks(radius)]
    masks = F.array(*(F.array(*(F.lit(signed(m)) for m in x)) for x in blocks))
    return F.transform(F.element_at(masks, p + 1), lambda m, k: F.struct(k.alias("s"), fp.bitwiseAND(m).alias("w")))


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []

        def out() -> pa.RecordBatch:
            made = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b)]
            a.clear(), b.clear()
            return pa.RecordBatch.from_arrays(made, ["a", "b"])

        for _, (fps,) in sorted_groups(batches, 6):
            if len(fps) > 1:
                for x, y in local_links(fps.view(np.uint64).tolist(), radius):
                    a.append(x)
                    b.append(y)
            if len(a) > 10_000:
                yield out()
        yield out()

    return run


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links between distinct fingerprints (column ``fp``) that have the components of all pairs within the radius."""
    keyed = fps.select("fp", F.explode(shard_keys(F.col("fp"), radius)).alias("k")).select("fp", F.col("k.p").alias("p"), F.col("k.v").alias("v"))
    sizes = keyed.groupBy("p", "v").agg(F.count("*").alias("n")).where("n > 1")
    sized = keyed.join(sizes, ["p", "v"])
    small = sized.where(F.col("n") <= SHARD_MOST).select("p", "v", F.lit(-1).alias("s"), F.lit(0).cast("long").alias("w"), F.lit(0).alias("x"), F.lit(0).alias("y"), "fp")
    finer = sized.where(F.col("n") > SHARD_MOST).select("p", "v", "fp", F.explode(finer_keys(F.col("fp"), F.col("p"), radius)).alias("k")).select("p", "v", "k.s", "k.w", "fp")
    parts = finer.groupBy("p", "v", "s", "w").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / SHARD_MOST).cast("int")
    dealt = finer.join(parts, ["p", "v", "s", "w"]).withColumn("c", chunks).withColumn("own", F.pmod(F.xxhash64("fp", F.lit("chunk")), "c").cast("int"))
    # every pair of chunks meets once; a shard of one chunk meets itself
    others = F.when(F.col("c") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("c") - 1), lambda o: o != F.col("own")))
    paired = dealt.withColumn("o", F.explode(others)).select("p", "v", "s", "w", F.least("own", "o").alias("x"), F.greatest("own", "o").alias("y"), "fp")
    keys = ("p", "v", "s", "w", "x", "y")
    grouped = small.union(paired).repartition(*keys).sortWithinPartitions(*keys, "fp")
    return grouped.mapInArrow(_links(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: its id, ``fp`` (signed long), ``component_id`` (the smallest id of its component)."""
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), fingerprinted(F.col(text)).alias("fp")), "fingerprints")
    return components_of(rows, radius)


def components_of(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of a stored table of ``doc_id`` and ``fp``."""
    member = rooted(rows, radius)
    names = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def rooted(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp``, its smallest id (``least``) and ``root``, equal within a component, of a stored table of ``doc_id`` and ``fp``."""
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(fps.select("fp"), radius))
    member = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    found = materialise(member, "members")
    discard(roots)
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Of each component the row with the smallest id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), fingerprinted(F.col(text)).alias("fp"))
    rows = materialise(rows, "fingerprints")
    members = rooted(rows, radius)
    found = kept_rows(docs, rows.join(members, "fp").select("doc_id", "h", "root"), id_col, text)
    discard(rows, members)
    return found


def kept_rows(docs: DataFrame, members: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row of ``docs`` for each root of ``members`` (``doc_id``, ``h``: the text's xxhash64, ``root``).

    It is the row with the smallest id, rows without an id last; of rows with one id, that whose text has the smallest hash.
    """
    same = members.groupBy("root", "doc_id", "h").agg(F.count("*").alias("n"))
    first = same.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "n")).alias("k"))
    kept = materialise(first.select("k.doc_id", "k.h", "k.n"), "kept")
    h = fresh(docs, "_h")

    def found(which: str) -> DataFrame:
        # One plan whatever the size: a broadcast of the kept keys would grow with the input.
        named = kept.where(which).select(F.col("doc_id").alias("_kept_id"), F.col("h").alias("_kept_h")).hint("merge")
        return docs.withColumn(h, F.xxhash64(text)).join(named, F.col(id_col).eqNullSafe(F.col("_kept_id")) & (F.col(h) == F.col("_kept_h")), "left_semi")

    if kept.where("n > 1").isEmpty():
        return found("true").drop(h)
    return found("n = 1").union(found("n > 1").dropDuplicates([id_col, h])).drop(h)
