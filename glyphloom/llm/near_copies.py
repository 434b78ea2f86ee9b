"""SimHash near-dedup by similarity, for the pipeline: BK-trees of wide radius, with every link verified.

Two documents are near copies if the Jaccard similarity of their sets of 5-word shingles is LEAST or more; groups are the
connected components of that relation. Fingerprints of 64 bits cannot decide this: at similarity 0.8 they differ in about
10 bits and in up to 26, at which blocks of equal bits no longer find the pairs and unrelated texts begin to meet. So
the fingerprints only propose, and three parts replace what the 3-bit form gets from its blocks:

Shards. Equal sets are made one node first. MinHash signatures of BANDS bands with ROWS values each name the shards of a node;
a pair at similarity s shares none with probability (1 - s**ROWS)**BANDS: 3e-6 at 0.8, 7e-9 at 0.85.

Trees. Each shard's nodes whose fingerprints lie within RADIUS of its smallest node's are held against that one first, and
components are made of what passes. Only shards that then still have nodes of different components get a BK-tree, in the
task that searches it, and the search follows the edges within RADIUS. A shard over SHARD_MOST is dealt into chunks, each
pair of which meets, so nothing is capped. For large sets at similarity 0.8 a fingerprint's distance has mean 9.7 and
deviation 2.9, for sets of 4 and 5 shingles 12 and 3.1: over RADIUS with probability 2e-9 and 2e-6.

Links. What the trees propose is verified by the exact sets of 64-bit shingle hashes.

Defined results: null and blank texts are copies of each other; fewer than five words make one shingle; words and case
are as in ``simhash``; whole texts are read; repeated rows and ids are judged by their texts (see ``simhash.kept_rows``);
ties do not arise, since the comparison is of whole numbers; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.common import discard, fresh, materialise, sole, sorted_groups, strings
from glyphloom.llm.components import connected_components
from glyphloom.llm.simhash import BKTree, kept_rows, majority

SHINGLE = 5
SEED = 42
#: Least similarity of near copies, as a fraction so that the comparison is exact.
LEAST = (4, 5)
BANDS, ROWS = 32, 5
MULTIPLIERS = np.array([xxhash.xxh64_intdigest(str(k).encode(), SEED) | 1 for k in range(BANDS * ROWS)], dtype=np.uint64)
#: Bits in which the fingerprints of near copies may differ.
RADIUS = 26
#: Nodes of one shard that one tree holds.
SHARD_MOST = 1024
#: Shingles that are multiplied at a time.
PIECE = 512


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted."""
    words = (text or "").encode().lower().split()
    if len(words) < SHINGLE:
        shingles: Iterable[tuple] = [tuple(words)] if words else []
    else:
        shingles = zip(*(words[k:] for k in range(SHINGLE)), strict=False)
    digest, join = xxhash.xxh64_digest, b" ".join
    return np.unique(np.frombuffer(b"".join([digest(join(s), SEED) for s in shingles]), dtype=np.uint64))


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """The buckets of a set; an empty one has none."""
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for a in range(0, len(hashes), PIECE):
        np.minimum(least, (hashes[a : a + PIECE, None] * MULTIPLIERS).min(axis=0), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = (out ^ column) * MULTIPLIERS[0]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """True where two sorted sets of distinct hashes have the similarity asked for."""
    n, (p, q) = len(a) + len(b), LEAST
    if min(len(a), len(b)) * q < max(len(a), len(b)) * p:
        return False
    both = np.sort(np.concatenate((a, b)))
    common = int((both[1:] == both[:-1]).sum())
    return common * q >= (n - common) * p


def described(text: Column) -> Column:
    """A struct for a text column: ``node``, the digest of its set, ``fp``, the set's fingerprint, and ``bands``."""

    @F.arrow_udf("node bigint, fp bigint, bands array<bigint>")
    def run(column: pa.Array) -> pa.Array:
        sole("near copies")
        nodes, prints, bands = [], [], []
        for t in strings(column):
            s = shingle_set(t)
            nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0)
            prints.append(majority(s.view(np.uint8).reshape(-1, 8)))
            bands.append(bands_of(s))
        made = *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (nodes, prints)), pa.array(bands, pa.list_(pa.int64()))
        return pa.StructArray.from_arrays(made, ["node", "fp", "bands"])

    return run(text)


def sets_of(text: Column) -> Column:
    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        sole("near copies")
        return pa.array([shingle_set(t).tobytes() for t in strings(column)], pa.binary())

    return run(text)


def verified(a: Column, b: Column) -> Column:
    @F.arrow_udf("boolean")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        sole("near copies")
        pairs = zip(x, y, strict=True)
        return pa.array([alike(*(np.frombuffer(s.as_py(), dtype=np.uint64) for s in p)) for p in pairs], pa.bool_())

    return run(a, b)


def tree_links(nodes: list[int], labels: list[int], prints: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that join what is alike among the nodes; nodes of equal labels are joined already."""
    above = {x: x for x in labels}

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    tree = BKTree(prints)
    for i, code in enumerate(prints):
        tree.take(i)
        for j in tree.within(code, RADIUS):
            x, y = top(labels[i]), top(labels[j])
            if x != y and alike(sets[i], sets[j]):
                above[x] = y
                yield nodes[i], nodes[j]


def _tree_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sole("near copies")
    for _, (nodes, labels, prints, sets) in sorted_groups(batches, 3):
        found = list(tree_links(nodes.tolist(), labels.tolist(), prints.view(np.uint64).tolist(), [np.frombuffer(s, dtype=np.uint64) for s in sets]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])


def rooted(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``h`` (hash of the text) and ``root``, equal within a group; stored."""
    own = fresh(docs, "_h")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), described(F.col(text)).alias("d"))
    rows = materialise(rows.select("doc_id", "h", "d.node", "d.fp", "d.bands"), "described")
    nodes = materialise(rows.groupBy("node").agg(F.min("bands").alias("bands"), F.min("fp").alias("fp"), F.min(F.struct("doc_id", "h")).alias("r")), "nodes")
    banded = nodes.select("node", "fp", F.explode("bands").alias("v"))
    shards = banded.groupBy("v").agg(F.min(F.struct("node", "fp")).alias("c"), F.max("node").alias("most")).where("c.node < most")
    shared = materialise(banded.join(shards.select("v", "c"), "v").select("v", "node", "fp", F.col("c.node").alias("c"), F.col("c.fp").alias("c_fp")), "shared")
    one = shared.select("node").distinct().join(nodes, "node").select("node", F.col("r.doc_id").alias("_r"), F.col("r.h").alias("_rh"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t")).withColumn(own, F.xxhash64("_t"))
    # One plan whatever the size: a broadcast of these keys would grow with the input.
    texts = texts.join(one.hint("merge"), F.col("_id").eqNullSafe(F.col("_r")) & (F.col(own) == F.col("_rh")))
    sets = materialise(texts.select("node", sets_of(F.col("_t")).alias("s")).groupBy("node").agg(F.min("s").alias("s")), "sets")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("c_fp"))) <= RADIUS
    pairs = shared.where((F.col("node") != F.col("c")) & near).select(F.col("node").alias("a"), F.col("c").alias("b")).distinct()
    both = pairs.join(sets.toDF("a", "sa").hint("merge"), "a").join(sets.toDF("b", "sb").hint("merge"), "b")
    links = materialise(both.where(verified(F.col("sa"), F.col("sb"))).select("a", "b"), "links")
    roots = connected_components(links)
    label = F.coalesce("root", "node")
    labelled = shared.join(roots, "node", "left").select("v", "node", "fp", label.alias("label"))
    mixed = labelled.groupBy("v").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("v", "n")
    left = materialise(labelled.join(mixed, "v"), "left")
    chunks = F.ceil(F.col("n") / SHARD_MOST).cast("int")
    dealt = left.withColumn("k", chunks).withColumn("own", F.pmod(F.xxhash64("node", F.lit("chunk")), "k").cast("int"))
    # every pair of chunks meets once; a shard of one chunk meets itself
    others = F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda o: o != F.col("own")))
    met = dealt.withColumn("o", F.explode(others)).select("v", F.least("own", "o").alias("x"), F.greatest("own", "o").alias("y"), "node", "label", "fp")
    grouped = met.join(sets.hint("merge"), "node").select("v", "x", "y", "node", "label", "fp", "s").repartition("v", "x", "y").sortWithinPartitions("v", "x", "y", "node")
    more = materialise(grouped.mapInArrow(_tree_links, "a bigint, b bigint"), "more")
    roots = connected_components(links.union(more))
    found = materialise(rows.join(roots, "node", "left").select("doc_id", "h", label.alias("root")), "rooted")
    discard(rows, nodes, shared, sets, links, left, more, roots)
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of near copies the row with the smallest id."""
    members = rooted(docs, id_col, text)
    found = kept_rows(docs, members, id_col, text)
    discard(members)
    return found
