"""Fonts that can draw all characters of a word, by bitmaps of fonts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.functions import draws

#: Code points that are looked up at a time.
LOOKED_UP = 1 << 20


class Cover:
    """The fonts that have all code points of a word, as bits, 64 to a number.

    Code points of the same fonts are a class. A class is a row of ``bits``; class 0 is of those that no font has.
    """

    def __init__(self, chars: list[str], masks: np.ndarray) -> None:
        self.points = np.array([ord(c) for c in chars], np.int64)
        found, kinds = np.unique(masks, axis=0, return_inverse=True)
        self.bits = np.concatenate([np.zeros((1, masks.shape[1]), np.int64), found])
        self.kinds = kinds.reshape(-1).astype(np.uint32) + 1
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def of(self, words: pa.Array) -> np.ndarray:
        """A row of numbers for each word; those of empty words and of nulls are 0."""
        if self.table is None:
            self.table = np.zeros(0x110000, np.uint32)
            self.table[self.points] = self.kinds
        out = np.zeros((len(words), self.bits.shape[1]), np.int64)
        try:
            texts = [w or "" for w in words.to_pylist()]
        except UnicodeDecodeError:  # bytes that aren't UTF-8 become points that no font has
            texts = [(w or b"").decode(errors="surrogateescape") for w in words.cast(pa.binary()).to_pylist()]
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = sizes.cumsum()
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + LOOKED_UP, "right")))
            some = a + np.flatnonzero(sizes[a:b])
            if len(some):
                kinds = self.table[np.frombuffer("".join(texts[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32)]
                starts = (ends - sizes)[some] - (ends[a] - sizes[a])
                for k in range(out.shape[1]):
                    out[some, k] = np.bitwise_and.reduceat(self.bits[:, k][kinds], starts)
            a = b
        return out


def candidates(words: DataFrame, font_chars: DataFrame) -> DataFrame:
    """``word`` and ``candidates``, the sorted fonts that have every character of it; words without any have an empty array.

    Each character has the fonts that draw it as bits; a word's fonts are the bitwise AND over its characters, which are looked up
    where the distinct words lie: no row of a character or of a set of them is made or dealt out.
    ``font_chars`` has distinct rows of ``font_path``, ``ch``.
    """
    # There are as many paths as font files.
    paths = [r["font_path"] for r in font_chars.select("font_path").distinct().sort("font_path").collect()]
    distinct = words.select("word").distinct()
    if not paths:
        return distinct.select("word", F.array().cast("array<string>").alias("candidates"))
    numbered = words.sparkSession.createDataFrame(list(enumerate(paths)), "k int, font_path string")
    blocks = range((len(paths) + 63) // 64)
    bit = F.expr("shiftleft(1L, k % 64)")
    of = font_chars.join(F.broadcast(numbered), "font_path").groupBy("ch")
    # One row for each character that any font has: bounded by Unicode.
    masks = of.agg(*(F.bit_or(F.when(F.floor(F.col("k") / 64) == b, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"m{b}") for b in blocks)).collect()
    cover = Cover([r["ch"] for r in masks], np.array([r[1:] for r in masks], np.int64).reshape(len(masks), len(blocks)))
    sent = words.sparkSession.sparkContext.broadcast(cover)

    @F.arrow_udf("array<bigint>")
    def fonts_of(word: pa.Array) -> pa.Array:
        own = sent.value.of(word)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * own.shape[1]), pa.array(own.reshape(-1)))

    names = F.filter(F.array(*map(F.lit, paths)), lambda p, k: F.getbit(F.get("_own", F.floor(k / 64).cast("int")), k % 64) == 1)
    return distinct.withColumn("_own", fonts_of("word")).select("word", names.alias("candidates"))


def chosen(rows: DataFrame, found: DataFrame, seed: int, *keys: str) -> DataFrame:
    """``rows`` with ``font_path``, drawn from the word's candidates by the keys; null where there is none."""
    return rows.join(found, "word", "left").withColumn("font_path", draws.choice(F.coalesce("candidates", F.array().cast("array<string>")), seed, "font", *keys)).drop("candidates")
