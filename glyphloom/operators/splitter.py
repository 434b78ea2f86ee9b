"""Train and validation splits that each hold the whole vocabulary."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.functions import draws
from glyphloom.storage import kept, with_index, with_place

SPLITS = ("train", "val")


def sizes(num_images: int, val_percent: float) -> tuple[int, int]:
    """Rows of train and of val before missing words are added; val is rounded up, in binary floating point."""
    val = math.ceil(num_images * float(val_percent))
    return num_images - val, val


def size_columns(n: Column, p: Column) -> tuple[Column, Column]:
    val = F.ceil(n * p.cast("double")).cast("bigint")
    return n - val, val


def cyclic_extend(words: DataFrame, num_images: int, n: int | None = None) -> DataFrame:
    """``k`` and ``word`` for k below num_images: row k is word number k modulo their count. Words come as ``i``, ``word``.

    Where their count ``n`` is given, ``words`` may be the first ``num_images`` of them.
    """
    n = words.count() if n is None else n
    if n == 0:
        if num_images:
            raise ValueError("an empty word list cannot be extended")
        return words.select(F.col("i").alias("k"), "word").limit(0)
    rows = words.sparkSession.range(num_images).select(F.col("id").alias("k"), (F.col("id") % n).alias("i"))
    return rows.join(words, "i").select("k", "word")


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """Adds ``rank``: the place of ``k`` in a random order that depends on the seed alone."""
    keyed = rows.withColumn("_h", draws.digest(seed, "shuffle", "k", "word"))
    return with_index(keyed, [F.col("_h").asc(), F.col("k").asc()], "rank").drop("_h")


def sliced(rows: DataFrame, num_images: int, val_percent: float) -> DataFrame:
    """Adds ``split``: the first ranks are train, the others val."""
    train, _ = sizes(num_images, val_percent)
    return rows.withColumn("split", F.when(F.col("rank") < train, "train").otherwise("val"))


def missing(rows: DataFrame, every: DataFrame) -> DataFrame:
    """``split`` and ``word`` of the words of ``every``, which may repeat them, that a split lacks.

    The splits that have a word are bits of a number, so the words are dealt out once, for both splits and for being distinct.
    """
    listed = 1 << len(SPLITS)
    bit = F.coalesce(*(F.when(F.col("split") == s, 1 << k) for k, s in enumerate(SPLITS)))
    seen = every.select("word", F.lit(listed).alias("_in")).unionByName(rows.select("word", bit.alias("_in")))
    held = seen.groupBy("word").agg(F.bit_or("_in").alias("_in")).where(F.col("_in") >= listed)
    lacking = F.array(*(F.when(F.col("_in").bitwiseAND(1 << k) == 0, s) for k, s in enumerate(SPLITS)))
    return held.select(F.explode(lacking).alias("split"), "word").where("split IS NOT NULL")


def slices(words: DataFrame, num_images: int, val_percent: float, seed: int = 0, n: int | None = None) -> DataFrame:
    """``split``, ``rank``, ``word`` of the slices in random order, stored. ``n`` as for ``cyclic_extend``."""
    rows = sliced(shuffled(cyclic_extend(words, num_images, n), seed), num_images, val_percent)
    return kept(rows.select("split", "rank", "word"), "slices")


def completed(rows: DataFrame, every: DataFrame, n: int, seed: int = 0, dedupe: bool = False) -> DataFrame:
    """``split``, ``idx``, ``word``, ``added``: the slices in their order, then the words of ``every`` that they lack.

    Rows of equal words all stay; with ``dedupe`` the first of each split does. ``n`` is the number of words. The words are dealt out
    twice, to find what a split lacks and to number that, and not written.
    """
    own = rows.select("split", F.col("rank").alias("_i"), "word")
    if dedupe:
        first = own.groupBy("split", "word").agg(F.min("_i").alias("_i")).select("split", "_i", "word")
        own = with_index(first.withColumnRenamed("_i", "rank"), [F.col("split"), F.col("rank")], "_i")
    # Two rows.
    starts = {r["split"]: (r["start"], r["n"]) for r in own.groupBy("split").agg(F.min("_i").alias("start"), F.count("*").alias("n")).collect()}

    def of(k: int) -> Column:
        return F.coalesce(*(F.when(F.col("split") == s, starts.get(s, (0, 0))[k]) for s in SPLITS)).cast("bigint")

    more = with_place(missing(rows, every), "split", draws.digest(seed, "added", "split", "word"), [F.col("word")], n, "_i")
    own = own.select("split", (F.col("_i") - of(0)).alias("idx"), "word", F.lit(0).alias("added"))
    return own.unionByName(more.select("split", (F.col("_i") + of(1)).alias("idx"), "word", F.lit(1).alias("added")))


def split_words(words: DataFrame, num_images: int, val_percent: float, seed: int = 0, dedupe: bool = False) -> DataFrame:
    """``split``, ``idx``, ``word``, ``added``: the slices of ``words`` (``i``, ``word``) in random order, then the words they lack."""
    n = words.count()
    return completed(slices(words, num_images, val_percent, seed, n), words, n, seed, dedupe)


def manifest(rows: DataFrame, output_dir: str) -> DataFrame:
    """Adds the image's name, which restarts in each split and grows past five digits, and its folder."""
    name = F.format_string("%05d.png", F.col("idx"))
    return rows.withColumns({"filename": name, "save_path": F.concat_ws("/", F.lit(output_dir), F.col("split"), F.lit("images"), name)})
