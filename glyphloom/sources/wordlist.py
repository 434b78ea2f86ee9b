"""Word lists: one entry per line, blank lines left out, order and repetitions kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.functions import text
from glyphloom.storage import with_index


#: Ranges of keys that ``first_words`` counts by.
RANGES = 64


def entries(docs: DataFrame, order: list[str], column: str = "text") -> DataFrame:
    """The non-blank lines of a table of texts as ``word``, with ``pos`` and the columns of the order, not numbered."""
    lines = docs.select(*order, F.posexplode(text.lines(F.col(column))).alias("pos", "line"))
    return lines.select(*order, "pos", text.strip(F.col("line")).alias("word")).where("word <> ''")


def words_of(docs: DataFrame, order: list[str], column: str = "text") -> DataFrame:
    """``i`` and ``word`` of the non-blank lines of a table of texts, in the order of its rows and of their lines."""
    return with_index(entries(docs, order, column), [F.col(c).asc_nulls_first() for c in (*order, "pos")]).select("i", "word")


def first_words(docs: DataFrame, key: str, num: int, column: str = "text") -> tuple[DataFrame, int]:
    """``i`` and ``word`` as ``words_of`` numbers them by ``key``, for i below ``num``; and the number of all words.

    The words of all texts are counted by ranges of the key. Only the texts of the ranges that hold the first ``num`` words have
    their words dealt out and numbered.
    """
    sizes = entries(docs, [key], column).groupBy(key).agg(F.count("*").alias("n"))
    dealt = sizes.repartitionByRange(RANGES, F.col(key).asc_nulls_first()).withColumn("part", F.spark_partition_id())
    # One row for each range.
    ranges = dealt.groupBy("part").agg(F.sum("n").alias("n"), F.max(key).alias("last")).sort("part").collect()
    before = 0
    for r in ranges:
        before += r["n"]
        if before >= num:
            # Nulls come first; a range of nothing else has no last key.
            kind = docs.schema[key].dataType
            docs = docs.where(F.col(key).isNull() | (F.col(key) <= F.lit(r["last"]).cast(kind)))
            break
    return words_of(docs, [key], column).where(F.col("i") < num), sum(r["n"] for r in ranges)


def _marked(spark: SparkSession, files: list[str]) -> list[str]:
    """Those of the files that begin with a byte-order mark."""
    found = []
    for name in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
        try:
            if [stream.read() for _ in range(3)] == [0xEF, 0xBB, 0xBF]:
                found.append(name)
        finally:
            stream.close()
    return found


def read(spark: SparkSession, path: str, strip_bom: bool = False) -> DataFrame:
    """``i`` and ``word`` of the text files at ``path``, in the order of their names.

    Files of any size are read in blocks, line feed by line feed, and lines are then broken at carriage returns. Spark drops a
    byte-order mark; it is put back before the first line of its file (it is no white space) unless ``strip_bom`` is set.
    """
    at = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    rows = spark.read.option("lineSep", "\n").text(path).select(at[0].alias("file"), at[1].alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    marked = [] if strip_bom else _marked(spark, [r["file"] for r in spark.read.format("binaryFile").load(path).select(F.col("path").alias("file")).collect()])
    if marked:
        first = rows.where(F.col("file").isin(marked) & (F.col("block") == 0)).groupBy("file").agg(F.min("row").alias("_first"))
        # One row for each marked file.
        rows = rows.join(F.broadcast(first), "file", "left").withColumn("value", F.when(F.col("row") == F.col("_first"), F.concat(F.lit("\ufeff"), "value")).otherwise(F.col("value")))
    lines = rows.select("file", "block", "row", F.posexplode(F.split("value", "\r")).alias("pos", "line"))
    words = lines.select("file", "block", "row", "pos", text.strip(F.col("line")).alias("word")).where("word <> ''")
    return with_index(words, [F.col("file"), F.col("block"), F.col("row"), F.col("pos")]).select("i", "word")
