"""Tables kept in the folder that driver and executors share, and indices over ordered rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a block of ``with_place``, as far as there are no more than 2 to the power of BLOCK_BITS blocks in a group.
BLOCK_ROWS, BLOCK_BITS = 1024, 16


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, by Spark's default file system where it names none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session has none and runs on one machine, a temporary folder that becomes its checkpoint folder."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (found.get() if found.isDefined() else None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="glyphloom-")
        spark.sparkContext.setCheckpointDir(base)
    return qualified(spark, base).rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path, schema = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def with_index(df: DataFrame, order: list[Column], name: str = "i") -> DataFrame:
    """Numbers the rows from 0 in the order given, which must be total, without moving them to one partition.

    Rows are dealt by ranges of the order, numbered within their partition, and shifted by the rows of the partitions before.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = kept(dealt, "indexed")
    part = F.shiftright("_id", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row for each partition.
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.select(*(F.col(f"`{c}`") for c in df.columns), place.alias(name))


def with_place(df: DataFrame, group: str, digest: Column, ties: list[Column], most: int, name: str = "i") -> DataFrame:
    """Numbers each group's rows from 0 in the order of a hexadecimal digest, then of ``ties``; that order must be total.

    Digests are spread evenly, so a row's block is the head of its digest. Blocks are numbered on their own and shifted by the rows
    of the blocks before. A block follows from the row alone: nothing has to be written, and rows are dealt out once. ``most`` is
    about how many rows a group has at most; it only sets the number of blocks.
    """
    bits = min(BLOCK_BITS, max(0, (max(most, 1) // BLOCK_ROWS).bit_length()))
    block = F.shiftright(F.conv(F.substring(digest, 1, BLOCK_BITS // 4), 16, 10).cast("int"), BLOCK_BITS - bits)
    rows = df.withColumn("_block", block)
    sizes = rows.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    before = sizes.select(group, "_block", (F.sum("_n").over(Window.partitionBy(group).orderBy("_block")) - F.col("_n")).alias("_before"))
    order = Window.partitionBy(group, "_block").orderBy(digest, *ties)
    # The digest is made again after the rows are dealt, as it is long.
    numbered = rows.repartition(group, "_block").withColumn("_place", F.row_number().over(order) - 1)
    # So many rows at most for each group: 2 to the power of BLOCK_BITS.
    return numbered.join(F.broadcast(before), [group, "_block"]).select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_before") + F.col("_place")).alias(name))
