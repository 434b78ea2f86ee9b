"""op3_media_columns: every text stored as a container in a Parquet table of the shared folder, read back and indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm import media as M
from glyphloom.llm.common import materialise, read_table


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    table = materialise(M.stored(docs), "media")
    found = M.inspected(table, keep=("doc_id", "n_bytes"))
    ranges = F.col("keyframe_ranges")
    text = F.concat_ws(
        ";",
        F.concat(F.lit("codec="), F.col("codec")),
        F.concat(F.lit("seconds="), F.format_string("%.6f", F.col("seconds"))),
        F.concat(F.lit("samples="), F.col("samples").cast("string")),
        F.concat(F.lit("keyframes="), F.col("keyframes").cast("string")),
        F.concat(F.lit("ranges="), F.array_join(F.transform(ranges, lambda r: F.concat(r[0].cast("string"), F.lit("-"), r[1].cast("string"))), ",")),
    )
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", text.alias("feature"),
    )
