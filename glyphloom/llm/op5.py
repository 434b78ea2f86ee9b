"""op5_licence_scan: licence phrases and template passages of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm import licences as L
from glyphloom.llm.common import read_table


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", L.scanned(F.col("text")).alias("s")).select("doc_id", "s.*")
