"""op6_toxicity: the toxicity of every document, as the labels mark it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm import toxicity as T
from glyphloom.llm.common import held_out, read_table


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = T.fit(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), T.scored(F.col("text"), model).alias("score"))
    return rows.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
