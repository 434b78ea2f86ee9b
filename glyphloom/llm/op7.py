"""op7_source_mixing: every document's memberships and rate under the default target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphloom.llm import mixing as M
from glyphloom.llm.common import read_table


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return M.rated(docs, read_table(spark, sf_dir, "labels"))
