"""op2_token_files: every text's ids written to files in the shared folder and read back from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphloom.llm import token_files as T
from glyphloom.llm.common import read_table, scratch_path


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    out = scratch_path(spark, "tokens")
    index = T.write(read_table(spark, sf_dir, "documents").select("doc_id", "text"), out, path or tokenizer_path())
    return T.read_digests(index, out)
