"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

language     documents whose language cannot be told (no letter, or next to no likeness with any) go
near_dedup   of each group of near copies (5-word Jaccard similarity 0.8 or more) the document with the smallest id stays
secrets      secrets are masked in the text; documents stay
mixing       documents are repeated or left out by the rates that bring domains to their target weights
encode       the last stage: every row's SentencePiece ids, with digests

Defined results, for all stages: an empty table gives an empty one; whole texts are read, however long; columns beside the
five of ``documents`` are passed on (``encode`` names its own) and may have any name; a null id is no id of its own, so rows
without one are kept apart from each other; null language, source and length change nothing. Each stage says what it does with
null and empty texts, repeated rows and ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm import language_id, mixing, near_copies, op4, secrets_scan, sentencepiece_codec
from glyphloom.llm.common import fresh, read_table, scratch_path, small_batches

#: Cosine with the nearest language below which a document is rejected.
LEAST_LIKENESS = 0.02


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that have no letter or whose best language is no likelier than chance.

    Null, empty and letterless texts go. Repeated rows have one fate. Of languages equally near, the first by name counts.
    """
    small_batches(spark)
    model = language_id.fit(docs)
    name = fresh(docs, "_language")
    found = docs.withColumn(name, language_id.predicted(F.col("text"), model))
    kept = found.where((F.col(f"{name}.lang_pred") != language_id.UNKNOWN) & (F.col(f"{name}.score") >= LEAST_LIKENESS))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that with the smallest id, rows without an id last.

    Null and blank texts are copies of each other. Of rows with one id that whose text has the smallest hash stays; of equal rows, one.
    """
    small_batches(spark)
    return near_copies.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts and has ``n_chars`` follow; rows are as many as before.

    Null and empty texts stay as they are. Repeated rows get equal results. Spans that overlap are masked as one.
    """
    small_batches(spark)
    return secrets_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each row by the whole part of its rate, and once more with the rest's probability, drawn by a hash of its id.

    Null and empty texts have no tokens and the rate of what they look like. Repeated rows, and rows without an id, share a draw.
    """
    return mixing.mixed(docs, read_table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, the ids and their number.

    Null and empty texts have no ids. Repeated rows get equal results.
    """
    small_batches(spark)
    ids = sentencepiece_codec.encoded(F.col("text"), op4.model_path())
    return docs.select("doc_id", "lang", "source", ids.alias("ids")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("mixing", mix),
    ("encode", encode),
]

#: The stages fit models and run in Python, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each but the last written to the shared folder and read back."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path, schema = scratch_path(spark, f"stage-{name}"), docs.schema
            docs.write.parquet(path)
            docs = spark.read.schema(schema).parquet(path)
    return docs
