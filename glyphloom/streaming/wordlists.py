"""Word lists that arrive as files over time: each micro-batch becomes a split manifest of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphloom.functions import text
from glyphloom.operators import splitter
from glyphloom.storage import with_index


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, num_images: int, val_percent: float = 0.2, seed: int = 0) -> StreamingQuery:
    """Reads text files as they come and writes, per batch, the manifest of its words to ``<out>/batch=<n>``.

    A repeated batch overwrites its own folder and nothing else, so its result is there exactly once.
    """
    lines = spark.readStream.format("text").option("wholetext", "true").load(folder).select(F.col("_metadata.file_path").alias("file"), "value")

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("file", F.posexplode(text.lines(F.col("value"))).alias("pos", "line"))
        words = rows.select("file", "pos", text.strip(F.col("line")).alias("word")).where("word <> ''")
        if words.isEmpty():
            return
        numbered = with_index(words, [F.col("file"), F.col("pos")]).select("i", "word")
        made = splitter.manifest(splitter.split_words(numbered, num_images, val_percent, seed + number), out)
        made.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
