"""Sinks: the manifest, the images as files, labels, and the run's summary."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphloom.storage import qualified

#: Labels of one row of ``label_map``.
MAP_ROWS = 100_000
#: Steps of a block of ``progress``.
BLOCK = 4096


def write_images(results: DataFrame, output_dir: str) -> int:
    """Writes each success to ``<output_dir>/<split>/images/<filename>`` from the executors; returns their number.

    A file is written under a name of its own and renamed, so a repeated task leaves the same files. Other files stay.
    """
    out = qualified(results.sparkSession, output_dir)
    store, root = fs.FileSystem.from_uri(out)
    for split in ("train", "val"):
        store.create_dir(f"{root}/{split}/images", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = fs.FileSystem.from_uri(out)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for split, name, png in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = f"{base}/{split}/images/.{name}.{attempt}.part"
                with own.open_output_stream(part) as f:
                    f.write(png)
                own.move(part, f"{base}/{split}/images/{name}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    rows = results.where("success").select("split", "filename", "png")
    return rows.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def labels(results: DataFrame) -> DataFrame:
    """``split``, ``idx``, ``filename`` and ``text`` of the successes."""
    return results.where("success").select("split", "idx", "filename", F.col("word").alias("text"))


def write_labels(results: DataFrame, output_dir: str) -> None:
    """Labels as JSON lines by split; and ``labels.json``, one object by file name in the order of idx.

    The object is written label by label as sorted partitions come in, so the driver holds one of them at a time.
    """
    rows = labels(results)
    out = qualified(results.sparkSession, output_dir)
    rows.write.mode("overwrite").partitionBy("split").json(f"{out}/labels")
    store, root = fs.FileSystem.from_uri(out)
    word = lambda s: json.dumps(s, ensure_ascii=False)
    for split in sorted(r["split"] for r in rows.select("split").distinct().collect()):
        found = rows.where(F.col("split") == split).sort("idx").select("filename", "text").toLocalIterator()
        store.create_dir(f"{root}/{split}", recursive=True)
        with store.open_output_stream(f"{root}/{split}/labels.json") as f:
            f.write(b"{")
            for k, r in enumerate(found):
                f.write(f"{',' * (k > 0)}\n  {word(r['filename'])}: {word(r['text'])}".encode())
            f.write(b"\n}")


def summary(results: DataFrame) -> DataFrame:
    """``split``, successes and all rows."""
    return results.groupBy("split").agg(F.count_if("success").alias("n_success"), F.count("*").alias("n_total"))


def label_map(results: DataFrame, rows: int = MAP_ROWS) -> DataFrame:
    """``split``, ``part`` and the labels of that part's ``rows`` places (of idx) as a map."""
    part = labels(results).withColumn("part", F.floor(F.col("idx") / rows))
    return part.groupBy("split", "part").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("filename", "text")))).alias("labels"))


def progress(results: DataFrame, every: int = 50) -> DataFrame:
    """What a monitor would show after each ``every`` rows of a split and at its end: rows and successes so far.

    Rows are first summed up by step, and steps by blocks of BLOCK: a window orders the few blocks of a split, others the steps within
    a block, so none grows with a split's rows.
    """
    steps = results.groupBy("split", F.floor(F.col("idx") / every).alias("step")).agg(F.count("*").alias("n"), F.count_if("success").alias("ok"))
    steps = steps.withColumn("block", F.floor(F.col("step") / BLOCK))
    order = Window.partitionBy("split").orderBy("block")
    blocks = steps.groupBy("split", "block").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))
    before = blocks.select("split", "block", *((F.sum(c).over(order) - F.col(c)).alias(f"{c}_before") for c in ("n", "ok")))
    within = Window.partitionBy("split", "block").orderBy("step")
    done = steps.select("split", "block", F.sum("n").over(within).alias("n"), F.sum("ok").over(within).alias("ok"))
    return done.join(before, ["split", "block"]).select("split", (F.col("n") + F.col("n_before")).alias("completed"), (F.col("ok") + F.col("ok_before")).alias("succeeded"))


def rate_and_eta(done: float, total: float, seconds: float) -> tuple[float, float | None]:
    """Images a second so far, and the seconds left at that rate; None where nothing has been done yet."""
    rate = done / seconds if seconds > 0 else 0.0
    return rate, (total - done) / rate if rate > 0 else None


class Monitor:
    """Shows, while a run's images are drawn, about how many are done, their rate, and the time left.

    Spark counts finished tasks; ``total`` images are taken to be dealt to them evenly. ``show`` gets each line.
    """

    def __init__(self, spark: SparkSession, total: int, show: Callable[[str], None] = print, every: float = 5.0) -> None:
        self.context, self.total, self.show, self.every = spark.sparkContext, total, show, every
        self.group, self.over = f"images-{id(self)}", threading.Event()

    def __enter__(self) -> Monitor:
        self.began = time.monotonic()
        self.context.setJobGroup(self.group, "images", False)
        self.thread = threading.Thread(target=self._watch, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *error: object) -> None:
        self.over.set()
        self.thread.join()
        self.context.setLocalProperty("spark.jobGroup.id", None)
        if error[0] is None:
            self.show(self.line(self.total))

    def line(self, done: float) -> str:
        rate, left = rate_and_eta(done, self.total, time.monotonic() - self.began)
        return f"{done:.0f} of {self.total} images, {rate:.1f} a second" + (f", {left:.0f} s left" if left is not None else "")

    def _watch(self) -> None:
        tracker = self.context.statusTracker()
        while not self.over.wait(self.every):
            stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(self.group) for s in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else [])]
            known = [s for s in stages if s is not None and s.numTasks]
            if known:
                last = known[-1]
                self.show(self.line(self.total * last.numCompletedTasks / last.numTasks))
