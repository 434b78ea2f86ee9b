"""What the operators of this subpackage share: shared storage, the hold-out rule, batch helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.storage import shared_dir

#: Documents whose crc32(doc_id as text) is 0 modulo this are held out of every training set.
HOLD_OUT_MOD = 5


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and returns the table read back.

    It cuts lineage: what follows survives the loss of executors without computing ``df`` again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    kept = spark.read.schema(schema).parquet(path)
    kept.stored_at = [path]
    return kept


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again; what was written from them stays."""
    for df in tables:
        for at in getattr(df, "stored_at", []):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Has Python functions get and give so many rows at a time, so that batches of long texts stay small.

    Workers live on from stage to stage with what they have loaded; batches come on top of that. The setting is the session's and
    stays, since a stage's rows are only made after it has returned; results don't depend on it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


#: What a worker process holds for an operator, by the operator's name: how to let go of it.
_held: dict[str, Callable[[], None]] = {}


def hold(name: str, drop: Callable[[], None]) -> None:
    """Notes that this worker holds caches for an operator, which ``drop`` empties."""
    _held[name] = drop


def sole(name: str) -> None:
    """Has this worker let go of what it holds for other operators, and give the memory back.

    Spark's workers live on from stage to stage, so the caches of all operators of a pipeline would else add up in them.
    """
    others = [n for n in _held if n != name]
    for n in others:
        _held.pop(n)()
    if others:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text is divisible by HOLD_OUT_MOD; rows without an id are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HOLD_OUT_MOD == 0, F.lit(True))


def hash_fraction(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys' values alone, the same on every run and partitioning."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / F.lit(float(1 << 30))


def strings(column: pa.Array) -> Iterator[str | None]:
    """The values one by one, so that only one decoded text is held at a time."""
    for value in column:
        yield value.as_py()


def sorted_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Groups of equal keys (the first ``n_keys`` integer columns) of batches that come sorted by these keys.

    Yields the key and the other columns' values of one group at a time; a group may span batches.
    """
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
        changed = np.zeros(len(columns[0]) - 1, dtype=bool)
        for c in columns[:n_keys]:
            changed |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(changed) + 1).tolist()]
        for a, b in zip(starts, starts[1:]):
            yield tuple(int(c[a]) for c in columns[:n_keys]), [c[a:b] for c in columns[n_keys:]]
        held = [c[starts[-1]:] for c in columns]
    if held is not None:
        yield tuple(int(c[0]) for c in held[:n_keys]), held[n_keys:]
