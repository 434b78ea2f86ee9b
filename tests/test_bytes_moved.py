"""What queries over the splits move and write, against the size of their texts."""

import random

import pytest

from glyphloom.plans.queries import QUERIES, SQL
from glyphloom.sources import wordlist
from tests.compare import same, tables


def moved(spark) -> int:
    """Bytes shuffled, spilled and written by all stages so far."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gateway = context._gateway
    stages = context._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in (stages.apply(k) for k in range(stages.size())))


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    """A table of 60,000 lines that don't compress, and its bytes."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder, rnd = tmp_path_factory.mktemp("lines"), random.Random(5)
    texts = ["\n".join(rnd.randbytes(96).hex() for _ in range(60)) for _ in range(1000)]
    pq.write_table(pa.table({"doc_id": pa.array([None, *range(999)], pa.int64()), "text": texts}), folder / "documents.parquet")
    return str(folder), sum(map(len, texts))


def most(spark, lines, tmp_path, name: str, times: float) -> None:
    folder, size = lines
    before = moved(spark)
    QUERIES[name](spark, folder).write.parquet(str(tmp_path / "out"))
    assert moved(spark) - before < times * size


def test_split_dedupe_mode(spark, lines, tmp_path):
    most(spark, lines, tmp_path, "split_dedupe_mode", 3)
    assert same(QUERIES["split_dedupe_mode"](spark, lines[0]), tables(lines[0]), SQL["split_dedupe_mode"])


def test_split_manifest(spark, lines, tmp_path):
    most(spark, lines, tmp_path, "split_manifest", 7)
    assert same(QUERIES["split_manifest"](spark, lines[0]), tables(lines[0]), SQL["split_manifest"])


def test_label_map_sizes(spark, lines, tmp_path):
    most(spark, lines, tmp_path, "label_map_sizes", 7)


def test_label_manifest(spark, lines, tmp_path):
    most(spark, lines, tmp_path, "label_manifest", 7)


def test_progress_running(spark, lines, tmp_path):
    most(spark, lines, tmp_path, "progress_running", 5)


def test_run_summary(spark, lines, tmp_path):
    most(spark, lines, tmp_path, "run_summary", 5)


@pytest.mark.parametrize("num", [1, 7, 29, 30, 1000])
def test_first_words(spark, num):
    """The same numbers as over the whole list; keys that are null or repeated included."""
    rnd = random.Random(num)
    rows = [(None if k % 10 == 0 else rnd.randint(-3, 3), f"a{k}\n\n b{k} \r\nc{k}" if k % 4 else " \n") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    own, n = wordlist.first_words(docs, "doc_id", num)
    key = {w: (x is not None, x or 0, pos) for x, t in rows for pos, w in enumerate(map(str.strip, t.replace("\r\n", "\n").split("\n"))) if w}
    assert n == len(key) == 90
    found = own.sort("i").collect()
    assert [r.i for r in found] == list(range(min(num, n)))
    assert [key[r.word] for r in found] == sorted(key.values())[:num]
