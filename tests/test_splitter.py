import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from glyphloom.operators import fonts, splitter
from glyphloom.plans.queries import QUERIES
from glyphloom.sources import sinks, wordlist


def words(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i long, word string")


@pytest.mark.parametrize(("n", "p"), [(7, 0.0), (7, 1.0), (20, 0.07), (3, 0.5), (12, 0.2)])
def test_post_conditions(spark, n, p):
    values = ["a", "b", "b", "c d", "é", "😀"]
    rows = splitter.split_words(words(spark, values), n, p, seed=3).collect()
    train, val = splitter.sizes(n, p)
    assert val == math.ceil(n * p)
    by = {s: sorted((r for r in rows if r.split == s), key=lambda r: r.idx) for s in splitter.SPLITS}
    for s in splitter.SPLITS:
        assert {r.word for r in by[s]} == set(values)
        assert [r.idx for r in by[s]] == list(range(len(by[s])))
    slices = [r.word for r in by["train"][:train]] + [r.word for r in by["val"][:val]]
    assert Counter(slices) == Counter(values[k % len(values)] for k in range(n))


def test_same_on_any_number_of_partitions(spark):
    values = [f"w{k % 37}" for k in range(200)]
    made = []
    for parts in (1, 3, 8):
        rows = splitter.split_words(words(spark, values).repartition(parts), 150, 0.3, seed=9)
        made.append(sorted(map(tuple, rows.collect())))
    assert made[0] == made[1] == made[2]


def test_empty_list(spark):
    with pytest.raises(ValueError):
        splitter.cyclic_extend(words(spark, []), 3)
    assert splitter.cyclic_extend(words(spark, []), 0).count() == 0


def test_dedupe(spark):
    rows = splitter.split_words(words(spark, ["a", "a", "b"]), 9, 0.4, dedupe=True).collect()
    assert sorted((r.split, r.word) for r in rows) == [("train", "a"), ("train", "b"), ("val", "a"), ("val", "b")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \t 　\r\n\x1c​😀", max_size=12), max_size=5))
def test_words_as_python_reads_them(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [r.word for r in wordlist.words_of(docs, ["doc_id"]).sort("i").collect()]
    wanted = []
    for t in texts:
        lines = t.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        wanted += [line.strip() for line in lines if line.strip()]
    assert found == wanted


def test_read_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿one\r\n two \n\n　\nthree\rtwo".encode())
    assert [r.word for r in wordlist.read(spark, str(tmp_path)).sort("i").collect()] == ["﻿one", "two", "three", "two"]
    assert [r.word for r in wordlist.read(spark, str(tmp_path), strip_bom=True).sort("i").collect()] == ["one", "two", "three", "two"]


def test_one_rule_for_all_sizes(spark, tmp_path):
    """Files of many blocks are read as small ones are: marks and lone carriage returns included."""
    (tmp_path / "a.txt").write_bytes(("\ufeff first\r\n" + "".join(f"line {k}\rrest {k}\n" for k in range(3000))).encode())
    (tmp_path / "b.txt").write_bytes("\ufeff\n\nlast".encode())
    wanted = ["\ufeff first", *(x for k in range(3000) for x in (f"line {k}", f"rest {k}")), "\ufeff", "last"]
    for block in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        try:
            assert [r.word for r in wordlist.read(spark, str(tmp_path)).sort("i").collect()] == wanted
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_names_grow(spark):
    rows = splitter.manifest(spark.createDataFrame([("train", 99999), ("train", 100000)], "split string, idx long"), "o").sort("idx").collect()
    assert [r.filename for r in rows] == ["99999.png", "100000.png"]
    assert rows[0].save_path == "o/train/images/99999.png"


def test_many_fonts(spark):
    """More fonts than bits in a number, against sets."""
    rnd = random.Random(0)
    own = {f"f{k:03}.ttf": {c for c in "abcdefgh é😀" if rnd.random() < 0.8} for k in range(150)} | {"none.ttf": set()}
    rows = [(p, c) for p, chars in own.items() for c in sorted(chars)]
    words = spark.createDataFrame([("".join(rnd.choice("abcdefgh é😀") for _ in range(rnd.randint(1, 5))),) for _ in range(60)] + [("zzz",)], "word string")
    found = fonts.candidates(words, spark.createDataFrame(rows, "font_path string, ch string")).collect()
    assert {r.word for r in found} == {r.word for r in words.collect()}
    assert all(r.candidates == sorted(p for p, chars in own.items() if set(r.word) <= chars) for r in found)
    assert {r.candidates == [] for r in fonts.candidates(words, spark.createDataFrame([], "font_path string, ch string")).collect()} == {True}


def test_progress_blocks(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("IF(id % 3 = 0, 'val', 'train') AS split", "id DIV 3 AS idx", "id % 7 <> 0 AS success")
    made = []
    for block in (4096, 2):
        monkeypatch.setattr(sinks, "BLOCK", block)
        made.append(sorted(map(tuple, sinks.progress(rows, 10).collect())))
    assert made[0] == made[1] and made[0][-1][1] == 334


@pytest.mark.parametrize("name", ["font_unsupported", "font_match_division"])
def test_no_rows_of_characters(spark, sf, name):
    """Words are matched where they lie: no set of characters is made, dealt out or joined."""
    made = QUERIES[name](spark, sf)
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "array_distinct" not in final and "Join" not in final
    assert final.count("Exchange hashpartitioning") == 1


def test_cover(monkeypatch):
    """Against sets, for more fonts than bits in a number, words longer than a step, empty words, nulls and bytes that aren't UTF-8."""
    rnd = random.Random(1)
    own = [{c for c in "abcd é😀\0" if rnd.random() < 0.9} for _ in range(70)]
    chars = sorted(set().union(*own))
    masks = [[sum((c in own[64 * b + k]) << k for k in range(min(64, 70 - 64 * b))) for b in range(2)] for c in chars]
    cover = fonts.Cover(chars, np.array(masks, np.uint64).astype(np.int64))
    words = ["", None, "a", "x", "aé😀", "abcd é😀" * 3, "", *("".join(rnd.choice("abcd é😀\0") for _ in range(rnd.randint(0, 9))) for _ in range(200)), ""]
    wanted = [[bool(w) and set(w) <= f for f in own] for w in words]
    for step in (1, 7, 1 << 20):
        monkeypatch.setattr(fonts, "LOOKED_UP", step)
        found = cover.of(pa.array(words, pa.string()))
        assert [[bool(int(r[k // 64]) >> (k % 64) & 1) for k in range(70)] for r in found] == wanted
    raw = pa.array([b"a", b"a\xff", b"\xf0\x9f", b"a"], pa.binary())
    odd = cover.of(pa.StringArray.from_buffers(4, raw.buffers()[1], raw.buffers()[2]))
    assert odd[0].any() and (odd[0] == odd[3]).all() and not odd[1:3].any()
