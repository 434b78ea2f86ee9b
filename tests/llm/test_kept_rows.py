import pytest

from glyphloom.llm import near_copies, simhash

A, B, C, D = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
ROWS = [(1, A), (2, B), (2, C), (3, C), (1, B), (4, D), (4, D), (None, "n o n e 1 2"), (None, "n o n e 1 2"), (None, "other words without any id"), (None, A)]


@pytest.mark.parametrize("keep", [simhash.keep_one, near_copies.keep_one])
def test_one_row_of_each_group(spark, keep):
    """Repeated ids with different texts and rows without an id: the rows that were judged stay, one of each group."""
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    kept = sorted(((r.doc_id, r.text) for r in keep(docs).collect()), key=str)
    assert kept == sorted([(1, A), (1, B), (2, C), (4, D), (None, "n o n e 1 2"), (None, "other words without any id")], key=str)
