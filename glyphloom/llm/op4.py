"""op4_sentencepiece_codec: every text encoded, decoded again and compared.

Parity with the SentencePiece library is checked by the same query for every distinct unit that is encoded, which is
parity for the whole texts, since no token crosses a unit's start.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm import sentencepiece_codec as C
from glyphloom.llm.common import read_table, strings


#: Units in a generation of the cache: this query has its workers to itself.
UNITS = 120_000


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece_codec(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or model_path()

    @F.arrow_udf("n_tokens bigint, ids_crc32 bigint, decoded_chars bigint, round_trip boolean, parity boolean")
    def run(column: pa.Array) -> pa.Array:
        c = C.codec(path, verify=True, generation=UNITS)
        texts = list(strings(column))
        rows = []
        for t, ids in zip(texts, c.encode(texts), strict=True):
            back = c.decode(ids)
            rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(back), back == (t or ""), c.verified(t)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], ["n_tokens", "ids_crc32", "decoded_chars", "round_trip", "parity"])

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", run(F.col("text")).alias("_e")).select("doc_id", "_e.*")
