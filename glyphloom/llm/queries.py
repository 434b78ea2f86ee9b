"""The subpackage's queries and their SQL, for the entry module to add."""

from __future__ import annotations

from glyphloom.llm.op1 import op1_simhash_near_dedup
from glyphloom.llm.op2 import op2_token_files
from glyphloom.llm.op3 import op3_media_columns
from glyphloom.llm.op4 import op4_sentencepiece_codec
from glyphloom.llm.op5 import op5_licence_scan
from glyphloom.llm.op6 import op6_toxicity
from glyphloom.llm.op7 import op7_source_mixing
from glyphloom.llm.op8 import op8_secret_scan
from glyphloom.llm.op9 import SQL as SQL9
from glyphloom.llm.op9 import op9_quality_rules
from glyphloom.llm.op10 import op10_language_id

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_token_files": op2_token_files,
    "op3_media_columns": op3_media_columns,
    "op4_sentencepiece_codec": op4_sentencepiece_codec,
    "op5_licence_scan": op5_licence_scan,
    "op6_toxicity": op6_toxicity,
    "op7_source_mixing": op7_source_mixing,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
}

SQL = {
    "op9_quality_rules": SQL9,
}
