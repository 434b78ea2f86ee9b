"""Text functions with Python's meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.strip() takes for white space. The code points with that property.
SPACES = [(0x9, 0xD), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
CLASS = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in SPACES) + "]"
BREAK = "\r\n|\r|\n"


def strip(text: Column) -> Column:
    """Without white space at both ends, as str.strip() does it. Only the ends are looked at."""
    return F.trim(text, F.lit("".join(chr(p) for a, b in SPACES for p in range(a, b + 1))))


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{CLASS}+|{CLASS}+$', '', 'g')"


def lines(text: Column) -> Column:
    """The lines of a text, broken at line feeds, carriage returns or both."""
    return F.split(text, BREAK)


def charset(word: Column) -> Column:
    """The distinct code points of a word, in the order of their first places."""
    return F.array_distinct(F.filter(F.split(word, ""), lambda c: c != ""))


def has_suffix(name: Column, suffixes: list[str]) -> Column:
    """Whether a name ends with one of the suffixes, whatever its case."""
    found = F.lit(False)
    for s in suffixes:
        found = found | F.lower(name).endswith(s)
    return found
