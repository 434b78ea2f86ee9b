"""Random draws as functions of a seed, the draw's name and the row's keys.

A draw is a number in [0, 1) made of the first eight hexadecimal digits of an MD5 digest. The same rows so get the same draws on
any number of partitions, after a retry, in Python and in SQL.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE = 4294967296.0


def digest(seed: int, name: str, *keys: Column | str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), *(k.cast("string") if isinstance(k, Column) else F.col(k).cast("string") for k in keys)).cast("binary"))


def uniform(seed: int, name: str, *keys: Column | str) -> Column:
    """A number in [0, 1)."""
    return F.conv(F.substring(digest(seed, name, *keys), 1, 8), 16, 10).cast("bigint") / F.lit(WHOLE)


def bernoulli(p: float, seed: int, name: str, *keys: Column | str) -> Column:
    """True with probability p: never for 0, always for 1."""
    return uniform(seed, name, *keys) < F.lit(float(p))


def between(a: float, b: float, seed: int, name: str, *keys: Column | str) -> Column:
    return F.lit(float(a)) + F.lit(float(b) - float(a)) * uniform(seed, name, *keys)


def integer(a: int | Column, b: int | Column, seed: int, name: str, *keys: Column | str) -> Column:
    """A whole number from a to b, both included."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    return (low + F.floor(uniform(seed, name, *keys) * (high - low + 1))).cast("int")


def choice(options: Column, seed: int, name: str, *keys: Column | str) -> Column:
    """One element of an array, which must be sorted for the choice to be reproducible; null of an empty one."""
    return F.get(options, F.floor(uniform(seed, name, *keys) * F.size(options)).cast("int"))


def value(seed: int, name: str, *keys: object) -> float:
    """The Python twin of ``uniform``."""
    text = ":".join([str(seed), name, *map(str, keys)])
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / WHOLE


def sql(seed: int, name: str, *keys: str) -> str:
    """The DuckDB twin of ``uniform``; keys are SQL expressions."""
    text = " || ':' || ".join([f"'{seed}:{name}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"(CAST(CAST('0x' || substr(md5({text}), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0)"
