"""Fonts and backgrounds: files of a folder, by suffix, not of folders within it."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.functions.text import has_suffix

FONTS, PICTURES = [".ttf", ".otf"], [".jpg", ".jpeg", ".png"]


def files(spark: SparkSession, folder: str, suffixes: list[str]) -> DataFrame:
    """``path``, ``length`` and ``content`` of the folder's files with one of the suffixes, in either case."""
    found = spark.read.format("binaryFile").load(folder)
    return found.where(has_suffix(F.col("path"), suffixes)).select("path", "length", "content")


def fonts(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder, FONTS).withColumnRenamed("path", "font_path")


def _characters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from glyphloom.raster.ttf import Font, FontError

    for batch in batches:
        rows = []
        for path, content in zip(batch["font_path"], batch["content"], strict=True):
            try:
                rows.append((path, Font(bytes(content)).characters(), None))
            except FontError as e:
                rows.append((path, [], str(e)))
        yield pd.DataFrame(rows, columns=["font_path", "chars", "error"])


def font_support(fonts: DataFrame) -> DataFrame:
    """``font_path``, ``chars`` and ``error``; a font that can't be read has no characters."""
    return fonts.select("font_path", "content").mapInPandas(_characters, "font_path string, chars array<string>, error string")


def font_chars(support: DataFrame) -> DataFrame:
    """The same as distinct rows of ``font_path`` and ``ch``."""
    return support.select("font_path", F.explode(F.array_distinct("chars")).alias("ch"))


def backgrounds(spark: SparkSession, folder: str | None) -> DataFrame:
    """``bg_idx``, ``path``, ``width``, ``height``, ``channels`` and ``content`` (decoded pixels) in the order of paths.

    Spark's image source decodes them on the JVM, JPEG and every kind of PNG alike. What can't be decoded has size 0: it takes up
    the attempts that draw it and is never used. Without pictures there is a warning, and crops are white.
    """
    schema = "bg_idx int, path string, width int, height int, channels int, content binary"
    rows = None
    if folder is not None:
        found = spark.read.format("image").load(folder).select("image.*").where(has_suffix(F.col("origin"), PICTURES))
        size = lambda c: F.greatest(F.lit(0), F.col(c)).alias(c)
        rows = found.select(F.col("origin").alias("path"), size("width"), size("height"), F.col("nChannels").alias("channels"), F.col("data").alias("content"))
    if rows is None or rows.isEmpty():
        warnings.warn("there are no background pictures: white ones are used", stacklevel=2)
        return spark.createDataFrame([], schema)
    # Numbers follow the paths alone, of which there are as many as pictures.
    paths = rows.select("path").sort("path").coalesce(1).select("path", F.monotonically_increasing_id().cast("int").alias("bg_idx"))
    return rows.join(paths, "path").select("bg_idx", "path", "width", "height", "channels", "content")
