"""A whole run: word list to splits, fonts, drawn images, manifest."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.config import GenerationConfig
from glyphloom.functions import draws
from glyphloom.operators import backgrounds as crops
from glyphloom.operators import fonts as font_ops
from glyphloom.operators import splitter
from glyphloom.sources import binary, sinks, wordlist
from glyphloom.storage import kept

#: Bytes of fonts, or of decoded backgrounds, that are sent to every executor; more are brought to their rows by a join.
MOST_SENT = 256 << 20
#: Rows of one font that one task draws where fonts come by a join.
FONT_ROWS = 20_000
RESULT = "split string, idx bigint, filename string, word string, success boolean, error string, width int, height int, png binary"
PLAN = "split string, idx bigint, filename string, word string, font_path string"
#: Rows whose text is drawn and whose crop isn't: the size and the packed alpha plane.
DRAWN = "split string, idx bigint, filename string, word string, error string, w int, h int, alpha binary"


def plan(rows: DataFrame, support: DataFrame, config: GenerationConfig) -> DataFrame:
    """The manifest with each row's font; rows whose word no font covers have none."""
    named = splitter.manifest(rows, config.output_dir)
    found = font_ops.candidates(named, binary.font_chars(support))
    return font_ops.chosen(named, found, config.seed, "split", "idx")


def draw_text(word: str, font: bytes, key: tuple, config: GenerationConfig, augmentations: tuple | None = None) -> np.ndarray:
    """The alpha plane of one image; every draw follows from the seed, the row's key and the attempt."""
    from glyphloom.raster import image, ttf

    chain = image.AugmentationPipeline(
        augmentations
        or (
            image.RandomRotate(config.rotation_range, config.rotation_prob),
            image.RandomBlur(config.blur_radius_range, config.blur_prob),
            image.RandomPerspective(config.perspective_margin, config.perspective_prob),
        )
    )
    low, high = config.font_size_range
    for attempt in range(config.max_attempts):
        draw = lambda name, attempt=attempt: draws.value(config.seed, name, *key, attempt)
        size = low + math.floor(draw("size") * (high - low + 1))
        alpha = chain(ttf.render(font, word, size, draw("bold") < config.bold_prob, config.padding), draw)
        if alpha.size and image.visible_ratio(alpha) >= 0.02:
            return alpha
    raise ValueError("no attempt gave a visible text")


def finish(alpha: np.ndarray, crop: np.ndarray | None, key: tuple, config: GenerationConfig) -> bytes:
    """The PNG of the text over its crop, white where there is none."""
    from glyphloom.raster import image

    if crop is None:
        crop = np.full((*alpha.shape, 3), 255, np.uint8)
    return image.png(image.compose(alpha, crop, 0.3 + 0.3 * draws.value(config.seed, "dark", *key)))


def _texts(font_of: Callable, config: GenerationConfig, augmentations: tuple | None):
    """Draws the texts of a batch of PLAN rows."""

    def drawn(batch: pd.DataFrame) -> pd.DataFrame:
        made = []
        for r in batch.itertuples(index=False):
            try:
                font = font_of(r)
                if font is None:
                    raise ValueError("no font covers the word")
                alpha = draw_text(r.word, font, (r.split, r.idx), config, augmentations)
                made.append((r.split, r.idx, r.filename, r.word, None, alpha.shape[1], alpha.shape[0], zlib.compress(alpha.tobytes(), 1)))
            except Exception as e:  # noqa: BLE001  a row that fails is reported and the run goes on
                made.append((r.split, r.idx, r.filename, r.word, str(e), None, None, None))
        return pd.DataFrame(made, columns=[c.split(" ")[0] for c in DRAWN.split(", ")]).astype({"w": "Int32", "h": "Int32"})

    return drawn


def texts(tasks: DataFrame, fonts: DataFrame, config: GenerationConfig, augmentations: tuple[Callable, ...] | None = None) -> DataFrame:
    """One row per task (PLAN) with its alpha plane or its error (DRAWN)."""
    context = tasks.sparkSession.sparkContext
    rows = tasks.select("split", "idx", "filename", "word", "font_path")
    parts = max(config.num_workers, context.defaultParallelism)
    if (fonts.agg(F.sum("length")).first()[0] or 0) <= MOST_SENT:
        sent = context.broadcast({r["font_path"]: bytes(r["content"]) for r in fonts.select("font_path", "content").collect()})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            drawn = _texts(lambda r: sent.value.get(r.font_path), config, augmentations)
            for batch in batches:
                for a in range(0, len(batch), 128):
                    yield drawn(batch.iloc[a : a + 128])

        return rows.repartition(parts, "split", "idx").mapInPandas(run, DRAWN)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        font = bytes(right["content"].iloc[0]) if len(right) else None
        return _texts(lambda _: font, config, augmentations)(left)

    # As many tasks for a font as its rows need; there is one row for each font.
    rows = rows.withColumn("font_path", F.coalesce("font_path", F.lit("")))
    salts = F.broadcast(rows.groupBy("font_path").agg(F.ceil(F.count("*") / FONT_ROWS).cast("int").alias("salts")))
    left = rows.join(salts, "font_path").withColumn("salt", F.pmod(F.xxhash64("split", "idx"), F.col("salts")).cast("int")).drop("salts")
    right = fonts.join(salts, "font_path").select("font_path", "content", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return left.groupBy("font_path", "salt").cogroup(right.groupBy("font_path", "salt")).applyInPandas(meet, DRAWN)


def _composed(config: GenerationConfig, picture_of: Callable):
    """Composes a batch of DRAWN rows with their crops' places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for a in range(0, len(whole), 128):
                made = []
                for r in whole.iloc[a : a + 128].itertuples(index=False):
                    if r.alpha is None:
                        made.append((r.split, r.idx, r.filename, r.word, False, r.error, None, None, None))
                        continue
                    w, h = int(r.w), int(r.h)
                    alpha = np.frombuffer(zlib.decompress(r.alpha), np.uint8).reshape(h, w)
                    crop = None if pd.isna(r.bg_idx) else picture_of(r)[int(r.y) : int(r.y) + h, int(r.x) : int(r.x) + w]
                    made.append((r.split, r.idx, r.filename, r.word, True, None, w, h, finish(alpha, crop, (r.split, r.idx), config)))
                yield pd.DataFrame(made, columns=[c.split(" ")[0] for c in RESULT.split(", ")]).astype({"width": "Int32", "height": "Int32"})

    return run


def render(tasks: DataFrame, fonts: DataFrame, config: GenerationConfig, backgrounds: DataFrame | None = None, augmentations: tuple[Callable, ...] | None = None) -> DataFrame:
    """One row per task (PLAN) with its PNG or its error.

    Texts are drawn first; their sizes are what Spark then plans the crops by, and pictures come to them by a broadcast or a join.
    """
    drawn = texts(tasks, fonts, config, augmentations)
    if backgrounds is None or backgrounds.isEmpty():
        none = F.lit(None).cast("int")
        return drawn.withColumns({"bg_idx": none, "x": none, "y": none}).mapInPandas(_composed(config, lambda r: None), RESULT)
    planned = crops.crop_plan(drawn, backgrounds, config.seed, keys=("split", "idx"))
    if (backgrounds.agg(F.sum(F.length("content"))).first()[0] or 0) <= MOST_SENT:
        found = backgrounds.select("bg_idx", "content", "width", "height", "channels").collect()
        sent = tasks.sparkSession.sparkContext.broadcast({r["bg_idx"]: (bytes(r["content"]), r["width"], r["height"], r["channels"]) for r in found})

        def picture(r) -> np.ndarray:
            from glyphloom.raster import image

            return image.pixels(*sent.value[int(r.bg_idx)])

        return planned.mapInPandas(_composed(config, picture), RESULT)

    def own(r) -> np.ndarray:
        from glyphloom.raster import image

        return image.pixels(r.content, int(r.width), int(r.height), int(r.channels))

    pictures = backgrounds.select("bg_idx", "content", "width", "height", "channels").hint("merge")
    return planned.join(pictures, "bg_idx", "left").mapInPandas(_composed(config, own), RESULT)


def generate(spark: SparkSession, config: GenerationConfig, augmentations: tuple[Callable, ...] | None = None, show: Callable[[str], None] | None = None) -> DataFrame:
    """The run of a configuration: results are stored, images and labels written; returns the summary by split.

    ``show`` gets lines with the rate of drawing and the time left.
    """
    words = kept(wordlist.read(spark, config.wordlist_path), "words")
    rows = kept(splitter.split_words(words, config.num_images, config.val_percent, config.seed), "rows")
    fonts = kept(binary.fonts(spark, config.font_dir), "fonts")
    tasks = plan(rows, binary.font_support(fonts), config)
    pictures = binary.backgrounds(spark, config.bg_image_dir)
    with sinks.Monitor(spark, rows.count(), show or (lambda line: None)):
        results = kept(render(tasks, fonts, config, pictures, augmentations), "results")
    sinks.write_images(results, config.output_dir)
    sinks.write_labels(results, config.output_dir)
    return sinks.summary(results)
