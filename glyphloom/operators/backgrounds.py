"""Where a crop of a background is taken: up to ten drawn attempts, the first that fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.functions import draws

ATTEMPTS = 10
#: Backgrounds whose sizes are put into the plan as an array; those of more meet the attempts in a join.
IN_PLAN = 4096


def crop_plan(tasks: DataFrame, backgrounds: DataFrame, seed: int, attempts: int = ATTEMPTS, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """``tasks`` with ``bg_idx``, ``x``, ``y`` of the crop; all null where no attempt fits (a white crop).

    ``backgrounds`` has ``bg_idx`` from 0 without holes, ``width`` and ``height``; ``tasks`` have ``keys``, ``w``, ``h``. An attempt
    draws a background and, if it is large enough, a place; each task's attempts are judged within its row.
    """
    n = backgrounds.count()
    drawn = F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), lambda a: F.struct(a.alias("attempt"), F.floor(draws.uniform(seed, "bg", *keys, a) * n).cast("int").alias("bg_idx")))

    def place(bg_idx, width, height, attempt):
        x, y = (draws.integer(F.lit(0), whole - F.col(own), seed, name, *keys, attempt) for name, whole, own in (("x", width, "w"), ("y", height, "h")))
        return F.struct(bg_idx.alias("bg_idx"), x.alias("x"), y.alias("y"))

    if not n:
        none = F.lit(None).cast("int")
        return tasks.withColumns({"bg_idx": none, "x": none, "y": none})
    if n <= IN_PLAN:
        sizes = [(r["width"], r["height"]) for r in backgrounds.sort("bg_idx").select("width", "height").collect()]
        widths, heights = (F.array(*(F.lit(s[k]) for s in sizes)) for k in (0, 1))
        of = lambda t: (F.get(widths, t["bg_idx"]), F.get(heights, t["bg_idx"]))
        fits = F.get(F.filter(drawn, lambda t: (F.col("w") <= of(t)[0]) & (F.col("h") <= of(t)[1])), F.lit(0))
        found = tasks.withColumn("_t", fits).withColumn("_c", F.when(F.col("_t").isNotNull(), place(F.col("_t.bg_idx"), *of(F.col("_t")), F.col("_t.attempt"))))
    else:
        tries = tasks.select(*keys, "w", "h", F.explode(drawn).alias("_t")).select(*keys, "w", "h", "_t.*")
        fits = tries.join(backgrounds.select("bg_idx", "width", "height"), "bg_idx").where("w <= width and h <= height")
        first = fits.withColumn("_c", place(F.col("bg_idx"), F.col("width"), F.col("height"), F.col("attempt"))).groupBy(*keys).agg(F.min_by("_c", "attempt").alias("_c"))
        found = tasks.join(first, list(keys), "left")
    return found.select(*tasks.columns, "_c.bg_idx", "_c.x", "_c.y")
