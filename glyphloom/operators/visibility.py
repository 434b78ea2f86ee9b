"""Alpha and colour rules over pixels, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHA_OVER = 20
LEAST_RATIO = 0.02


def ratio(alpha: Column, over: int = ALPHA_OVER) -> Column:
    """The share of pixels (aggregated rows) whose alpha is over the threshold."""
    return F.count_if(alpha > over) / F.count("*")


def visible(share: Column, least: float = LEAST_RATIO) -> Column:
    return share >= F.lit(least)


def matched(channel: Column, factor: Column) -> Column:
    """The mean of a channel, darkened, cut to a whole number."""
    return F.floor(F.avg(channel) * factor).cast("int")


def over(source: Column, alpha: Column, below: Column) -> Column:
    """A channel drawn over another with an alpha from 0 to 255, rounded to the nearest whole number."""
    return F.floor((source * alpha + below * (255 - alpha) + 127) / 255).cast("int")
