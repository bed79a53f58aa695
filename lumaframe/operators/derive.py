"""Renditions and gains of long frames, and what joins an image's numbers to its rows.

Deriving planes, reconstructing and measuring work on tiles; see ``tiles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import is_finite, luma, positive, srgb8_to_linear, tone_map
from ..functions.gain import OFFSET, log2_gain
from .written import materialize


#: Images up to which their numbers are broadcast to the pixels.
MOST_BROADCAST = 1_000_000


def attach(rows: DataFrame, per_image: DataFrame, key: str = "image_id") -> DataFrame:
    """Add an image's numbers to its rows.

    They are written first, so that the pass over the pixels that gives them is made once,
    and counted there: as many images as ``MOST_BROADCAST`` go to the rows where those
    are, so that an image larger than all others stays spread over tasks. Beyond that both
    sides are sorted, and adaptive execution splits images that are too large.
    """
    known = materialize(per_image, "per_image")
    small = known.count() <= MOST_BROADCAST
    return rows.join(F.broadcast(known) if small else known.hint("merge"), key)


def with_white(px: DataFrame) -> DataFrame:
    """Add ``white``: the greatest luma of the image, at least 1."""
    top = px.groupBy("image_id").agg(F.greatest(F.max(positive(luma(*map(F.col, "rgb")))), F.lit(1.0)).alias("white"))
    return attach(px, top)


def with_base(px: DataFrame, white: Column | None) -> DataFrame:
    """Add the SDR rendition's codes br, bg, bb."""
    codes = tone_map(*map(F.col, "rgb"), white)
    return px.select("*", *(c.alias(n) for c, n in zip(codes, ("br", "bg", "bb"))))


def with_gain(px: DataFrame) -> DataFrame:
    """Add ``gain``: stops from the base's luma to the pixel's."""
    base = luma(*(srgb8_to_linear(F.col(c)) for c in ("br", "bg", "bb")))
    return px.withColumn("gain", log2_gain(positive(luma(*map(F.col, "rgb"))), base))


def gain_range(px: DataFrame) -> DataFrame:
    """image_id, min_log2, max_log2 over finite samples; 0 and 0 without any."""
    g = F.when(is_finite(F.col("gain")), F.col("gain"))
    return px.groupBy("image_id").agg(F.coalesce(F.min(g), F.lit(0.0)).alias("min_log2"), F.coalesce(F.max(g), F.lit(0.0)).alias("max_log2"))


def consistent_meta(ranges: DataFrame, gamma: float = 1.0, offset: float = OFFSET) -> DataFrame:
    """The metadata row of each image; headroom is the range's top, never negative."""
    return ranges.select("image_id", "min_log2", "max_log2", F.lit(gamma).alias("gamma"), F.lit(offset).alias("base_offset"), F.lit(offset).alias("alt_offset"), F.lit(0.0).alias("base_headroom"), F.greatest("max_log2", F.lit(0.0)).alias("alt_headroom"))
