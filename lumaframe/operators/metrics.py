"""Image statistics: histogram percentiles and signal to noise.

Histogram quantiles are exact about their buckets: counts per (image, bucket) combine
on the map side, and the running sum over at most a thousand buckets an image is the
only window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import EPS, luma, positive

#: Buckets and span, in stops, of the peak histogram.
PEAK_BUCKETS, PEAK_SPAN = 1024, 8.0


def peak_luma(px: DataFrame, fraction: float = 0.001) -> DataFrame:
    """image_id, peak: luma below the brightest ``fraction`` of pixels, as the lower edge
    of its log2 bucket, at least 1."""
    top = PEAK_BUCKETS - 1
    stops = F.log2(F.greatest(positive(luma(*map(F.col, "rgb"))), F.lit(EPS)))
    stops = F.greatest(F.lit(-PEAK_SPAN), F.least(F.lit(PEAK_SPAN), stops))
    # rounding first keeps exact powers of two on their edge whatever the last bit of log2
    bucket = F.floor(F.round((stops + PEAK_SPAN) / (2 * PEAK_SPAN) * top, 9)).cast("int")
    counts = px.select("image_id", bucket.alias("bucket")).groupBy("image_id", "bucket").agg(F.count("*").alias("n"))
    down = Window.partitionBy("image_id").orderBy(F.desc("bucket"))
    all_of = Window.partitionBy("image_id")
    run = counts.select("image_id", "bucket", F.sum("n").over(down).alias("seen"), F.sum("n").over(all_of).alias("all"))
    hit = run.where(F.col("seen") > F.floor(F.col("all") * fraction)).groupBy("image_id").agg(F.max("bucket").alias("bucket"))
    return hit.select("image_id", F.greatest(F.pow(F.lit(2.0), F.col("bucket") / float(top) * 2 * PEAK_SPAN - PEAK_SPAN), F.lit(1.0)).alias("peak"))


def first_bucket_at(counts: DataFrame, quantiles: dict[str, float], by: list[str], otherwise: int, *more: Column) -> DataFrame:
    """For each named quantile the first bucket whose running count reaches
    floor(n * q); ``more`` are further aggregates. ``counts``: by..., bucket, n. A target of zero is reached by bucket 0."""
    up = Window.partitionBy(*by).orderBy("bucket")
    all_of = Window.partitionBy(*by)
    run = counts.select(*by, "bucket", "n", F.sum("n").over(up).alias("seen"), F.sum("n").over(all_of).alias("all"))
    picked = [F.when(F.floor(F.max("all") * q) == 0, F.lit(0)).otherwise(F.coalesce(F.min(F.when(F.col("seen") >= F.floor(F.col("all") * q), F.col("bucket"))), F.lit(otherwise))).cast("int").alias(name) for name, q in quantiles.items()]
    return run.groupBy(*by).agg(*picked, *more)


def psnr(peak: Column, mse: Column) -> Column:
    """Decibels; infinite without error."""
    return F.when(mse <= 0, F.lit(float("inf"))).otherwise(20 * F.log10(peak / F.sqrt(F.when(mse > 0, mse).otherwise(1.0))))
