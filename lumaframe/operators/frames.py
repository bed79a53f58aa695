"""Frames of images in linear light: tiles (see ``tiles``), and long frames with a row a
pixel (image_id, y, x, r, g, b) for work that is relational in pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tiles import BAND, SCHEMA

SIDE = 8


def _embedding_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, r, g, b: three vectors of the embeddings table are the channels of an
    8 x 8 image, and |v| * 8 is linear light. A channel that is missing is black."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / 3).alias("image_id"), (F.col("vec_id") % 3).alias("channel"), "embedding")
    planes = v.groupBy("image_id").agg(*(F.max(F.when(F.col("channel") == i, F.col("embedding"))).alias(c) for i, c in enumerate("rgb")))
    dark = F.array_repeat(F.lit(0.0).cast("float"), SIDE * SIDE)
    light = lambda v: F.abs(F.coalesce(v, F.lit(0.0)).cast("double")) * 8
    return planes.select("image_id", *(F.transform(F.coalesce(c, dark), light).alias(c) for c in "rgb"))


def embedding_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding images, a row a pixel."""
    px = _embedding_planes(spark, sf_dir).select("image_id", F.posexplode(F.arrays_zip(*"rgb")).alias("i", "p"))
    return px.select("image_id", F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).cast("int").alias("x"), "p.r", "p.g", "p.b")


def embedding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding images as tiles, one each."""
    side = F.lit(SIDE)
    return _embedding_planes(spark, sf_dir).select("image_id", F.lit(0).alias("y0"), side.alias("height"), side.alias("width"), *"rgb")


def wide_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineitem table as a stream of pixels: image l_suppkey, three numbers as light."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(F.col("l_suppkey").alias("image_id"), (F.col("l_quantity") / 10).alias("r"), (F.col("l_extendedprice") / 20000).alias("g"), (F.col("l_discount") * 20).alias("b"))


def scene(spark: SparkSession, width: int, height: int, peak: float, image_id: int = 0) -> DataFrame:
    """Tiles of a synthetic HDR image: gradients, three soft discs, a saturated red disc, a
    black patch and one pixel pinned at ``peak``. Bands are made where they are worked on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for band in b["id"].to_pylist():
                y0 = band * BAND
                rows = min(BAND, height - y0)
                v, u = (np.arange(y0, y0 + rows)[:, None] + 0.5) / height, (np.arange(width)[None, :] + 0.5) / width

                def disc(cx: float, cy: float, radius: float) -> np.ndarray:
                    near = (u - cx) ** 2 + (v - cy) ** 2
                    return np.where(near < radius * radius, np.cos(np.sqrt(near) / radius * 1.5707963267948966) ** 2, 0.0)

                light = peak * (disc(0.25, 0.3, 0.12) + 0.5 * disc(0.5, 0.6, 0.15) + 0.25 * disc(0.8, 0.4, 0.1))
                base = (0.05 + 0.7 * u + light + 0.5 * peak * disc(0.7, 0.8, 0.1), 0.05 + 0.7 * v + light, 0.05 + 0.35 * (u + v) + light)
                planes = [np.where((u < 0.1) & (v > 0.9), 0.0, c) for c in base]
                if y0 == 0:
                    for c in planes:
                        c[0, 0] = peak
                yield pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in ((image_id, pa.int64()), (y0, pa.int32()), (rows, pa.int32()), (width, pa.int32()))), *(pa.array([c.astype("<f8").tobytes()], pa.binary()) for c in planes)], ["image_id", "y0", "height", "width", *"rgb"])

    return spark.range(-(-height // BAND)).mapInArrow(run, SCHEMA)


def aligned(one: DataFrame, two: DataFrame) -> DataFrame:
    """Pixels of two frames of the same images side by side; columns of the second end in 2.
    Both are keyed by image and place, so the join needs one exchange of each at most."""
    keys = ["image_id", "y", "x"]
    return one.join(two.select(*keys, *(F.col(c).alias(f"{c}2") for c in two.columns if c not in keys)), keys)
