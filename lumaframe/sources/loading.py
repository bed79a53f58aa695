"""Images of any input format as tiles of linear light, or as 8-bit codes.

The suffix says how a file is read and its sample format what the samples mean: float
TIFF is linear, 16-bit TIFF is PQ against a reference white, 8-bit TIFF, PNG and JPEG are
sRGB without headroom. TIFF is read by arrays, PNG and JPEG by Spark's own image source in
the JVM. What cannot be read is one row with its error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.color import PQ
from ..operators.tiles import BAND, SCHEMA
from . import images
from .files import binary_files, parsed, pattern_of

REFERENCE_WHITE = 203.0
TIFF, PICTURES = ("tif", "tiff"), ("png", "jpg", "jpeg")
_TILE = SCHEMA.replace("image_id long, ", "")
_CODES = "y0 int, height int, width int, base binary"


def pq_to_linear(x: np.ndarray, reference_white: float) -> np.ndarray:
    """SMPTE ST 2084 signals in 0..1, as multiples of the reference white."""
    v = x ** (1 / PQ["m2"])
    return PQ["peak"] * (np.maximum(v - PQ["c1"], 0) / (PQ["c2"] - PQ["c3"] * v)) ** (1 / PQ["m1"]) / reference_white


def linear_of(samples: np.ndarray, reference_white: float = REFERENCE_WHITE) -> np.ndarray:
    """Linear light of samples by their kind; integer ones by a table of all codes."""
    if samples.dtype.kind == "f":
        return np.maximum(samples.astype(np.float64), 0.0)
    if samples.dtype.itemsize == 2:
        return pq_to_linear(np.arange(65536) / 65535.0, reference_white)[samples]
    return K.LINEAR[samples]


def codes_of(samples: np.ndarray) -> np.ndarray:
    """8-bit codes of samples of any kind."""
    if samples.dtype.kind == "f":
        return K.codes(K.clamp(samples.astype(np.float64)))
    if samples.dtype.itemsize == 2:
        return ((samples.astype(np.uint32) * 255 + 32767) // 65535).astype(np.uint8)
    return samples


def _tiff(d: bytes) -> np.ndarray:
    found = images.samples(d, images.tags_of(d, "ifd0"), images.byte_order(d))
    return found.astype(found.dtype.newbyteorder("="))


def _light_bands(samples: np.ndarray, reference_white: float) -> Iterator[tuple]:
    for y0 in range(0, len(samples), BAND):
        band = linear_of(samples[y0 : y0 + BAND], reference_white)
        yield y0, len(band), band.shape[1], *(c.astype("<f8").tobytes() for c in band.reshape(-1, 3).T)


def _code_bands(samples: np.ndarray) -> Iterator[tuple]:
    for y0 in range(0, len(samples), BAND):
        band = codes_of(samples[y0 : y0 + BAND])
        yield y0, len(band), band.shape[1], band.tobytes()


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select(F.xxhash64("path").alias("image_id"), *rows.columns)


def tiff_light(files: DataFrame, reference_white: float = REFERENCE_WHITE) -> DataFrame:
    """image_id, path, tile columns, error of TIFF files (path, content)."""
    return _keyed(parsed(files, lambda d: _light_bands(_tiff(d), reference_white), _TILE))


def _pictures(spark: SparkSession, paths: list[str], bands: Callable[[np.ndarray], Iterator[tuple]], schema: str) -> DataFrame:
    """PNG and JPEG files by the image source, whose samples are blue, green, red."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, h, w, n, data in zip(*(b[c].to_pylist() for c in ("path", "height", "width", "n", "data"))):
                if h is None or h < 0:
                    yield pa.RecordBatch.from_pylist([{"path": path, **dict.fromkeys(names), "error": "ValueError: not an image"}], schema=arrow)
                    continue
                samples = np.frombuffer(data, np.uint8).reshape(h, w, n)
                samples = np.repeat(samples, 3, axis=2) if n == 1 else samples[:, :, 2::-1]
                for band in bands(samples):
                    yield pa.RecordBatch.from_pylist([{"path": path, **dict(zip(names, band)), "error": None}], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = _parse_datatype_string(f"path string, {schema}, error string")
    arrow = to_arrow_schema(out)
    read = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", pattern_of(PICTURES)).load(paths)
    return _keyed(read.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("n"), "image.data").mapInArrow(run, out))


def _load(spark: SparkSession, paths: list[str], tiff: Callable[[np.ndarray], Iterator[tuple]], schema: str) -> DataFrame:
    files = binary_files(spark, paths)
    kind = suffix(F.col("path"))
    out = _keyed(parsed(files.where(kind.isin(*TIFF)), lambda d: tiff(_tiff(d)), schema))
    if not files.where(kind.isin(*PICTURES)).select("path").isEmpty():
        out = out.unionByName(_pictures(spark, paths, tiff, schema))
    other = files.where(~kind.isin(*TIFF, *PICTURES)).select("path", F.concat(F.lit("UnsupportedInput: ."), kind).alias("error"))
    return out.unionByName(other.select(F.xxhash64("path").alias("image_id"), "path", "error"), allowMissingColumns=True)


def load_hdr(spark: SparkSession, paths: list[str], reference_white: float = REFERENCE_WHITE) -> DataFrame:
    """image_id (a hash of the path), path, tile columns and error of files and folders."""
    return _load(spark, paths, lambda s: _light_bands(s, reference_white), _TILE)


def load_sdr(spark: SparkSession, paths: list[str]) -> DataFrame:
    """image_id, path, y0, height, width, base (RGB bytes) and error of files and folders."""
    return _load(spark, paths, _code_bands, _CODES)
