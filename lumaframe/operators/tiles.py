"""Images as tiles: one row for each band of rows of an image, channels as arrays.

A row a pixel costs more in row handling than in arithmetic. Here a task takes batches of
tiles as flat arrays, and what leaves it are arrays again, or one row for each tile:
extremes, sums, counts by bucket. Those combine on the map side, so that an image of any
size is spread over as many tasks as it has bands, and no row holds more than a band.

Frames of tiles: image_id, y0 (first row of the band), height, width, r, g, b (doubles, row
by row: as little-endian bytes, which are never taken apart between the JVM and here, or
as arrays). Bands are ``BAND`` rows, the last of an image may be lower;
``BAND`` is a multiple of the subsampling steps, so that blocks lie within a band.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.color import EPS
from .derive import attach

BAND = 48
PLACE = ("image_id", "y0", "height", "width")
_PLACE = "image_id long, y0 int, height int, width int"
SCHEMA = f"{_PLACE}, r binary, g binary, b binary"
#: A plane's tile: gh rows of gw codes from row gy0 on.
PLANE = "image_id long, y0 int, gy0 int, gh int, gw int, codes binary"
#: Buckets to an octave of errors and of light, by which ranks are looked for.
FINE = 64


class Lot:
    """The tiles of an Arrow batch, flat."""

    def __init__(self, b: pa.RecordBatch) -> None:
        self.b = b
        self.height, self.width = (b[c].to_numpy().astype(np.int64) for c in ("height", "width"))
        size = self.height * self.width
        self.size, self.first = size, np.cumsum(size) - size
        self.total = int(size.sum())

    def channel(self, name: str) -> np.ndarray:
        column = self.b[name]
        if not pa.types.is_binary(column.type):
            return column.flatten().to_numpy(zero_copy_only=False)
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view("<f8") if data else np.zeros(0)

    def rgb(self) -> tuple[np.ndarray, ...]:
        return tuple(self.channel(c) for c in "rgb")

    def spread(self, values: np.ndarray) -> np.ndarray:
        """A number of each tile, for each of its pixels."""
        return np.repeat(values, self.size)

    def column(self, name: str) -> np.ndarray:
        return self.spread(self.b[name].to_numpy())

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """y within the band, and x, of each pixel."""
        at = np.arange(self.total) - self.spread(self.first)
        width = self.spread(self.width)
        return at // width, at % width

    def least(self, x: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(x, self.first) if self.total else np.zeros(0)

    def most(self, x: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(x, self.first) if self.total else np.zeros(0)


def each(df: DataFrame, f: Callable[[Lot], dict[str, object]], schema: str) -> DataFrame:
    """``f`` over the tiles of every batch; it gives the columns of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = f(Lot(b))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()], list(out))

    return df.mapInArrow(run, schema)


def _places_of(t: Lot) -> dict[str, object]:
    return {c: t.b[c] for c in PLACE}


# ---- derivation -------------------------------------------------------------------------


def with_white(tiles: DataFrame) -> DataFrame:
    """Add ``white``: the greatest luma of the image, at least 1."""
    top = each(tiles, lambda t: {"image_id": t.b["image_id"], "top": t.most(K.positive(K.luma(*t.rgb())))}, "image_id long, top double")
    return attach(tiles, top.groupBy("image_id").agg(F.greatest(F.max("top"), F.lit(1.0)).alias("white")))


def _base(t: Lot) -> tuple[np.ndarray, ...]:
    """Codes of the SDR rendition, by extended Reinhard where the tiles have a white."""
    return K.tone_map(*t.rgb(), t.column("white") if "white" in t.b.schema.names else None)


def _gain(t: Lot) -> np.ndarray:
    """Stops from the rendition's luma to the pixel's."""
    return K.log2_gain(K.positive(K.luma(*t.rgb())), K.luma(*(K.LINEAR[c] for c in _base(t))))


def base_codes(tiles: DataFrame) -> DataFrame:
    """image_id, y0, height, width, base: the rendition, three bytes a pixel."""
    return each(tiles, lambda t: {**_places_of(t), "base": _interleaved(t, _base(t))}, f"{_PLACE}, base binary")


def _interleaved(t: Lot, planes: tuple[np.ndarray, ...]) -> pa.Array:
    data = np.stack(planes, axis=1).tobytes()
    return pa.array([data[3 * a : 3 * (a + n)] for a, n in zip(t.first.tolist(), t.size.tolist())], pa.binary())


def gain_range(tiles: DataFrame) -> DataFrame:
    """image_id, min_log2, max_log2 over finite samples; 0 and 0 without any."""

    def extremes(t: Lot) -> dict[str, object]:
        gain = _gain(t)
        finite = np.isfinite(gain)
        low, high = t.least(np.where(finite, gain, np.inf)), t.most(np.where(finite, gain, -np.inf))
        return {"image_id": t.b["image_id"], "low": pa.array(low, mask=np.isinf(low)), "high": pa.array(high, mask=np.isinf(high))}

    ends = each(tiles, extremes, "image_id long, low double, high double")
    return ends.groupBy("image_id").agg(F.coalesce(F.min("low"), F.lit(0.0)).alias("min_log2"), F.coalesce(F.max("high"), F.lit(0.0)).alias("max_log2"))


def gain_plane(tiles: DataFrame, ranges: DataFrame, subsample: int = 1, gamma: float = 1.0) -> DataFrame:
    """The plane's tiles (PLANE): block means of the normalised gain as codes. Blocks at
    the edge may be partial."""
    if BAND % subsample:
        raise ValueError(f"bands of {BAND} rows do not hold blocks of {subsample}")

    def plane(t: Lot) -> dict[str, object]:
        value = K.normalise(_gain(t), t.column("min_log2"), t.column("max_log2"), gamma)
        gh, gw = -(-t.height // subsample), -(-t.width // subsample)
        if subsample > 1:
            y, x = t.places()
            own = gh * gw
            block = t.spread(np.cumsum(own) - own) + y // subsample * t.spread(gw) + x // subsample
            value = np.bincount(block, value) / np.bincount(block)
        data = K.codes(K.clamp(value)).tobytes()
        ends = np.append(0, np.cumsum(gh * gw)).tolist()
        return {"image_id": t.b["image_id"], "y0": t.b["y0"], "gy0": (t.b["y0"].to_numpy() // subsample).astype(np.int32), "gh": gh.astype(np.int32), "gw": gw.astype(np.int32), "codes": pa.array([data[a:z] for a, z in zip(ends, ends[1:])], pa.binary())}

    return each(attach(tiles, ranges), plane, PLANE)


def plane_rows(planes: DataFrame) -> DataFrame:
    """image_id, gy, gx, code: one row for each code."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gh, gw, gy0 = (b[c].to_numpy().astype(np.int64) for c in ("gh", "gw", "gy0"))
            size = gh * gw
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            wide = np.repeat(gw, size)
            code = np.frombuffer(b"".join(b["codes"].to_pylist()), np.uint8).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b["image_id"].to_numpy(), size)), pa.array((np.repeat(gy0, size) + at // wide).astype(np.int32)), pa.array((at % wide).astype(np.int32)), pa.array(code)], ["image_id", "gy", "gx", "code"])

    return planes.mapInArrow(rows, "image_id long, gy int, gx int, code int")


def pixel_rows(tiles: DataFrame, f: Callable[[Lot], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """image_id, y, x and what ``f`` gives (flat): one row for each pixel."""

    def rows(t: Lot) -> dict[str, object]:
        y, x = t.places()
        return {"image_id": t.column("image_id"), "y": (y + t.column("y0")).astype(np.int32), "x": x.astype(np.int32), **f(t)}

    return each(tiles, rows, f"image_id long, y int, x int, {schema}")


# ---- reconstruction -----------------------------------------------------------------------


def with_plane(tiles: DataFrame, planes: DataFrame) -> DataFrame:
    """Add ``parts`` to tiles: the plane's rows that their pixels lie among, with the
    rows next to the band's ends. Each of the plane's tiles goes to its own band, and
    its first and last rows to the bands before and after."""
    gw = F.col("gw")
    part = lambda y0, gy0, codes: F.struct(y0.cast("int").alias("y0"), gy0.cast("int").alias("gy0"), "gw", codes.alias("codes"))
    sent = F.array(
        part(F.col("y0"), F.col("gy0"), F.col("codes")), part(F.col("y0") - BAND, F.col("gy0"), F.substring("codes", F.lit(1), gw)),
        part(F.col("y0") + BAND, F.col("gy0") + F.col("gh") - 1, F.substring("codes", ((F.col("gh") - 1) * gw + 1).cast("int"), gw)),
    )
    near = planes.select("image_id", F.explode(sent).alias("p")).groupBy("image_id", F.col("p.y0").alias("y0")).agg(F.array_sort(F.collect_list(F.struct("p.gy0", "p.gw", "p.codes"))).alias("parts"))  # three at most
    return tiles.join(near, ["image_id", "y0"])


def sampled(t: Lot, subsample: int) -> np.ndarray:
    """The plane's value at each pixel, in codes: bilinear between half-pixel centres
    with clamped edges."""
    out = np.empty(t.total)
    for first, height, width, y0, parts in zip(t.first.tolist(), t.height.tolist(), t.width.tolist(), t.b["y0"].to_pylist(), t.b["parts"].to_pylist()):
        gw, top = parts[0]["gw"], parts[0]["gy0"]
        plane = np.frombuffer(b"".join(p["codes"] for p in parts), np.uint8).reshape(-1, gw).astype(np.float64)
        if subsample == 1:
            out[first : first + height * width] = plane[y0 - top : y0 - top + height].reshape(-1)
            continue
        rows, below = _weights(np.arange(y0, y0 + height), subsample, top, len(plane))
        cols, right = _weights(np.arange(width), subsample, 0, gw)
        a, b = plane[rows[0]], plane[rows[1]]
        left, more = a[:, cols[0]] * (1 - right) + a[:, cols[1]] * right, b[:, cols[0]] * (1 - right) + b[:, cols[1]] * right
        out[first : first + height * width] = (left * (1 - below)[:, None] + more * below[:, None]).reshape(-1)
    return out


def _weights(at: np.ndarray, subsample: int, top: int, n: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The two samples beside each place, and the share of the second."""
    f = (at + 0.5) / subsample - 0.5
    low = np.floor(f).astype(np.int64)
    return (np.clip(low - top, 0, n - 1), np.clip(low + 1 - top, 0, n - 1)), f - low


def rebuilt(t: Lot, subsample: int) -> tuple[np.ndarray, ...]:
    """Linear light of the rendition with the plane's gain applied."""
    stops = K.decode(sampled(t, subsample) / 255.0, t.column("min_log2"), t.column("max_log2"))
    return tuple(K.apply_gain(K.LINEAR[c], stops) for c in _base(t))


def reconstructible(tiles: DataFrame, subsample: int) -> DataFrame:
    """Tiles with white, range and the derived plane, for ``rebuilt``."""
    lit = with_white(tiles)
    ranges = gain_range(lit)
    return attach(with_plane(lit, gain_plane(lit, ranges, subsample)), ranges)


# ---- measures -----------------------------------------------------------------------------


def _fine(x: np.ndarray) -> np.ndarray:
    """A bucket that grows with ``x`` of zero or more: FINE to an octave."""
    return np.where(x > 0, np.floor(np.log2(np.where(x > 0, x, 1.0)) * FINE), -(1 << 30)).astype(np.int64)


def ranked(tiles: DataFrame, values: Callable[[Lot], tuple[np.ndarray, np.ndarray]], targets: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """image_id, n, name, value, y, x: for each named rank (from 0, an expression of
    the image's number n of values) the value there, ordered by value, then place.

    ``values``: of each pixel, a number of 0 or more, and whether it counts. Buckets are
    counted first, combined on the map side; only the values in the buckets that hold a
    wanted rank are then sorted, so a whole image never meets in a task. Equal values
    share a bucket and are dealt out by their rows.
    """
    def counts(t: Lot) -> dict[str, object]:
        value, counts_ = values(t)
        owner = t.spread(np.arange(len(t.size)))[counts_]
        keys, n = np.unique(np.stack([owner, _fine(value[counts_])], axis=1), axis=0, return_counts=True) if counts_.any() else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
        return {"image_id": t.b["image_id"].to_numpy()[keys[:, 0]], "bucket": keys[:, 1], "n": n}

    n = each(tiles, counts, "image_id long, bucket long, n long").groupBy("image_id", "bucket").agg(F.sum("n").alias("n"))
    run = n.select("image_id", "bucket", F.col("n").alias("own"), (F.sum("n").over(Window.partitionBy("image_id").orderBy("bucket")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("image_id")).alias("n"))
    wanted = F.filter(F.array(*(F.struct(F.lit(k).alias("name"), v.cast("long").alias("rank")) for k, v in targets(F.col("n")).items())), lambda w: (w["rank"] >= F.col("before")) & (w["rank"] < F.col("before") + F.col("own")))
    hit = run.select("image_id", "bucket", "before", "n", wanted.alias("wanted")).where(F.size("wanted") > 0)
    of_image = hit.groupBy("image_id").agg(F.collect_list("bucket").alias("buckets"))  # as many as there are ranks

    def members(t: Lot) -> dict[str, object]:
        value, counts_ = values(t)
        bucket = _fine(value)
        keep = np.zeros(t.total, bool)
        for first, size, asked in zip(t.first.tolist(), t.size.tolist(), t.b["buckets"].to_pylist()):
            keep[first : first + size] = np.isin(bucket[first : first + size], asked)
        keep &= counts_
        y, x = t.places()
        return {"image_id": t.column("image_id")[keep], "bucket": bucket[keep], "value": value[keep], "y": (y + t.column("y0"))[keep].astype(np.int32), "x": x[keep].astype(np.int32)}

    inside = each(attach(tiles, of_image), members, "image_id long, bucket long, value double, y int, x int")
    own = F.row_number().over(Window.partitionBy("image_id", "bucket").orderBy("value", "y", "x")) - 1
    placed = inside.select("*", own.alias("own")).join(hit, ["image_id", "bucket"])
    at = placed.select("image_id", "n", "value", "y", "x", F.explode(F.filter("wanted", lambda w: w["rank"] == F.col("before") + F.col("own"))).alias("w"))
    return at.select("image_id", "n", "w.name", "value", "y", "x")


def _lumas(subsample: int) -> Callable[[Lot], tuple[np.ndarray, np.ndarray]]:
    return lambda t: (K.luma(*t.rgb()), K.luma(*rebuilt(t, subsample)))


def errors(tiles: DataFrame, subsample: int, floor: float = 0.05, quantiles: dict[str, float] | None = None) -> DataFrame:
    """Per image, of the reconstruction's luma against the pixel's where that is ``floor``
    or more: n_pixels, mse, worst relative error with its place (ties: the first in
    reading order), peak of the pixels' luma, and the errors at rank floor(n * q)."""
    quantiles = quantiles or {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}
    ready, pair = reconstructible(tiles, subsample), _lumas(subsample)

    def relative(t: Lot) -> tuple[np.ndarray, np.ndarray]:
        a, b = pair(t)
        lit = a >= floor
        return np.where(lit, np.abs((b - a) / np.where(lit, a, 1.0)), 0.0), lit

    def sums(t: Lot) -> dict[str, object]:
        a, b = pair(t)
        rel, lit = relative(t)
        square = np.where(lit, (b - a) ** 2, 0.0)
        worst = t.most(np.where(lit, rel, -1.0))
        at = np.where(lit & (rel == t.spread(worst)), np.arange(t.total), t.total)
        at = np.minimum(t.least(at), t.total - 1).astype(np.int64)
        y, x = t.places()
        n = np.add.reduceat(lit.astype(np.int64), t.first)
        return {"image_id": t.b["image_id"], "n": n, "square": np.add.reduceat(square, t.first), "rel": worst, "y": (y[at] + t.b["y0"].to_numpy()).astype(np.int32), "x": x[at].astype(np.int32), "peak": t.most(np.where(lit, a, 0.0))}

    part = each(ready, sums, "image_id long, n long, square double, rel double, y int, x int, peak double").where("n > 0")
    whole = part.groupBy("image_id").agg(F.sum("n").alias("n_pixels"), (F.sum("square") / F.sum("n")).alias("mse"), F.max("rel").alias("worst"), F.max_by(F.struct("y", "x"), F.struct("rel", -F.col("y"), -F.col("x"))).alias("at"), F.max("peak").alias("peak"))
    ranks = ranked(ready, relative, lambda n: {k: F.least(F.floor(n * q), n - 1) for k, q in quantiles.items()})
    named = ranks.groupBy("image_id").agg(*(F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in quantiles))
    return whole.join(named, "image_id").select("image_id", "n_pixels", "mse", "worst", F.col("at.y").alias("worst_y"), F.col("at.x").alias("worst_x"), "peak", *quantiles)


def group_differences(tiles: DataFrame, subsample: int, groups: int = 10) -> DataFrame:
    """image_id, decile, n, diff: pixels in ``groups`` even parts by luma (then place), the
    first ones larger where n does not divide, and the mean change of luma in each."""
    ready, pair = reconstructible(tiles, subsample), _lumas(subsample)

    def light(t: Lot) -> tuple[np.ndarray, np.ndarray]:
        return pair(t)[0], np.ones(t.total, bool)

    # the first of each part but the first; a part without pixels has none
    first = lambda n: {str(k): F.floor(n / groups) * k + F.least(n % groups, F.lit(k)) for k in range(1, groups)}
    starts = ranked(ready, light, first).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("value", "y", "x", "name"))).alias("starts"))  # groups - 1 at most

    def sums(t: Lot) -> dict[str, object]:
        a, b = pair(t)
        y, x = t.places()
        y = y + t.column("y0")
        part = np.zeros(t.total, np.int64)
        for first_, size, asked in zip(t.first.tolist(), t.size.tolist(), t.b["starts"].to_pylist()):
            own = slice(first_, first_ + size)
            for s in asked or []:
                after = (a[own] > s["value"]) | ((a[own] == s["value"]) & ((y[own] > s["y"]) | ((y[own] == s["y"]) & (x[own] >= s["x"]))))
                part[own] = np.where(after, int(s["name"]), part[own])
        key = t.spread(np.arange(len(t.size))) * groups + part
        ids, at = np.unique(key, return_inverse=True)
        return {"image_id": t.b["image_id"].to_numpy()[ids // groups], "decile": (ids % groups + 1).astype(np.int32), "n": np.bincount(at), "total": np.bincount(at, b - a)}

    joined = ready.join(starts, "image_id", "left")
    part = each(joined, sums, "image_id long, decile int, n long, total double")
    return part.groupBy("image_id", "decile").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("diff"))


def extremes(tiles: DataFrame, subsample: int) -> DataFrame:
    """image_id, peak (the reconstruction's greatest channel), n_above (pixels over white)."""

    def sums(t: Lot) -> dict[str, object]:
        rgb = rebuilt(t, subsample)
        return {"image_id": t.b["image_id"], "peak": t.most(np.maximum(np.maximum(*rgb[:2]), rgb[2])), "n": np.add.reduceat((K.luma(*rgb) > 1).astype(np.int64), t.first)}

    part = each(reconstructible(tiles, subsample), sums, "image_id long, peak double, n long")
    return part.groupBy("image_id").agg(F.max("peak").alias("peak"), F.sum("n").alias("n_above"))


# ---- whole files --------------------------------------------------------------------------


def joined_codes(planes: DataFrame) -> DataFrame:
    """image_id, gain: the plane's codes, whole. For files, which hold an image anyway."""
    whole = planes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("gy0", "codes"))).alias("p"))
    return whole.select("image_id", F.array_join(F.transform("p", lambda s: F.hex(s["codes"])), "").alias("gain")).select("image_id", F.unhex("gain").alias("gain"))


def joined_base(tiles: DataFrame) -> DataFrame:
    """image_id, width, height, base: the rendition's bytes, whole."""
    whole = base_codes(tiles).groupBy("image_id").agg(F.max("width").alias("width"), F.sum("height").cast("int").alias("height"), F.array_sort(F.collect_list(F.struct("y0", "base"))).alias("p"))
    return whole.select("image_id", "width", "height", F.unhex(F.array_join(F.transform("p", lambda s: F.hex(s["base"])), "")).alias("base"))
