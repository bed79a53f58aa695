"""Colour science as column expressions: transfer curves, luma, tone mapping, primaries,
gamut tests and colour difference. Everything stays within whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# BT.709 luma weights, the least linear value, SMPTE ST 2084 constants.
LUMA = (0.2126, 0.7152, 0.0722)
EPS = 1e-6
PQ = {"m1": 2610 / 16384, "m2": 2523 / 4096 * 128, "c1": 3424 / 4096, "c2": 2413 / 4096 * 32, "c3": 2392 / 4096 * 32, "peak": 10000.0}

# CIE xy of red, green, blue and the D65 white point; H.273 codes.
WHITE_D65 = (0.3127, 0.3290)
PRIMARIES = {
    "bt709": ((0.640, 0.330), (0.300, 0.600), (0.150, 0.060)),
    "display-p3": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060)),
    "bt2020": ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046)),
}
NCLX = {"bt709": 1, "display-p3": 12, "bt2020": 9}
# Bradford adaptation from D65 to D50.
BRADFORD = ((1.0478112, 0.0228866, -0.0501270), (0.0295424, 0.9904844, -0.0170491), (-0.0092345, 0.0150436, 0.7521316))

Matrix = tuple[tuple[float, float, float], ...]


def invert(m: Matrix) -> Matrix:
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return (
        ((e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det),
        ((f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det),
        ((d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det),
    )


def multiply(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)) for i in range(3))


def to_xyz(primaries: str) -> Matrix:
    """Linear RGB to XYZ, from the chromaticities and the white point."""
    xyz = [(x / y, 1.0, (1 - x - y) / y) for x, y in PRIMARIES[primaries]]
    cols = tuple(zip(*xyz))
    wx, wy = WHITE_D65
    white = (wx / wy, 1.0, (1 - wx - wy) / wy)
    inv = invert(cols)
    scale = [sum(inv[i][k] * white[k] for k in range(3)) for i in range(3)]
    return tuple(tuple(cols[i][j] * scale[j] for j in range(3)) for i in range(3))


def conversion(source: str, target: str) -> Matrix | None:
    """Linear RGB between primaries; None where there is nothing to do."""
    return None if source == target else multiply(invert(to_xyz(target)), to_xyz(source))


def apply_matrix(m: Matrix, r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return tuple(F.lit(row[0]) * r + F.lit(row[1]) * g + F.lit(row[2]) * b for row in m)


def convert(source: str, target: str, r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    m = conversion(source, target)
    return (r, g, b) if m is None else apply_matrix(m, r, g, b)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Into [low, high]; NaN becomes ``low``, unlike Spark's greatest and least."""
    return F.when(F.isnan(c), F.lit(low)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), c)))


def is_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def srgb_to_linear(c: Column, bounded: bool = True) -> Column:
    """sRGB EOTF. Only loaders read values outside 0..1 unbounded."""
    c = clamp(c) if bounded else c
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    c = clamp(c)
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def srgb8_to_linear(code: Column) -> Column:
    return srgb_to_linear(code.cast("double") / 255.0)


def linear_to_srgb8(c: Column) -> Column:
    """Nearest 8-bit code; NaN is 0."""
    return F.round(linear_to_srgb(c) * 255.0).cast("int")


def pq_to_nits(signal: Column) -> Column:
    """SMPTE ST 2084 EOTF of a signal in 0..1."""
    v = F.pow(clamp(signal), F.lit(1 / PQ["m2"]))
    return PQ["peak"] * F.pow(F.greatest(v - PQ["c1"], F.lit(0.0)) / (PQ["c2"] - PQ["c3"] * v), F.lit(1 / PQ["m1"]))


def luma(r: Column, g: Column, b: Column) -> Column:
    """BT.709 weights, whatever the primaries."""
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def luma_code(r: Column, g: Column, b: Column) -> Column:
    """Nearest code to the luma of 8-bit codes, halves up. The weights are whole
    ten-thousandths: their sum as doubles can fall short of a half that is met exactly."""
    wr, wg, wb = (round(w * 10_000) for w in LUMA)
    return F.floor((wr * r + wg * g + wb * b + 5_000) / 10_000)


def positive(c: Column) -> Column:
    """At least 0; NaN is 0."""
    return F.when(F.isnan(c) | (c < 0), F.lit(0.0)).otherwise(c)


def tone_map_luma(l: Column, white: Column | None) -> Column:
    """Clip (no white point), or extended Reinhard with a white point of at least 1."""
    if white is None:
        return clamp(l)
    w = F.greatest(white, F.lit(1.0))
    return clamp(l * (1 + l / (w * w)) / (1 + l))


def tone_map(r: Column, g: Column, b: Column, white: Column | None) -> tuple[Column, Column, Column]:
    """8-bit codes of the SDR rendition: one scale for all channels keeps the hue."""
    l = positive(luma(r, g, b))
    scale = F.when(l > EPS, tone_map_luma(l, white) / F.when(l > EPS, l).otherwise(1.0)).otherwise(1.0)
    return tuple(linear_to_srgb8(c * scale) for c in (r, g, b))


def out_of_gamut(r: Column, g: Column, b: Column) -> Column:
    return F.least(r, g, b) < -1e-5 * F.greatest(r, g, b, F.lit(1.0))


def _lab_curve(t: Column) -> Column:
    return F.when(t > (6 / 29) ** 3, F.pow(F.greatest(t, F.lit(0.0)), F.lit(1 / 3))).otherwise(t * (29 / 6) ** 2 / 3 + 4 / 29)


def lab(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """CIELAB of XYZ under D65."""
    wx, wy = WHITE_D65
    fx, fy, fz = _lab_curve(x / (wx / wy)), _lab_curve(y), _lab_curve(z / ((1 - wx - wy) / wy))
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def with_delta_e(df: DataFrame, one: tuple[str, str, str], two: tuple[str, str, str], out: str = "de") -> DataFrame:
    """Add the CIEDE2000 difference of two CIELAB colours (Sharma, Wu, Dalal 2005), given
    by their columns. Steps that later ones use more than once are columns of their own, so
    that they are worked out once and the generated code stays small."""
    kept = df.columns
    c = F.col
    (l1, a1, b1), (l2, a2, b2) = one, two

    def chroma(a: Column, b: Column) -> Column:
        return F.sqrt(a * a + b * b)

    def weight(mean: Column) -> Column:
        return F.sqrt(F.pow(mean, F.lit(7.0)) / (F.pow(mean, F.lit(7.0)) + 25.0**7))

    def hue(a: Column, b: Column) -> Column:
        return F.when((a == 0) & (b == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)))

    df = df.withColumn("_g", 1.5 - 0.5 * weight((chroma(c(a1), c(b1)) + chroma(c(a2), c(b2))) / 2))
    df = df.withColumns({"_a1": c(a1) * c("_g"), "_a2": c(a2) * c("_g")})
    df = df.withColumns({"_c1": chroma(c("_a1"), c(b1)), "_c2": chroma(c("_a2"), c(b2)), "_h1": hue(c("_a1"), c(b1)), "_h2": hue(c("_a2"), c(b2))})
    grey, turn, both = c("_c1") * c("_c2") == 0, c("_h2") - c("_h1"), c("_h1") + c("_h2")
    df = df.withColumns({
        "_dh": F.when(grey, 0.0).when(turn > 180, turn - 360).when(turn < -180, turn + 360).otherwise(turn),
        "_hm": F.when(grey, both).when(F.abs(turn) <= 180, both / 2).when(both < 360, both / 2 + 180).otherwise(both / 2 - 180),
        "_cm": (c("_c1") + c("_c2")) / 2, "_l2": ((c(l1) + c(l2)) / 2 - 50) * ((c(l1) + c(l2)) / 2 - 50),
    })
    h = c("_hm")
    t = 1 - 0.17 * F.cos(F.radians(h - 30)) + 0.24 * F.cos(F.radians(2 * h)) + 0.32 * F.cos(F.radians(3 * h + 6)) - 0.20 * F.cos(F.radians(4 * h - 63))
    df = df.withColumns({
        "_dl": (c(l2) - c(l1)) / (1 + 0.015 * c("_l2") / F.sqrt(20 + c("_l2"))), "_dc": (c("_c2") - c("_c1")) / (1 + 0.045 * c("_cm")),
        "_dd": 2 * F.sqrt(c("_c1") * c("_c2")) * F.sin(F.radians(c("_dh") / 2)) / (1 + 0.015 * c("_cm") * t),
        "_rt": -2 * F.sin(F.radians(60 * F.exp(-F.pow((h - 275) / 25, F.lit(2.0))))) * weight(c("_cm")),
    })
    square = c("_dl") * c("_dl") + c("_dc") * c("_dc") + c("_dd") * c("_dd") + c("_rt") * c("_dc") * c("_dd")
    return df.select(*kept, F.sqrt(F.greatest(square, F.lit(0.0))).alias(out))


def saturation(r: Column, g: Column, b: Column) -> Column:
    """(max - min) / max; 0 at black."""
    top = F.greatest(r, g, b)
    return F.when(top > 0, (top - F.least(r, g, b)) / F.when(top > 0, top).otherwise(1.0)).otherwise(0.0)
