"""Queries over pixels, each with the SQL it is held against.

The SQL restates the arithmetic on its own; only constants are shared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import gain as G
from ..functions import kernels as K
from ..operators import derive as D
from ..operators import frames as P
from ..operators import metrics as M
from ..operators import tiles as T

# ---- pieces of SQL -----------------------------------------------------------------

PX = """e AS (SELECT vec_id // 3 AS image_id, vec_id % 3 AS ch, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
px AS (SELECT image_id, (i // 8)::INTEGER AS y, (i % 8)::INTEGER AS x, coalesce(max(CASE WHEN ch = 0 THEN abs(v::DOUBLE) * 8 END), 0.0) AS r,
  coalesce(max(CASE WHEN ch = 1 THEN abs(v::DOUBLE) * 8 END), 0.0) AS g, coalesce(max(CASE WHEN ch = 2 THEN abs(v::DOUBLE) * 8 END), 0.0) AS b FROM e GROUP BY image_id, i)"""
Y = "(0.2126 * r + 0.7152 * g + 0.0722 * b)"


def _lin(code: str) -> str:
    c = f"(({code}) / 255.0::DOUBLE)"
    return f"(CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END)"


def _code(lin: str) -> str:
    c = f"least(greatest({lin}, 0.0::DOUBLE), 1.0::DOUBLE)"
    return f"round(255.0 * (CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE 1.055 * pow({c}, 1 / 2.4::DOUBLE) - 0.055 END))::INTEGER"


WHITE = f"w AS (SELECT image_id, greatest(max({Y}), 1.0) AS white FROM px GROUP BY image_id)"
_REIN = "least(greatest(l * (1 + l / (white * white)) / (1 + l), 0.0), 1.0)"
SDR = f"""{WHITE},
l AS (SELECT px.*, white, {Y} AS l FROM px JOIN w USING (image_id)),
s AS (SELECT *, CASE WHEN l > 1e-6 THEN {_REIN} / l ELSE 1.0 END AS k FROM l),
sdr AS (SELECT image_id, y, x, r, g, b, l, {_code("r * k")} AS br, {_code("g * k")} AS bg, {_code("b * k")} AS bb FROM s)"""
GAIN = f"""{SDR},
gn AS (SELECT *, log2(greatest((l + 0.015625) / (0.2126 * {_lin("br")} + 0.7152 * {_lin("bg")} + 0.0722 * {_lin("bb")} + 0.015625), 1e-6)) AS gain FROM sdr),
rg AS (SELECT image_id, min(gain) AS lo, max(gain) AS hi FROM gn GROUP BY image_id)"""


def _plane_sql(s: int) -> str:
    return f"""{GAIN},
pl AS (SELECT image_id, (y // {s})::INTEGER AS gy, (x // {s})::INTEGER AS gx, round(255 * avg(CASE WHEN hi > lo THEN (gain - lo) / (hi - lo) ELSE 0.0 END))::INTEGER AS code
  FROM gn JOIN rg USING (image_id) GROUP BY image_id, y // {s}, x // {s})"""


def _mat(m, names=("r", "g", "b")) -> list[str]:
    return ["(" + " + ".join(f"({v!r}::DOUBLE) * {n}" for v, n in zip(row, names)) + ")" for row in m]


# ---- shared frames -----------------------------------------------------------------


def _px(spark: SparkSession, d: str) -> DataFrame:
    return P.embedding_images(spark, d)


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    return P.embedding_tiles(spark, d)


def _plane(spark: SparkSession, d: str, s: int) -> DataFrame:
    lit = T.with_white(_tiles(spark, d))
    return T.plane_rows(T.gain_plane(lit, T.gain_range(lit), s))


def _codes(tiles: DataFrame) -> DataFrame:
    return T.pixel_rows(tiles, lambda t: dict(zip(("br", "bg", "bb"), (c.astype("int32") for c in T._base(t)))), "br int, bg int, bb int")


RECON = """{plane},
rc AS (SELECT gn.image_id, gn.y, gn.x, l, br, bg, bb, CASE WHEN hi > lo THEN lo + code / 255.0::DOUBLE * (hi - lo) ELSE lo END AS st
  FROM gn JOIN rg USING (image_id) JOIN pl ON pl.image_id = gn.image_id AND pl.gy = gn.y AND pl.gx = gn.x),
r2 AS (SELECT image_id, y, x, l, {r} AS r, {g} AS g, {b} AS b FROM rc)"""
RECON1 = RECON.format(plane=_plane_sql(1), **{c: f"greatest(({_lin('b' + c)} + 0.015625) * pow(2.0, st) - 0.015625, 0.0)" for c in "rgb"})

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {PX} SELECT image_id, count(*) AS n, round(min({Y}), 6) AS low, round(avg({Y}), 6) AS mean, round(max({Y}), 6) AS high FROM px GROUP BY image_id")
def luma_stats(spark, d):
    l = C.luma(*map(F.col, "rgb"))
    return _px(spark, d).groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.min(l), 6).alias("low"), F.round(F.avg(l), 6).alias("mean"), F.round(F.max(l), 6).alias("high"))


@query(f"SELECT i::BIGINT AS code, round({_lin('i')}, 9) AS linear, {_code(_lin('i'))} AS back FROM range(256) t(i)")
def srgb_roundtrip_codes(spark, d):
    lin = C.srgb8_to_linear(F.col("id"))
    return spark.range(256).select(F.col("id").alias("code"), F.round(lin, 9).alias("linear"), C.linear_to_srgb8(lin).alias("back"))


@query(f"WITH {PX}, {SDR}, lut AS (SELECT i AS code, {_lin('i')} AS lin FROM range(256) t(i)) SELECT image_id, count(*) AS n, round(sum(lin), 6) AS total FROM sdr JOIN lut ON br = code GROUP BY image_id")
def srgb_lut_join(spark, d):
    """Decoding by joining the table of all 256 codes, which is as large as it gets."""
    lut = spark.range(256).select(F.col("id").cast("int").alias("br"), C.srgb8_to_linear(F.col("id")).alias("lin"))
    px = D.with_base(D.with_white(_px(spark, d)), F.col("white"))
    return px.join(F.broadcast(lut), "br").groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.sum("lin"), 6).alias("total"))


_PQ = "pow(greatest(v - 0.8359375, 0.0) / (18.8515625 - 18.6875 * v), 1 / 0.1593017578125)"


@query(f"WITH {PX}, q AS (SELECT image_id, y, x, floor(least(r / 8, 1.0) * 65535) AS code FROM px), v AS (SELECT *, pow(code / 65535.0::DOUBLE, 1 / 78.84375) AS v FROM q) SELECT image_id, y, x, code::INTEGER AS code, round(10000 * {_PQ} / 203, 6) AS linear FROM v")
def pq_decode(spark, d):
    q = _px(spark, d).select("image_id", "y", "x", F.floor(F.least(F.col("r") / 8, F.lit(1.0)) * 65535).cast("int").alias("code"))
    return q.select("*", F.round(C.pq_to_nits(F.col("code") / 65535.0) / 203, 6).alias("linear"))


@query(f"WITH {PX}, {SDR} SELECT image_id, y, x, br, bg, bb FROM sdr")
def reinhard_tonemap(spark, d):
    return _codes(T.with_white(_tiles(spark, d)))


@query(f"WITH {PX}, l AS (SELECT *, {Y} AS l FROM px), s AS (SELECT *, CASE WHEN l > 1e-6 THEN least(l, 1.0) / l ELSE 1.0 END AS k FROM l) SELECT image_id, y, x, {_code('r * k')} AS br, {_code('g * k')} AS bg, {_code('b * k')} AS bb FROM s")
def clip_tonemap(spark, d):
    return _codes(_tiles(spark, d))


def _peak_sql(source: str, fraction: float) -> str:
    return f"""h AS (SELECT image_id, floor(round((least(greatest(log2(greatest({Y}, 1e-6)), -8.0), 8.0) + 8.0) / 16.0 * 1023, 9))::INTEGER AS b, count(*) AS n FROM {source} GROUP BY 1, 2),
c AS (SELECT image_id, b, sum(n) OVER (PARTITION BY image_id ORDER BY b DESC) AS seen, sum(n) OVER (PARTITION BY image_id) AS total FROM h)
SELECT image_id, round(greatest(pow(2.0, max(b) / 1023.0::DOUBLE * 16 - 8), 1.0), 6) AS peak FROM c WHERE seen > floor(total * {fraction}) GROUP BY image_id"""


@query(f"WITH {PX}, {_peak_sql('px', 0.02)}")
def peak_luma(spark, d):
    return M.peak_luma(_px(spark, d), 0.02).select("image_id", F.round("peak", 6).alias("peak"))


WIDE = "wide AS (SELECT l_suppkey AS image_id, l_quantity / 10 AS r, l_extendedprice / 20000 AS g, l_discount * 20 AS b FROM lineitem)"


@query(f"WITH {WIDE}, {_peak_sql('wide', 0.001)}")
def peak_luma_wide(spark, d):
    return M.peak_luma(P.wide_pixels(spark, d), 0.001).select("image_id", F.round("peak", 6).alias("peak"))


@query(f"WITH {WIDE}, {WHITE.replace('FROM px', 'FROM wide')}, l AS (SELECT wide.*, white, {Y} AS l FROM wide JOIN w USING (image_id)), q AS (SELECT image_id, log2(greatest((l + 0.015625) / ({_REIN} + 0.015625), 1e-6)) AS gain FROM l) SELECT image_id, round(min(gain), 6) AS min_log2, round(max(gain), 6) AS max_log2 FROM q GROUP BY image_id")
def derive_range(spark, d):
    """Range of the gain over a base tone-mapped in luma, on the wide stream."""
    px = D.with_white(P.wide_pixels(spark, d))
    l = C.positive(C.luma(*map(F.col, "rgb")))
    ranges = D.gain_range(px.select("image_id", G.log2_gain(l, C.tone_map_luma(l, F.col("white"))).alias("gain")))
    return ranges.select("image_id", F.round("min_log2", 6).alias("min_log2"), F.round("max_log2", 6).alias("max_log2"))


@query(f"WITH {PX}, {_plane_sql(1)} SELECT * FROM pl")
def derive_plane_s1(spark, d):
    return _plane(spark, d, 1)


@query(f"WITH {PX}, {_plane_sql(2)} SELECT * FROM pl")
def derive_plane_s2(spark, d):
    """The flagship: pixels to tone-mapped base to gain plane."""
    return _plane(spark, d, 2)


@query(f"WITH {PX}, {_plane_sql(3)} SELECT * FROM pl")
def derive_plane_s3(spark, d):
    """Blocks of three leave partial ones at the edges."""
    return _plane(spark, d, 3)


@query(f"WITH {PX}, {GAIN} SELECT image_id, round(lo, 6) AS min_log2, round(hi, 6) AS max_log2, 1.0::DOUBLE AS gamma, 0.015625::DOUBLE AS base_offset, 0.015625::DOUBLE AS alt_offset, 0.0::DOUBLE AS base_headroom, round(greatest(hi, 0.0), 6) AS alt_headroom FROM rg")
def derive_consistent_meta(spark, d):
    m = D.consistent_meta(T.gain_range(T.with_white(_tiles(spark, d))))
    return m.select("image_id", *(F.round(c, 6).alias(c) for c in ("min_log2", "max_log2")), "gamma", "base_offset", "alt_offset", "base_headroom", F.round("alt_headroom", 6).alias("alt_headroom"))


@query(f"WITH {PX}, {RECON1} SELECT image_id, y, x, {_code('r')} AS r, {_code('g')} AS g, {_code('b')} AS b FROM r2")
def gain_decode_apply(spark, d):
    def codes(t):
        return {n: K.linear_to_srgb8(c).astype("int32") for n, c in zip("rgb", T.rebuilt(t, 1))}

    return T.pixel_rows(T.reconstructible(_tiles(spark, d), 1), codes, "r int, g int, b int")


@query(f"WITH {PX}, {RECON1} SELECT image_id, round(max(greatest(r, g, b)), 5) AS peak, sum(CASE WHEN {Y} > 1 THEN 1 ELSE 0 END)::BIGINT AS n_above FROM r2 GROUP BY image_id")
def apply_hdr_peak(spark, d):
    return T.extremes(_tiles(spark, d), 1).select("image_id", F.round("peak", 5).alias("peak"), "n_above")


_RANKS = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}
_ERR = f"a AS (SELECT image_id, y, x, l AS a, {Y} AS b FROM r2), q AS (SELECT *, abs((b - a) / a) AS rel FROM a WHERE a >= 0.05)"


@query(f"""WITH {PX}, {RECON1}, {_ERR} SELECT image_id, count(*) AS n_pixels, round(CASE WHEN avg((b - a) * (b - a)) > 0 THEN 20 * log10(max(a) / sqrt(avg((b - a) * (b - a)))) END, 4) AS psnr, round(max(rel), 6) AS worst, first(y ORDER BY rel DESC, y, x) AS worst_y, first(x ORDER BY rel DESC, y, x) AS worst_x FROM q GROUP BY image_id""")
def roundtrip_psnr(spark, d):
    e = T.errors(_tiles(spark, d), 1)
    return e.select("image_id", "n_pixels", F.round(F.when(F.col("mse") > 0, M.psnr(F.col("peak"), F.col("mse"))), 4).alias("psnr"), F.round("worst", 6).alias("worst"), "worst_y", "worst_x")


@query(f"""WITH {PX}, {RECON1}, {_ERR}, k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY rel, y, x) - 1 AS rk, count(*) OVER (PARTITION BY image_id) AS n FROM q)
SELECT image_id, {", ".join(f"round(max(CASE WHEN rk = least(floor(n * {q}), n - 1) THEN rel END), 6) AS {c}" for c, q in _RANKS.items())} FROM k GROUP BY image_id""")
def roundtrip_p999(spark, d):
    """Errors at four ranks of each image."""
    return T.errors(_tiles(spark, d), 1).select("image_id", *(F.round(c, 6).alias(c) for c in _RANKS))


_FY, _FX = "((y + 0.5) / 2 - 0.5)", "((x + 0.5) / 2 - 0.5)"


def _corner(dy: int, dx: int) -> str:
    wy = f"({_FY} - floor({_FY}))" if dy else f"(1 - ({_FY} - floor({_FY})))"
    wx = f"({_FX} - floor({_FX}))" if dx else f"(1 - ({_FX} - floor({_FX})))"
    return f"SELECT image_id, y, x, least(greatest(floor({_FY}) + {dy}, 0), 3)::INTEGER AS gy, least(greatest(floor({_FX}) + {dx}, 0), 3)::INTEGER AS gx, {wy} * {wx} AS w FROM gn"


@query(f"WITH {PX}, {_plane_sql(2)}, cr AS ({' UNION ALL '.join(_corner(a, b) for a in (0, 1) for b in (0, 1))}) SELECT image_id, y, x, round(sum(w * code), 6) AS code FROM cr JOIN pl USING (image_id, gy, gx) GROUP BY image_id, y, x")
def bilinear_upsample(spark, d):
    lit = T.with_white(_tiles(spark, d))
    near = T.with_plane(lit, T.gain_plane(lit, T.gain_range(lit), 2))
    return T.pixel_rows(near, lambda t: {"code": T.sampled(t, 2)}, "code double").withColumn("code", F.round("code", 6))


@query(f"WITH {PX} SELECT image_id, (y // 4)::INTEGER AS by, (x // 4)::INTEGER AS bx, round(avg({Y}), 6) AS mean FROM px GROUP BY image_id, y // 4, x // 4")
def block_average(spark, d):
    return _px(spark, d).groupBy("image_id", F.floor(F.col("y") / 4).cast("int").alias("by"), F.floor(F.col("x") / 4).cast("int").alias("bx")).agg(F.round(F.avg(C.luma(*map(F.col, "rgb"))), 6).alias("mean"))


_TO709 = _mat(C.conversion("display-p3", "bt709"))
_XYZ = _mat(C.to_xyz("display-p3"))


@query(f"WITH {PX} SELECT image_id, y, x, round({_TO709[0]}, 6) + 0.0 AS r, round({_TO709[1]}, 6) + 0.0 AS g, round({_TO709[2]}, 6) + 0.0 AS b FROM px")
def primaries_convert(spark, d):
    out = C.convert("display-p3", "bt709", *map(F.col, "rgb"))
    return _px(spark, d).select("image_id", "y", "x", *((F.round(c, 6) + 0.0).alias(n) for n, c in zip("rgb", out)))


def _out(m) -> str:
    r, g, b = _mat(m) if m else ("r", "g", "b")
    return f"(least({r}, {g}, {b}) < -1e-5 * greatest({r}, {g}, {b}, 1.0))"


_C709 = _mat(C.conversion("bt2020", "bt709"))
_LOW, _TOP = f"least({', '.join(_C709)})", f"greatest({', '.join(_C709)})"
#: The same colours by way of Display P3, where the other render clips what is below zero.
_VIA = _mat(C.conversion("display-p3", "bt709"), tuple(f"greatest({c}, 0.0)" for c in _mat(C.conversion("bt2020", "display-p3"))))


@query(f"""WITH {PX}, q AS (SELECT *, {_out(C.conversion('bt2020', 'bt709'))} AS out709, {_LOW} AS low, {_TOP} AS top, greatest({", ".join(f"abs({a} - {b})" for a, b in zip(_C709, _VIA))}) AS apart FROM px)
SELECT image_id, count(*) AS n, sum(out709::INTEGER)::BIGINT AS out_709, sum({_out(C.conversion('bt2020', 'display-p3'))}::INTEGER)::BIGINT AS out_p3, sum({_out(None)}::INTEGER)::BIGINT AS out_2020, sum(({_mat(C.to_xyz('bt2020'))[1]} > 1)::INTEGER)::BIGINT AS above_white,
round(coalesce(min(CASE WHEN out709 THEN low END), 0.0), 6) + 0.0 AS worst, round(coalesce(arg_min(CASE WHEN top > 0 THEN low / top ELSE 0.0 END, CASE WHEN out709 THEN low END), 0.0), 6) + 0.0 AS worst_relative, round(max(apart), 6) AS disagreement FROM q GROUP BY image_id""")
def out_of_gamut_counts(spark, d):
    """Pixels outside each gamut; the worst negative component with how deep it is against
    its pixel's brightest; the largest disagreement with a render that clips in P3."""
    rgb = tuple(map(F.col, "rgb"))
    names = ("r7", "g7", "b7", "rp", "gp", "bp", "light")
    r709, p3 = C.convert("bt2020", "bt709", *rgb), C.convert("bt2020", "display-p3", *rgb)
    px = _px(spark, d).select("*", *(c.alias(n) for n, c in zip(names, (*r709, *p3, C.apply_matrix(C.to_xyz("bt2020"), *rgb)[1]))))
    seven, via = tuple(map(F.col, names[:3])), C.convert("display-p3", "bt709", *(F.greatest(F.col(c), F.lit(0.0)) for c in names[3:6]))
    out, low, top = C.out_of_gamut(*seven), F.least(*seven), F.greatest(*seven)
    relative = F.min_by(F.when(top > 0, low / F.when(top > 0, top).otherwise(1.0)).otherwise(0.0), F.when(out, low))
    return px.groupBy("image_id").agg(
        F.count("*").alias("n"), F.count_if(out).alias("out_709"), F.count_if(C.out_of_gamut(*map(F.col, names[3:6]))).alias("out_p3"), F.count_if(C.out_of_gamut(*rgb)).alias("out_2020"), F.count_if(F.col("light") > 1).alias("above_white"),
        (F.round(F.coalesce(F.min(F.when(out, low)), F.lit(0.0)), 6) + 0.0).alias("worst"), (F.round(F.coalesce(relative, F.lit(0.0)), 6) + 0.0).alias("worst_relative"),
        F.round(F.max(F.greatest(*(F.abs(a - b) for a, b in zip(seven, via)))), 6).alias("disagreement"),
    )


def _clamped(spark, d):
    """Wide-gamut pixels at or below white that leave BT.709, and what clamping costs."""
    rgb = tuple(map(F.col, "rgb"))
    px = _px(spark, d).select("image_id", "y", "x", *(F.col(c) / 8 for c in "rgb")).toDF("image_id", "y", "x", "r", "g", "b")
    r7 = C.convert("bt2020", "bt709", *rgb)
    xyz = C.apply_matrix(C.to_xyz("bt2020"), *rgb)
    wide = px.select("image_id", "y", "x", *(c.alias(n) for n, c in zip(("r7", "g7", "b7", "cx", "cy", "cz"), (*r7, *xyz))))
    wide = wide.where(C.out_of_gamut(F.col("r7"), F.col("g7"), F.col("b7")) & (F.col("cy") <= 1))
    true = C.lab(F.col("cx"), F.col("cy"), F.col("cz"))
    low = C.lab(*C.apply_matrix(C.to_xyz("bt709"), *(F.greatest(F.col(c), F.lit(0.0)) for c in ("r7", "g7", "b7"))))
    labs = wide.select("image_id", "y", "x", *(c.alias(n) for n, c in zip(("l1", "a1", "b1", "l2", "a2", "b2"), (*true, *low))))
    return C.with_delta_e(labs, ("l1", "a1", "b1"), ("l2", "a2", "b2")).drop("l2", "a2", "b2")


def _labf(t: str) -> str:
    return f"(CASE WHEN {t} > {(6 / 29) ** 3!r}::DOUBLE THEN pow(greatest({t}, 0.0), 1 / 3.0::DOUBLE) ELSE ({t}) * {(29 / 6) ** 2 / 3!r}::DOUBLE + {4 / 29!r}::DOUBLE END)"


_WX, _WZ = C.WHITE_D65[0] / C.WHITE_D65[1], (1 - sum(C.WHITE_D65)) / C.WHITE_D65[1]


def _labs(x: str, y: str, z: str, n: int) -> str:
    fx, fy, fz = _labf(f"({x} / {_WX!r}::DOUBLE)"), _labf(f"({y})"), _labf(f"({z} / {_WZ!r}::DOUBLE)")
    return f"116 * {fy} - 16 AS l{n}, 500 * ({fx} - {fy}) AS a{n}, 200 * ({fy} - {fz}) AS b{n}"


_R7, _C20 = _mat(C.conversion("bt2020", "bt709")), _mat(C.to_xyz("bt2020"))
_C7 = _mat(C.to_xyz("bt709"), ("greatest(r7, 0.0)", "greatest(g7, 0.0)", "greatest(b7, 0.0)"))
DE = f"""q0 AS (SELECT image_id, y, x, r / 8 AS r, g / 8 AS g, b / 8 AS b FROM px),
q1 AS (SELECT image_id, y, x, {_R7[0]} AS r7, {_R7[1]} AS g7, {_R7[2]} AS b7, {_C20[0]} AS cx, {_C20[1]} AS cy, {_C20[2]} AS cz FROM q0),
q2 AS (SELECT image_id, y, x, {_labs('cx', 'cy', 'cz', 1)}, {_labs(*_C7, 2)} FROM q1 WHERE least(r7, g7, b7) < -1e-5 * greatest(r7, g7, b7, 1.0) AND cy <= 1),
q3 AS (SELECT *, pow((sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2, 7.0) AS c7 FROM q2),
q4 AS (SELECT *, a1 * (1 + 0.5 * (1 - sqrt(c7 / (c7 + 6103515625.0)))) AS p1, a2 * (1 + 0.5 * (1 - sqrt(c7 / (c7 + 6103515625.0)))) AS p2 FROM q3),
q5 AS (SELECT *, sqrt(p1 * p1 + b1 * b1) AS c1, sqrt(p2 * p2 + b2 * b2) AS c2, CASE WHEN p1 = 0 AND b1 = 0 THEN 0.0 ELSE (degrees(atan2(b1, p1)) + 360) % 360 END AS h1, CASE WHEN p2 = 0 AND b2 = 0 THEN 0.0 ELSE (degrees(atan2(b2, p2)) + 360) % 360 END AS h2 FROM q4),
q6 AS (SELECT *, (l1 + l2) / 2 AS lm, (c1 + c2) / 2 AS cm, CASE WHEN c1 * c2 = 0 THEN 0.0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END AS dh,
  CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm FROM q5),
q7 AS (SELECT *, (l2 - l1) / (1 + 0.015 * (lm - 50) * (lm - 50) / sqrt(20 + (lm - 50) * (lm - 50))) AS dl, (c2 - c1) / (1 + 0.045 * cm) AS dc,
  2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * cm * (1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.20 * cos(radians(4 * hm - 63)))) AS dd,
  -sin(radians(60 * exp(-((hm - 275) / 25) * ((hm - 275) / 25)))) * 2 * sqrt(pow(cm, 7.0) / (pow(cm, 7.0) + 6103515625.0)) AS rt FROM q6),
de AS (SELECT image_id, y, x, l1, a1, b1, sqrt(greatest(dl * dl + dc * dc + dd * dd + rt * dc * dd, 0.0)) AS de FROM q7)"""


@query(f"WITH {PX}, {DE} SELECT image_id, y, x, round(l1, 5) AS l, round(a1, 5) + 0.0 AS a, round(b1, 5) + 0.0 AS b, round(de, 5) AS de FROM de")
def lab_delta_e(spark, d):
    return _clamped(spark, d).select("image_id", "y", "x", F.round("l1", 5).alias("l"), (F.round("a1", 5) + 0.0).alias("a"), (F.round("b1", 5) + 0.0).alias("b"), F.round("de", 5).alias("de"))


@query(f"""WITH {PX}, {DE}, h AS (SELECT least(floor(round(de / 0.05, 6)), 600)::INTEGER AS bucket, count(*) AS n FROM de GROUP BY 1),
c AS (SELECT *, sum(n) OVER (ORDER BY bucket) AS seen, sum(n) OVER () AS total FROM h)
SELECT max(total)::BIGINT AS n, min(CASE WHEN seen >= floor(total * 0.5) THEN bucket END)::INTEGER AS p50, min(CASE WHEN seen >= floor(total * 0.95) THEN bucket END)::INTEGER AS p95,
round(sum(CASE WHEN bucket >= 20 THEN n ELSE 0 END) / max(total), 6) AS above_one FROM c""")
def delta_e_histogram(spark, d):
    b = F.least(F.floor(F.round(F.col("de") / 0.05, 6)), F.lit(600)).cast("int")
    counts = _clamped(spark, d).select(F.lit(0).alias("all_images"), b.alias("bucket")).groupBy("all_images", "bucket").agg(F.count("*").alias("n"))
    above = F.round(F.sum(F.when(F.col("bucket") >= 20, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("above_one")
    return M.first_bucket_at(counts, {"p50": 0.5, "p95": 0.95}, ["all_images"], 600, F.sum("n").alias("n"), above).select("n", "p50", "p95", "above_one")


@query(f"WITH {PX}, {DE} SELECT least(floor(((degrees(atan2(b1, a1)) + 360) % 360) / 30), 11)::INTEGER AS sector, count(*) AS n FROM de GROUP BY 1 ORDER BY n DESC, sector LIMIT 4")
def hue_top4(spark, d):
    hue = F.pmod(F.degrees(F.atan2("b1", "a1")), F.lit(360.0))
    return _clamped(spark, d).groupBy(F.least(F.floor(hue / 30), F.lit(11)).cast("int").alias("sector")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sector").limit(4)


_BY = "(0.2126 * br + 0.7152 * bg + 0.0722 * bb)"


@query(f"""WITH {PX}, {SDR}, h AS (SELECT image_id, least(floor({_BY} + 0.5), 255)::INTEGER AS bucket, count(*) AS n FROM sdr GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY image_id) AS total FROM h)
SELECT image_id, {", ".join(f"(CASE WHEN max(floor(total * {q})) = 0 THEN 0 ELSE coalesce(min(CASE WHEN seen >= floor(total * {q}) THEN bucket END), 255) END)::INTEGER AS {n}" for n, q in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95)))} FROM c GROUP BY image_id""")
def luma_histogram_percentiles(spark, d):
    px = D.with_base(D.with_white(_px(spark, d)), F.col("white"))
    counts = px.select("image_id", F.least(C.luma_code(*map(F.col, ("br", "bg", "bb"))), F.lit(255)).cast("int").alias("bucket")).groupBy("image_id", "bucket").agg(F.count("*").alias("n"))
    return M.first_bucket_at(counts, {"p5": 0.05, "p50": 0.5, "p95": 0.95}, ["image_id"], 255)


_SAT = "(greatest(br, bg, bb) - least(br, bg, bb)) / greatest(br, bg, bb)::DOUBLE"


@query(f"""WITH {PX}, {SDR} SELECT image_id, round(avg({_BY}), 10) AS mean, round(stddev_pop({_BY}), 5) AS rms, round(coalesce(avg(CASE WHEN greatest(br, bg, bb) > 0 THEN {_SAT} END), 0.0), 6) AS sat,
round(coalesce(avg(CASE WHEN greatest(br, bg, bb) >= 32 THEN {_SAT} END), 0.0), 6) AS sat32, round(100.0 * sum((greatest(br, bg, bb) >= 255)::INTEGER) / count(*), 8) AS clip FROM sdr GROUP BY image_id""")
def saturation_clip_stats(spark, d):
    px = D.with_base(D.with_white(_px(spark, d)), F.col("white"))
    y, hi = C.luma(F.col("br"), F.col("bg"), F.col("bb")), F.greatest("br", "bg", "bb")
    sat = C.saturation(*(F.col(c).cast("double") for c in ("br", "bg", "bb")))
    return px.groupBy("image_id").agg(
        F.round(F.avg(y), 10).alias("mean"), F.round(F.stddev_pop(y), 5).alias("rms"), F.round(F.coalesce(F.avg(F.when(hi > 0, sat)), F.lit(0.0)), 6).alias("sat"),
        F.round(F.coalesce(F.avg(F.when(hi >= 32, sat)), F.lit(0.0)), 6).alias("sat32"), F.round(100.0 * F.count_if(hi >= 255) / F.count("*"), 8).alias("clip"),
    )


@query(f"""WITH {PX}, {SDR}, c AS (SELECT image_id, y, x, CASE WHEN l > 1e-6 THEN least(l, 1.0) / l ELSE 1.0 END AS k FROM sdr),
t AS (SELECT sdr.image_id, abs({_BY} - (0.2126 * {_code('r * k')} + 0.7152 * {_code('g * k')} + 0.0722 * {_code('b * k')})) AS diff FROM sdr JOIN c USING (image_id, y, x)) SELECT image_id, round(avg(diff), 10) AS dmean, round(max(diff)::DOUBLE, 8) AS dmax FROM t GROUP BY image_id""")
def image_diff(spark, d):
    px = _px(spark, d)
    one = D.with_base(D.with_white(px), F.col("white")).select("image_id", "y", "x", "br", "bg", "bb")
    two = D.with_base(px, None).select("image_id", "y", "x", "br", "bg", "bb")
    diff = F.abs(C.luma(F.col("br"), F.col("bg"), F.col("bb")) - C.luma(F.col("br2"), F.col("bg2"), F.col("bb2")))
    return P.aligned(one, two).groupBy("image_id").agg(F.round(F.avg(diff), 10).alias("dmean"), F.round(F.max(diff), 8).alias("dmax"))


@query(f"WITH {PX} SELECT image_id, y, x, ((floor(least(r / 8, 1.0) * 65535)::BIGINT * 255 + 32767) // 65535)::INTEGER AS code FROM px")
def requantize_16_to_8(spark, d):
    wide = F.floor(F.least(F.col("r") / 8, F.lit(1.0)) * 65535)
    return _px(spark, d).select("image_id", "y", "x", F.floor((wide * 255 + 32767) / 65535).cast("int").alias("code"))


@query(f"WITH {PX} SELECT image_id, sum(({Y} > 1)::INTEGER)::BIGINT AS n_above, count(DISTINCT CASE WHEN {Y} > 1 THEN round({Y}, 6) END) AS n_distinct FROM px GROUP BY image_id")
def above_white_counts(spark, d):
    y = C.luma(*map(F.col, "rgb"))
    return _px(spark, d).groupBy("image_id").agg(F.count_if(y > 1).alias("n_above"), F.countDistinct(F.when(y > 1, F.round(y, 6))).alias("n_distinct"))


@query(f"""WITH {PX}, {RECON1}, a AS (SELECT image_id, y, x, l AS a, {Y} AS b FROM r2), t AS (SELECT *, ntile(10) OVER (PARTITION BY image_id ORDER BY a, y, x) AS decile FROM a) SELECT image_id, decile::INTEGER AS decile, count(*) AS n, round(avg(b - a), 6) + 0.0 AS diff FROM t GROUP BY image_id, decile""")
def decile_differences(spark, d):
    t = T.group_differences(_tiles(spark, d), 1)
    return t.select("image_id", "decile", "n", (F.round("diff", 6) + 0.0).alias("diff"))


RECON2 = f"""{_plane_sql(2)}, cr AS ({' UNION ALL '.join(_corner(a, b) for a in (0, 1) for b in (0, 1))}),
up AS (SELECT image_id, y, x, sum(w * code) / 255.0 AS t FROM cr JOIN pl USING (image_id, gy, gx) GROUP BY image_id, y, x),
rc AS (SELECT gn.image_id, gn.y, gn.x, l, br, bg, bb, CASE WHEN hi > lo THEN lo + t * (hi - lo) ELSE lo END AS st FROM gn JOIN rg USING (image_id) JOIN up USING (image_id, y, x)),
r2 AS (SELECT image_id, y, x, l, {", ".join(f"greatest(({_lin('b' + c)} + 0.015625) * pow(2.0, st) - 0.015625, 0.0) AS {c}" for c in "rgb")} FROM rc)"""


@query(f"""WITH {PX}, {RECON2}, {_ERR}, k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY rel, y, x) - 1 AS rk, count(*) OVER (PARTITION BY image_id) AS n FROM q)
SELECT image_id, max(n) AS n_pixels, round(avg((b - a) * (b - a)), 6) AS mse, round(max(rel), 6) AS worst, round(max(CASE WHEN rk = least(floor(n * 0.999), n - 1) THEN rel END), 6) AS p999 FROM k GROUP BY image_id""")
def subsampled_roundtrip(spark, d):
    """Round trip through a half-size plane with bilinear sampling: errors per image."""
    e = T.errors(_tiles(spark, d), 2)
    return e.select("image_id", "n_pixels", *(F.round(c, 6).alias(c) for c in ("mse", "worst", "p999")))


def _disc(cx: float, cy: float, radius: float) -> str:
    near = f"((u - {cx}) * (u - {cx}) + (v - {cy}) * (v - {cy}))"
    return f"(CASE WHEN {near} < {radius * radius!r}::DOUBLE THEN pow(cos(sqrt({near}) / {radius} * 1.5707963267948966), 2) ELSE 0.0 END)"


SCENE = f"""pt AS (SELECT i, i % 96 AS x, i // 96 AS y, (i % 96 + 0.5::DOUBLE) / 96 AS u, (i // 96 + 0.5::DOUBLE) / 64 AS v FROM range(96 * 64) t(i)),
lt AS (SELECT *, 8.0 * ({_disc(0.25, 0.3, 0.12)} + 0.5 * {_disc(0.5, 0.6, 0.15)} + 0.25 * {_disc(0.8, 0.4, 0.1)}) AS light, 4.0 * {_disc(0.7, 0.8, 0.1)} AS red FROM pt),
px AS (SELECT 0::BIGINT AS image_id, y::INTEGER AS y, x::INTEGER AS x, {", ".join(f"CASE WHEN i = 0 THEN 8.0 WHEN u < 0.1 AND v > 0.9 THEN 0.0 ELSE {c} END::DOUBLE AS {n}" for n, c in zip("rgb", ("0.05 + 0.7 * u + light + red", "0.05 + 0.7 * v + light", "0.05 + 0.35 * (u + v) + light")))} FROM lt)"""


@query(f"WITH {SCENE}, {_plane_sql(2)} SELECT * FROM pl")
def synthetic_scene(spark, d):
    """A generated scene in two bands, tone-mapped, and its plane."""
    lit = T.with_white(P.scene(spark, 96, 64, 8.0))
    return T.plane_rows(T.gain_plane(lit, T.gain_range(lit), 2))
