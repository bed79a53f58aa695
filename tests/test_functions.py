"""Known values and edge cases of expressions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.functions import color as C
from lumaframe.functions import gain as G
from lumaframe.functions import headroom as H
from lumaframe.functions import iso as I
from lumaframe.functions import kernels as N
from lumaframe.functions import text as T
from lumaframe.operators import derive as D
from lumaframe.operators import metrics as M
from lumaframe.operators import tiles as L
from lumaframe.operators.frames import scene

NAN, INF = float("nan"), float("inf")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("base, alt, display, want", [(2, 2, 5, 0), (0, 4, 2, 0.5), (0, 4, 9, 1), (4, 0, 2, -0.5), (4, 0, 6, 0)])
def test_gain_weight(spark, base, alt, display, want):
    assert one(spark, G.gain_weight(*(F.lit(float(x)) for x in (base, alt, display)))) == pytest.approx(want)


def test_matrices_undo_each_other():
    for a in C.PRIMARIES:
        for b in C.PRIMARIES:
            if a != b:
                m = C.multiply(C.conversion(a, b), C.conversion(b, a))
                assert all(abs(m[i][j] - (i == j)) < 1e-12 for i in range(3) for j in range(3))
    assert C.conversion("bt709", "bt709") is None
    assert C.to_xyz("bt709")[1] == pytest.approx((0.2126390059, 0.7151686788, 0.0721923154), abs=1e-8)


def test_every_code_survives(spark):
    rows = spark.range(256).select("id", C.linear_to_srgb8(C.srgb8_to_linear(F.col("id"))).alias("back")).collect()
    assert all(r["id"] == r["back"] for r in rows)


def luma_halves():
    """r, g, b, code: all 8-bit colours whose luma is exactly a half, which goes up."""
    r, g, b = (c.ravel() for c in np.meshgrid(*[np.arange(256)] * 3, indexing="ij"))
    parts = 2126 * r + 7152 * g + 722 * b
    at = parts % 10_000 == 5_000
    return np.stack([r[at], g[at], b[at], (parts[at] + 5_000) // 10_000], axis=1)


def test_luma_codes_at_halves(spark):
    df = spark.createDataFrame(luma_halves().tolist(), "br int, bg int, bb int, want int")
    assert df.where(C.luma_code(*map(F.col, ("br", "bg", "bb"))) != F.col("want")).count() == 0


def test_luma_percentiles_at_halves(spark, tmp_path):
    """Images of one colour, whose luma is a half that the sum of doubles misses."""
    import duckdb

    from lumaframe.plans import pixel_queries as Q

    halves = luma_halves()
    missed = halves[np.floor(N.luma(*halves[:, :3].T) + 0.5) != halves[:, 3]][:20]
    assert len(missed) == 20
    light = N.srgb_to_linear(missed[:, :3] / 255.0) / 8
    rows = [(3 * i + c, [float(light[i, c])] * 64) for i in range(20) for c in range(3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = Q.QUERIES["luma_histogram_percentiles"](spark, str(tmp_path)).select("image_id", "p5", "p50", "p95").collect()
    want = [(i, code, code, code) for i, code in enumerate(missed[:, 3].tolist())]
    assert sorted(map(tuple, got)) == want
    assert sorted(con.execute(f"SELECT image_id, p5, p50, p95 FROM ({Q.SQL['luma_histogram_percentiles']})").fetchall()) == want


def test_nan_and_infinity(spark):
    assert one(spark, C.linear_to_srgb8(F.lit(NAN))) == 0
    assert one(spark, C.linear_to_srgb8(F.lit(INF))) == 255
    px = spark.createDataFrame([(1, 0, i, g) for i, g in enumerate([1.0, NAN, INF, 3.0, -INF])], "image_id long, y int, x int, gain double")
    r = D.gain_range(px)
    assert tuple(r.first()) == (1, 1.0, 3.0)
    codes = N.codes(N.normalise(np.array([1.0, NAN, INF, 3.0, -INF]), 1.0, 3.0))
    assert codes.tolist() == [0, 0, 255, 255, 0]
    none = spark.createDataFrame([(1, 0, 0, NAN)], "image_id long, y int, x int, gain double")
    assert tuple(D.gain_range(none).first()) == (1, 0.0, 0.0)
    assert N.codes(N.normalise(np.array([NAN]), 0.0, 0.0)).tolist() == [0]


def test_kernels_are_the_expressions(spark):
    """Arrays and columns give the same numbers, odd ones included."""
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.gamma(1, 2, (500, 3)), [[0, 0, 0], [NAN, 1, 1], [INF, 0, 0], [-1, -2, 3], [1e-7, 0, 0], [0.0031308, 0.04045, 1]]])
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(v)], "i long, r double, g double, b double")
    rgb = tuple(map(F.col, "rgb"))
    for white, arg in ((F.lit(5.0), np.full(len(v), 5.0)), (None, None)):
        got = df.select("i", *C.tone_map(*rgb, white)).orderBy("i").collect()
        assert [list(r[1:]) for r in got] == np.stack(N.tone_map(*v.T, arg), axis=1).tolist()
    got = df.select("i", G.log2_gain(C.positive(F.col("r")), C.positive(F.col("g"))), G.normalise(F.col("b"), F.lit(0.5), F.lit(2.0), 0.7), G.apply_gain(F.col("r"), G.decode(F.lit(0.3), F.lit(0.5), F.lit(2.0), 0.7))).orderBy("i").collect()
    want = np.stack([N.log2_gain(N.positive(v[:, 0]), N.positive(v[:, 1])), N.normalise(v[:, 2], 0.5, 2.0, 0.7), N.apply_gain(v[:, 0], N.decode(0.3, 0.5, 2.0, 0.7))], axis=1)
    assert np.allclose([r[1:] for r in got], want, rtol=1e-12, equal_nan=True)


@pytest.mark.parametrize("band", [12, 48])
@pytest.mark.parametrize("subsample", [1, 2, 3])
def test_bands_change_nothing(spark, monkeypatch, band, subsample):
    """An image in bands against the whole of it in one array."""
    from lumaframe.operators import frames

    for module in (L, frames):
        monkeypatch.setattr(module, "BAND", band)
    tiles = scene(spark, 50, 70, 6.0)
    rows = sorted(tiles.collect(), key=lambda r: r["y0"])
    assert len(rows) == -(-70 // band)
    r, g, b = (np.concatenate([np.frombuffer(x[c]) for x in rows]) for c in "rgb")
    white = np.full(len(r), max(1.0, N.luma(r, g, b).max()))
    base = N.tone_map(r, g, b, white)
    gain = N.log2_gain(N.luma(r, g, b), N.luma(*(N.LINEAR[c] for c in base)))
    t = N.normalise(gain, gain.min(), gain.max()).reshape(70, 50)
    gh, gw = -(-70 // subsample), -(-50 // subsample)
    plane = N.codes(np.array([[t[y * subsample : (y + 1) * subsample, x * subsample : (x + 1) * subsample].mean() for x in range(gw)] for y in range(gh)]))
    lit = L.with_white(tiles)
    got = np.zeros((gh, gw), int)
    for x in L.plane_rows(L.gain_plane(lit, L.gain_range(lit), subsample)).collect():
        got[x["gy"], x["gx"]] = x["code"]
    assert (got == plane).all()

    def at(n, size):
        f = (np.arange(n) + 0.5) / subsample - 0.5
        low = np.floor(f).astype(int)
        return np.clip(low, 0, size - 1), np.clip(low + 1, 0, size - 1), f - low

    y0, y1, fy = at(70, gh)
    x0, x1, fx = at(50, gw)
    up = lambda p: (p[y0] * (1 - fy)[:, None] + p[y1] * fy[:, None])
    smooth = up(plane.astype(float))[:, x0] * (1 - fx) + up(plane.astype(float))[:, x1] * fx
    light = N.luma(*(N.apply_gain(N.LINEAR[c], N.decode(smooth.reshape(-1) / 255, gain.min(), gain.max())) for c in base))
    own = N.luma(r, g, b)
    rel = np.abs(light - own)[own >= 0.05] / own[own >= 0.05]
    e = L.errors(tiles, subsample).first()
    assert e["n_pixels"] == len(rel) and e["worst"] == pytest.approx(rel.max()) and e["p999"] == pytest.approx(np.sort(rel)[int(len(rel) * 0.999)]) and e["p50"] == pytest.approx(np.sort(rel)[len(rel) // 2])
    deciles = {x["decile"]: (x["n"], x["diff"]) for x in L.group_differences(tiles, subsample).collect()}
    for k, part in enumerate(np.array_split(np.argsort(own, kind="stable"), 10), 1):
        assert deciles[k][0] == len(part) and deciles[k][1] == pytest.approx((light - own)[part].mean(), abs=1e-9)


def test_delta_e_published_pairs(spark):
    """From the supplementary data of Sharma, Wu and Dalal (2005)."""
    for one_lab, two_lab, want in (((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, 0, 0), (50, -1, 2), 2.3669), ((50, 2.5, 0), (73, 25, -18), 27.1492), ((2.0776, 0.0795, -1.1350), (0.9033, -0.0636, -0.5514), 0.9082)):
        df = spark.createDataFrame([tuple(map(float, one_lab + two_lab))], "a double, b double, c double, d double, e double, f double")
        assert C.with_delta_e(df, ("a", "b", "c"), ("d", "e", "f")).first()["de"] == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("h", [1.0, 1.5, 2.0, 4.0, 4.88, 7.9, 8.0])
def test_tags_round_trip(spark, h):
    assert one(spark, H.headroom_from_tags(F.lit(1.0), H.tag48_from_headroom(F.lit(h)))) == pytest.approx(h, abs=0.01)


def test_tags_saturate(spark):
    assert one(spark, H.tag48_from_headroom(F.lit(11.86))) == 0
    assert one(spark, H.headroom_from_tags(F.lit(1.0), F.lit(-1e30))) == 2.0**16
    assert one(spark, H.headroom_from_tags(F.lit(1.0), F.lit(NAN))) == 1.0


#: The 62 bytes of a camera's payload: a version byte, then the structure.
PAYLOAD = "000000000040" + "00000000000F4240" + "0022E605000F4240" + "FFFFF855000F4240" + "0022E605000F4240" + "000C9954000F4240" + "0000000A000F4240" + "0000000A000F4240"


def test_camera_payload(spark):
    p = I.parse(F.lit(PAYLOAD[2:]))
    row = spark.range(1).select(*(c.alias(n) for n, c in p.items())).first()
    assert row["error"] is None and row["base_space"]
    assert [row[k] for k in ("base_headroom", "alt_headroom", "min_log2", "max_log2", "gamma", "base_offset", "alt_offset")] == pytest.approx([0, 2.287109, -0.001963, 2.287109, 0.825684, 1e-5, 1e-5])
    assert one(spark, I.expected_length(F.lit(PAYLOAD))) == len(PAYLOAD) // 2 == 62


def test_every_truncation_is_an_error(spark):
    rows = spark.range(0, 121).select(I.parse(F.substring(F.lit(PAYLOAD[2:]), F.lit(1), F.col("id").cast("int")))["error"].alias("e")).collect()
    assert all(r["e"] == "truncated" for r in rows)


def test_sizes(spark):
    for text, want in (("4MB", 4_000_000), ("4MiB", 4 << 20), ("3.5m", 3_500_000), ("1500000", 1_500_000), ("banana", None), ("4PB", None), ("", None)):
        assert one(spark, T.parse_size(F.lit(text))) == want


def test_bytes_are_rounded_as_printed(spark):
    """Python prints the exact value of a double too. All halves up to 3 GB, then large ones."""
    values = [*range(1_050_000, 3_000_000_000, 100_000), *range(500, 1_000_000, 500), *(10**k + d for k in range(19) for d in (-1, 0, 50_000, 250_000, 750_000)), 2**63 - 1]
    rows = spark.createDataFrame([(n,) for n in values], "n long").select("n", T.human_bytes(F.col("n")).alias("s")).collect()
    want = lambda n: f"{n / 1e6:.1f} MB" if n >= 1_000_000 else f"{n / 1e3:.0f} KB" if n >= 1_000 else f"{n} B"
    assert [tuple(r) for r in rows if r["s"] != want(r["n"])] == []
    assert one(spark, T.human_bytes(F.lit(None).cast("long"))) is None


def test_peak_ignores_a_hot_pixel(spark):
    ramp = spark.range(64 * 64).select(F.lit(1).alias("image_id"), *(F.when(F.col("id") == 77, 4000.0).otherwise((F.col("id") % 64 + 0.5) / 64 * 4).alias(c) for c in "rgb"))
    assert M.peak_luma(ramp, 0.001).first()["peak"] < 8
    assert M.peak_luma(ramp, 0.0).first()["peak"] > 100
    assert M.peak_luma(ramp.where("false")).isEmpty()


def test_round_trip_of_a_scene(spark):
    """Luma comes back within 6 percent where it is above 0.05."""
    e = L.errors(scene(spark, 32, 24, 6.0), 1).first()
    assert e["worst"] < 0.06
    assert 20 * math.log10(e["peak"] / math.sqrt(e["mse"])) > 40
