"""Queries over metadata, reports and containers' relations, with the SQL each is held
against. Rows of the general tables stand in for files, items and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import gain as G
from ..functions import headroom as H
from ..functions import iso as I
from ..functions import orient as O
from ..functions import text as T
from ..functions import xmp as X
from ..sources.images import DROPPED
from . import checks as K

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _values(spark: SparkSession, words: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "s string")


def _values_sql(words: tuple[str, ...]) -> str:
    return "(VALUES " + ", ".join("('{}')".format(w.replace("'", "''")) for w in words) + ") v(s)"


# ---- headroom tags -------------------------------------------------------------------

TAGS = "SELECT DISTINCT l_discount * 20 AS t33, l_tax - 0.02 AS t48 FROM lineitem"
STOPS = "CASE WHEN t33 < 1 THEN CASE WHEN t48 <= 0.01 THEN -20.0 * t48 + 1.8 ELSE -0.101 * t48 + 1.601 END ELSE CASE WHEN t48 <= 0.01 THEN -70.0 * t48 + 3.0 ELSE -0.303 * t48 + 2.303 END END"


def _tags(spark, d):
    return _t(spark, d, "lineitem").select((F.col("l_discount") * 20).alias("t33"), (F.col("l_tax") - 0.02).alias("t48")).distinct()


@query(f"WITH t AS ({TAGS}), s AS (SELECT *, {STOPS} AS st FROM t) SELECT round(t33, 6) AS t33, round(t48, 6) + 0.0 AS t48, round(st, 6) AS stops, round(pow(2.0, least(greatest(st, 0.0), 16.0)), 6) AS headroom FROM s")
def apple_tags_decode(spark, d):
    a, b = F.col("t33"), F.col("t48")
    return _tags(spark, d).select(F.round(a, 6).alias("t33"), (F.round(b, 6) + 0.0).alias("t48"), F.round(H.stops_from_tags(a, b), 6).alias("stops"), F.round(H.headroom_from_tags(a, b), 6).alias("headroom"))


HEAD = "1 + o_totalprice / 40000"
_MEET = (70.0 * 2.303 - 0.303 * 3.0) / (70.0 - 0.303)
ENC = f"CASE WHEN st >= 3 THEN 0.0 WHEN st >= {_MEET!r}::DOUBLE THEN (3.0 - st) / 70.0 ELSE (2.303 - st) / 0.303 END"


@query(f"WITH s AS (SELECT o_orderkey, log2(least(greatest({HEAD}, 1.0), 16.0)) AS st FROM orders) SELECT o_orderkey, round(greatest({ENC}, 0.0), 6) AS tag48 FROM s")
def apple_tags_encode(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", F.round(H.tag48_from_headroom(1 + F.col("o_totalprice") / 40000), 6).alias("tag48"))


@query(f"WITH s AS (SELECT o_orderkey, {HEAD} AS h, log2(least(greatest({HEAD}, 1.0), 16.0)) AS st FROM orders) SELECT floor(h)::BIGINT AS band, count(*) AS n, round(max(least(h, 8.0)), 5) AS most, true AS close FROM s GROUP BY 1")
def apple_roundtrip(spark, d):
    """Encoding then decoding gives the headroom back, up to 8x."""
    h = 1 + F.col("o_totalprice") / 40000
    back = H.headroom_from_tags(F.lit(1.0), H.tag48_from_headroom(h))
    near = F.abs(back - F.least(F.greatest(h, F.lit(1.0)), F.lit(8.0))) < 0.01
    return _t(spark, d, "orders").groupBy(F.floor(h).alias("band")).agg(F.count("*").alias("n"), F.round(F.max(F.least(h, F.lit(8.0))), 5).alias("most"), F.every(near).alias("close"))


# ---- orientation ---------------------------------------------------------------------


@query("""SELECT i::INTEGER AS orientation, CASE i WHEN 3 THEN 2 WHEN 5 THEN 1 WHEN 6 THEN 3 WHEN 7 THEN 1 WHEN 8 THEN 1 ELSE 0 END AS rot, CASE i WHEN 2 THEN 1 WHEN 4 THEN 0 WHEN 5 THEN 0 WHEN 7 THEN 1 END AS mirror,
CASE WHEN i BETWEEN 1 AND 8 THEN i ELSE 1 END::INTEGER AS back FROM range(0, 11) t(i)""")
def orientation_map(spark, d):
    o = F.col("id").cast("int")
    return spark.range(11).select(o.alias("orientation"), O.rotation(o).alias("rot"), O.mirror(o).alias("mirror"), O.orientation_of(O.rotation(o), O.mirror(o)).alias("back"))


@query("""WITH g AS (SELECT o, x, y FROM range(1, 9) a(o), range(5) b(x), range(3) c(y)) SELECT o::INTEGER AS o, x::INTEGER AS x, y::INTEGER AS y,
(CASE o WHEN 1 THEN x WHEN 2 THEN 4 - x WHEN 3 THEN 4 - x WHEN 4 THEN x WHEN 5 THEN y WHEN 6 THEN 2 - y WHEN 7 THEN 2 - y ELSE y END)::INTEGER AS tx,
(CASE o WHEN 1 THEN y WHEN 2 THEN y WHEN 3 THEN 2 - y WHEN 4 THEN 2 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 4 - x ELSE 4 - x END)::INTEGER AS ty FROM g""")
def orientation_coords(spark, d):
    """Turning and mirroring as the container does, against what Exif says."""
    o, x, y = (F.col("id") % 8 + 1).cast("int"), (F.floor(F.col("id") / 8) % 5).cast("int"), F.floor(F.col("id") / 40).cast("int")
    tx, ty = O.transformed(x, y, F.lit(5), F.lit(3), O.rotation(o), O.mirror(o))
    return spark.range(120).select(o.alias("o"), x.alias("x"), y.alias("y"), tx.cast("int").alias("tx"), ty.cast("int").alias("ty"))


# ---- gain weights and delivery ----------------------------------------------------------

HR = "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 1.0 ELSE 0.0 END AS base, round(abs(s_acctbal) / 2500, 2) AS alt, round(s_acctbal / 2500, 2) AS mx FROM supplier"
_W = "CASE WHEN alt = base THEN 0.0 ELSE least(greatest((d - base) / (alt - base), 0.0), 1.0) * CASE WHEN alt < base THEN -1.0 ELSE 1.0 END END"
_DISPLAYS = "(VALUES (1.0::DOUBLE), (1.5), (2.0), (2.3), (2.98), (4.0)) dd(d)"


def _heads(spark, d):
    s, bal = F.col("s_suppkey"), F.col("s_acctbal")
    return _t(spark, d, "supplier").select(s.alias("id"), F.when(s % 5 == 0, 1.0).otherwise(0.0).alias("base"), F.round(F.abs(bal) / 2500, 2).alias("alt"), F.round(bal / 2500, 2).alias("mx"))


@query(f"WITH h AS ({HR}) SELECT id, d AS display, round({_W}, 6) + 0.0 AS weight FROM h, {_DISPLAYS}")
def gain_weight_sweep(spark, d):
    """Every file on every display: the displays are a fixed array, not a join."""
    h = _heads(spark, d).withColumn("display", F.explode(F.array(*map(F.lit, G.DISPLAYS))))
    return h.select("id", "display", (F.round(G.gain_weight(F.col("base"), F.col("alt"), F.col("display")), 6) + 0.0).alias("weight"))


@query(f"""WITH h AS ({HR}), e AS (SELECT id, d, abs(greatest(mx, 0.0) * {_W} - least(d, greatest(mx, 0.0))) AS err FROM h, {_DISPLAYS}) SELECT id, round(max(err), 6) AS worst, max(err) <= 1e-3 AS ok FROM e GROUP BY id""")
def display_delivery_worst(spark, d):
    worst, _ = K.delivery_error(F.col("base"), F.col("alt"), F.col("mx"))
    return _heads(spark, d).select("id", F.round(worst, 6).alias("worst"), (worst <= 1e-3).alias("ok"))


@query(f"WITH h AS ({HR}) SELECT id, abs(greatest(mx, 0.0) - alt) < 1e-3 AS consistent, round(greatest(mx, 0.0), 6) AS retargeted FROM h")
def headroom_consistent(spark, d):
    want = F.greatest(F.col("mx"), F.lit(0.0))
    return _heads(spark, d).select("id", (F.abs(want - F.col("alt")) < 1e-3).alias("consistent"), F.round(want, 6).alias("retargeted"))


@query(f"""WITH h AS ({HR}), r AS (SELECT base AS rb, alt AS ra, mx AS rm FROM h WHERE id = 1), e AS (SELECT id, abs(alt - ra) AS apart, greatest(rm, 0.0) * {_W.replace('alt', 'ra').replace('base', 'rb')} - greatest(mx, 0.0) * {_W} AS deficit FROM h, r, {_DISPLAYS})
SELECT id, CASE WHEN max(apart) >= 1e-3 THEN 'skip' WHEN max(deficit) < 1e-3 THEN 'pass' ELSE 'fail' END AS status FROM e GROUP BY id""")
def reference_comparison(spark, d):
    """Against one reference file of equal headroom; the reference is a single row."""
    h = _heads(spark, d)
    one = h.where("id = 1").select(F.col("base").alias("rb"), F.col("alt").alias("ra"), F.col("mx").alias("rm")).limit(1)
    c = F.col
    deficit = F.greatest(*(F.greatest(c("rm"), F.lit(0.0)) * G.gain_weight(c("rb"), c("ra"), F.lit(x)) - F.greatest(c("mx"), F.lit(0.0)) * G.gain_weight(c("base"), c("alt"), F.lit(x)) for x in G.DISPLAYS))
    return h.join(F.broadcast(one)).select("id", F.when(F.abs(c("alt") - c("ra")) >= 1e-3, "skip").when(deficit < 1e-3, "pass").otherwise("fail").alias("status"))


# ---- ISO metadata ---------------------------------------------------------------------

META = "SELECT c_custkey AS id, c_acctbal / 4096 AS mx, -c_acctbal / 8192 AS mn, 0.5 + (c_custkey % 7) / 4.0::DOUBLE AS gm, 0.015625::DOUBLE AS off, c_custkey % 2 = 0 AS bs FROM customer"


def _meta(spark, d):
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    return _t(spark, d, "customer").select(k.alias("id"), (bal / 4096).alias("mx"), (-bal / 8192).alias("mn"), (0.5 + (k % 7) / 4.0).alias("gm"), F.lit(0.015625).alias("off"), (k % 2 == 0).alias("bs"))


def _word_sql(v: str, signed: bool) -> str:
    n = f"round({v} * 65536)" if signed else f"round(greatest({v}, 0.0) * 65536)"
    return f"printf('%08X', ({n}::BIGINT & 4294967295)) || '00010000'"


_CH = " || ".join((_word_sql("mn", True), _word_sql("mx", True), _word_sql("gm", False), _word_sql("off", True), _word_sql("off", True)))
HEX = f"'00000000' || CASE WHEN bs THEN '40' ELSE '00' END || {_word_sql('0.0', False)} || {_word_sql('mx', False)} || {_CH}"


def _hex(three: bool = False):
    ch = {"min_log2": F.col("mn"), "max_log2": F.col("mx"), "gamma": F.col("gm"), "base_offset": F.col("off"), "alt_offset": F.col("off")}
    return I.serialize([ch] * (3 if three else 1), F.lit(0.0), F.col("mx"), F.col("bs"))


@query(f"WITH m AS ({META}) SELECT id, {HEX} AS mono, '00000000' || CASE WHEN bs THEN 'C0' ELSE '80' END || {_word_sql('0.0', False)} || {_word_sql('mx', False)} || {' || '.join([_CH] * 3)} AS three FROM m")
def iso_serialize_hex(spark, d):
    return _meta(spark, d).select("id", _hex().alias("mono"), _hex(True).alias("three"))


@query(f"""WITH m AS ({META}) SELECT id, CASE id % 6 WHEN 1 THEN 'truncated' WHEN 2 THEN 'version' WHEN 3 THEN 'denominator' WHEN 4 THEN 'range' END AS error,
CASE WHEN id % 6 IN (0, 5) THEN round(round(mx * 65536) / 65536, 6) + 0.0 END AS max_log2, CASE WHEN id % 6 IN (0, 5) THEN round(round(greatest(mx, 0.0) * 65536) / 65536, 6) END AS alt_headroom,
CASE WHEN id % 6 IN (0, 5) THEN round(round(gm * 65536) / 65536, 6) END AS gamma, CASE WHEN id % 6 IN (0, 5) THEN bs END AS base_space FROM m""")
def iso_parse_hex(spark, d):
    """Whole payloads, and ones broken in four ways."""
    h, kind = F.col("h"), F.col("id") % 6
    broken = F.when(kind == 1, F.substring(h, 1, 80)).when(kind == 2, F.concat(F.lit("0001"), F.substring(h, 5, 400)))
    broken = broken.when(kind == 3, F.concat(F.substring(h, 1, 50), F.lit("00000000"), F.substring(h, 59, 400))).when(kind == 4, F.concat(F.substring(h, 1, 42), F.lit("00500000"), F.substring(h, 51, 400))).otherwise(h)
    p = I.parse(F.col("h2"))
    m = _meta(spark, d).select("id", _hex().alias("h")).select("id", broken.alias("h2"))
    return m.select("id", p["error"].alias("error"), (F.round(p["max_log2"], 6) + 0.0).alias("max_log2"), F.round(p["alt_headroom"], 6).alias("alt_headroom"), F.round(p["gamma"], 6).alias("gamma"), p["base_space"].alias("base_space"))


_THREE = " || ".join(" || ".join((_word_sql(f"mn - {c} / 8.0", True), _word_sql(f"mx + {c} / 8.0", True), _word_sql(f"gm + {c} / 4.0", False), _word_sql("off", True), _word_sql("off", True))) for c in range(3))


@query(f"""WITH m AS ({META}) SELECT id, CASE WHEN id % 5 = 4 THEN 'denominator' END AS error, CASE WHEN id % 5 <> 4 THEN CASE WHEN id % 2 = 0 THEN 3 ELSE 1 END END AS channels,
CASE WHEN id % 5 <> 4 THEN round(round((mx + CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END / 8.0) * 65536) / 65536, 6) + 0.0 END AS greatest_max, CASE WHEN id % 5 <> 4 THEN round(round((mn - CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END / 8.0) * 65536) / 65536, 6) + 0.0 END AS least_min,
CASE WHEN id % 5 <> 4 THEN round(round((gm + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END / 4.0) * 65536) / 65536, 6) END AS second_gamma FROM m""")
def iso_parse_channels(spark, d):
    """Payloads of one channel and of three that differ; the last one of some is broken."""
    ch = [{"min_log2": F.col("mn") - c / 8, "max_log2": F.col("mx") + c / 8, "gamma": F.col("gm") + c / 4, "base_offset": F.col("off"), "alt_offset": F.col("off")} for c in range(3)]
    made = F.when(F.col("id") % 2 == 0, I.serialize(ch, F.lit(0.0), F.col("mx"), F.col("bs"))).otherwise(I.serialize(ch[:1], F.lit(0.0), F.col("mx"), F.col("bs")))
    whole = _meta(spark, d).select("id", made.alias("h"))
    h = whole.select("id", F.when(F.col("id") % 5 == 4, F.concat(F.substring("h", F.lit(1), F.length("h") - 8), F.lit("00000000"))).otherwise(F.col("h")).alias("h"))
    p = I.parse_channels(F.col("h"))
    return h.select("id", p["error"].alias("error"), F.when(p["error"].isNull(), F.size(p["max_log2"])).alias("channels"), (F.round(F.array_max(p["max_log2"]), 6) + 0.0).alias("greatest_max"), (F.round(F.array_min(p["min_log2"]), 6) + 0.0).alias("least_min"), F.round(I.channel_of(p["gamma"], 1), 6).alias("second_gamma"))


@query(f"WITH m AS ({META}) SELECT id, CASE WHEN id % 3 = 0 THEN 142 ELSE 62 END AS want, CASE WHEN id % 3 = 0 THEN 142 ELSE 62 END AS have FROM m")
def payload_length(spark, d):
    """Lengths that the flags ask for, of payloads of one and three channels."""
    m = _meta(spark, d).select("id", F.concat(F.lit("00"), F.when(F.col("id") % 3 == 0, _hex(True)).otherwise(_hex())).alias("h"))
    return m.select("id", I.expected_length(F.col("h")).alias("want"), F.floor(F.length("h") / 2).cast("int").alias("have"))


@query(f"WITH m AS ({META}) SELECT id, id % 2 = 0 AS identical FROM m")
def channels_identical(spark, d):
    k = F.col("id")
    return _meta(spark, d).select("id", I.channels_identical([F.array("mx", "mx", F.when(k % 2 == 0, F.col("mx")).otherwise(F.col("mx") + 1)), F.array("gm", "gm", "gm")]).alias("identical"))


@query(f"WITH m AS ({META}) SELECT id, CASE WHEN abs(mx * 40) > 64 THEN 'max_log2 out of range' END AS error FROM m")
def range_validation(spark, d):
    v = F.col("mx") * 40
    return _meta(spark, d).select("id", F.when(~C.is_finite(v) | (F.abs(v) > I.MOST), "max_log2 out of range").alias("error"))


# ---- XMP ------------------------------------------------------------------------------

_DESC = f"""'<rdf:Description rdf:about="" xmlns:HDRGainMap="{X.NAMESPACE}" HDRGainMap:HDRGainMapVersion="{X.VERSION}" HDRGainMap:HDRGainMapHeadroom="' || format('{{:.6f}}', pow(2.0, st)) || '"/>'"""
NS = "SELECT n_nationkey AS id, n_nationkey / 8.0::DOUBLE AS st FROM nation"


def _stops(spark, d):
    return _t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") / 8.0).alias("st"))


@query(f"WITH n AS ({NS}) SELECT id, '{X._HEAD}' || {_DESC} || '{X._TAIL}' AS packet FROM n")
def xmp_headroom_packet(spark, d):
    return _stops(spark, d).select("id", X.packet(F.col("st")).alias("packet"))


SRC = "CASE id % 3 WHEN 0 THEN '<a><rdf:RDF><rdf:RDF>x</rdf:RDF> y</rdf:RDF></a>' WHEN 1 THEN 'no close here' ELSE '<rdf:RDF></rdf:RDF>' END"


@query(f"WITH n AS ({NS}) SELECT id, CASE id % 3 WHEN 0 THEN '<a><rdf:RDF><rdf:RDF>x</rdf:RDF> y' || {_DESC} || '</rdf:RDF></a>' WHEN 2 THEN '<rdf:RDF>' || {_DESC} || '</rdf:RDF>' END AS merged FROM n")
def xmp_merge(spark, d):
    return _stops(spark, d).withColumn("src", F.expr(SRC)).select("id", X.merge(F.col("src"), F.col("st")).alias("merged"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE n_nationkey + 0.5::DOUBLE END AS value FROM nation")
def xmp_attr_extract(spark, d):
    """Attributes in either quote, elements, and hits that are no numbers."""
    k = F.col("n_nationkey")
    v = (k + 0.5).cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit('xmlns:HDRGainMapHeadroom="http" a:HDRGainMapHeadroom = "'), v, F.lit('"'))).when(k % 4 == 1, F.concat(F.lit("HDRGainMapHeadroom='"), v, F.lit("'")))
    text = text.when(k % 4 == 2, F.concat(F.lit("<h:HDRGainMapHeadroom> "), v, F.lit("</h:HDRGainMapHeadroom>"))).otherwise(F.lit('HDRGainMapHeadroom="none"'))
    return _t(spark, d, "nation").select(k.alias("id"), X.value_of(text, X.PROPERTY).alias("value"))


@query("SELECT page_id, regexp_extract(html, 'href=\"([^\"]*)\"', 1) AS first_href, len(regexp_extract_all(html, 'href=')) ::INTEGER AS n_href FROM pages")
def page_attributes(spark, d):
    """First value of an attribute and how often it is given, over whole pages."""
    p = _t(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("html", 'href="([^"]*)"', 1).alias("first_href"), F.regexp_count("html", F.lit("href=")).alias("n_href"))


# ---- text -----------------------------------------------------------------------------

SIZES = ("4MB", "4MiB", "4 mib", "3.5m", "1500000", "512k", "", "banana", "4PB", "1.5GiB", "7b", " 12 kb ", ".5g", "1.2.3m", "-4MB", "2gb")
_UNIT = " ".join(f"WHEN '{u}' THEN {v!r}::DOUBLE" for u, v in T.UNITS.items())


@query(f"""WITH v AS (SELECT s, trim(s) AS t FROM {_values_sql(SIZES)}), p AS (SELECT s, regexp_extract(t, '^([0-9.]*)', 1) AS n, lower(trim(regexp_extract(t, '^[0-9.]*(.*)$', 1))) AS u FROM v)
SELECT s, floor(TRY_CAST(n AS DOUBLE) * CASE u {_UNIT} END)::BIGINT AS bytes FROM p""")
def parse_size(spark, d):
    return _values(spark, SIZES).select("s", T.parse_size(F.col("s")).alias("bytes"))


@query("SELECT o_orderkey, CASE WHEN n >= 1000000 THEN format('{:.1f} MB', n / 1e6::DOUBLE) WHEN n >= 1000 THEN format('{:.0f} KB', n / 1e3::DOUBLE) ELSE n::VARCHAR || ' B' END AS size FROM (SELECT o_orderkey, (o_orderkey * 7919) % 3000001 + 50 AS n FROM orders)")
def human_bytes(spark, d):
    n = (F.col("o_orderkey") * 7919) % 3000001 + 50
    return _t(spark, d, "orders").select("o_orderkey", T.human_bytes(n).alias("size"))


NAMES = ("sRGB", "BT.709", "rec-709", "Display P3", "display_p3", "P3", "bt2020", "Rec.2020", "AdobeRGB", "", "apple", "IOS", "iso", "both", "software", "Software", "VideoToolbox", "clip", "Reinhard", "1", "100", "101", "0", "85")


def _case(expr: str, table: dict[str, str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


@query(f"""SELECT s, {_case("lower(replace(replace(replace(replace(s, '-', ''), '_', ''), '.', ''), ' ', ''))", T.PRIMARY_NAMES)} AS primaries, {_case('lower(s)', T.FLAVORS)} AS flavor, {_case('lower(s)', T.ENGINES)} AS engine, {_case('lower(s)', T.TONE_MAPS)} AS tone_map,
CASE WHEN TRY_CAST(s AS INTEGER) BETWEEN 1 AND 100 THEN TRY_CAST(s AS INTEGER) END AS quality FROM {_values_sql(NAMES)}""")
def parse_names(spark, d):
    s = F.col("s")
    return _values(spark, NAMES).select("s", T.parse_primaries(s).alias("primaries"), T.choose(s, T.FLAVORS).alias("flavor"), T.choose(s, T.ENGINES).alias("engine"), T.choose(s, T.TONE_MAPS).alias("tone_map"), T.parse_quality(s).alias("quality"))


@query("SELECT p_partkey, chr((65 + p_partkey % 26)::INTEGER) || chr((97 + p_partkey % 7)::INTEGER) || '01' AS code FROM part")
def fourcc(spark, d):
    k = F.col("p_partkey")
    return _t(spark, d, "part").select("p_partkey", T.fourcc((65 + k % 26) * 16777216 + (97 + k % 7) * 65536 + 0x3031).alias("code"))


@query("SELECT o_orderkey, CASE WHEN st >= 256 AND st % 256 = 0 THEN st // 256 ELSE st END::BIGINT AS code FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 9) * 256 ELSE o_orderkey % 300 END AS st FROM orders)")
def exit_status(spark, d):
    k = F.col("o_orderkey")
    return _t(spark, d, "orders").select("o_orderkey", T.exit_code(F.when(k % 3 == 0, (k % 9) * 256).otherwise(k % 300)).alias("code"))


@query("SELECT doc_id, coalesce(list_last(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))), '') AS last_line FROM documents")
def failure_summary(spark, d):
    """The last line of a text that says anything."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return _t(spark, d, "documents").select("doc_id", F.coalesce(F.get(lines, F.size(lines) - 1), F.lit("")).alias("last_line"))


@query("SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'derived' WHEN 1 THEN 'embedded' WHEN 2 THEN 'derived' END AS source FROM nation")
def gain_map_source(spark, d):
    """From the JSON report first, else from a line of text at its start, else NULL."""
    k = F.col("n_nationkey")
    text = F.when(k % 4 == 0, '{"gain_map_source": "derived", "ok": true}').when(k % 4 == 1, "ok\ngain map: transcoded, not derived").when(k % 4 == 2, "  gain map: derived").otherwise("said: gain map: derived")
    word = F.regexp_extract(text, r"(?m)^\s*gain map:\s*([a-z]+)", 1)
    prose = F.when(word == "transcoded", "embedded").when(word == "derived", "derived")
    return _t(spark, d, "nation").select(k.alias("id"), F.coalesce(F.get_json_object(F.when(F.substring(text, 1, 1) == "{", text), "$.gain_map_source"), prose).alias("source"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT json_extract_string(props, '$.page')) AS n_pages FROM events GROUP BY event_type")
def json_reports(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct(F.get_json_object("props", "$.page")).alias("n_pages"))


@query("SELECT text, count(*) AS n, min(conv_id * 10000 + turn) AS first_seen FROM conversations GROUP BY text")
def advisory_dedup(spark, d):
    """Each message once, with how often it came and when first."""
    return _t(spark, d, "conversations").groupBy("text").agg(F.count("*").alias("n"), F.min(F.col("conv_id") * 10000 + F.col("turn")).alias("first_seen"))


# ---- batches --------------------------------------------------------------------------

PATHS = "SELECT 'dir' || n_regionkey || '/img' || (n_nationkey % 9) || CASE n_nationkey % 3 WHEN 0 THEN '.tif' WHEN 1 THEN '.a.png' ELSE '' END AS path, n_nationkey FROM nation"


@query(f"WITH p AS ({PATHS}), o AS (SELECT path, regexp_replace(list_last(string_split(path, '/')), '\\.[^.]*$', '') || '.heic' AS out FROM p) SELECT out, count(*) AS n, string_agg(path, ',' ORDER BY path) AS paths FROM o GROUP BY out HAVING count(*) > 1")
def output_collisions(spark, d):
    """Inputs that would write one output. Names are counted first; only those that
    collide gather their paths."""
    k = F.col("n_nationkey")
    path = F.concat(F.lit("dir"), F.col("n_regionkey").cast("string"), F.lit("/img"), (k % 9).cast("string"), F.when(k % 3 == 0, ".tif").when(k % 3 == 1, ".a.png").otherwise(""))
    out = _t(spark, d, "nation").select(path.alias("path")).withColumn("out", T.output_name(F.col("path")))
    twice = out.groupBy("out").agg(F.count("*").alias("n")).where("n > 1").select("out")
    return out.join(twice, "out", "left_semi").groupBy("out").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"))


@query("SELECT o_orderpriority AS batch, sum((o_orderstatus <> 'F')::INTEGER)::BIGINT AS converted, sum((o_orderstatus = 'F')::INTEGER)::BIGINT AS failed, round(sum(o_totalprice) / 1e5, 4) AS seconds, round(count(*) / (sum(o_totalprice) / 1e5) * 60, 4) AS per_minute FROM orders GROUP BY o_orderpriority")
def batch_summary(spark, d):
    sec = F.sum("o_totalprice") / 1e5
    return _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("batch")).agg(F.count_if(F.col("o_orderstatus") != "F").alias("converted"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"), F.round(sec, 4).alias("seconds"), F.round(F.count("*") / sec * 60, 4).alias("per_minute"))


@query("""SELECT l_returnflag AS engine, count(*) AS n, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS least, max(l_quantity) AS most, arg_min(l_quantity, l_orderkey * 10 + l_linenumber) AS first, round(avg(CASE WHEN l_linenumber > 1 THEN l_quantity END), 6) AS warm, round(12.19 * count(*) / sum(l_quantity), 6) AS mp_per_s FROM lineitem GROUP BY l_returnflag""")
def bench_stats(spark, d):
    q = F.col("l_quantity")
    return _t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("engine")).agg(
        F.count("*").alias("n"), F.round(F.avg(q), 6).alias("mean"), F.min(q).alias("least"), F.max(q).alias("most"), F.min_by(q, F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first"),
        F.round(F.avg(F.when(F.col("l_linenumber") > 1, q)), 6).alias("warm"), F.round(12.19 * F.count("*") / F.sum(q), 6).alias("mp_per_s"),
    )


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '10 bits a sample; the hardware takes 8' WHEN p_partkey % 100 >= 95 THEN 'whole chroma asked for; the hardware subsamples' END AS reason,
CASE WHEN p_partkey % 4 = 0 OR p_partkey % 100 >= 95 THEN 'software' ELSE 'hardware' END AS engine, CASE WHEN p_partkey % 100 >= 95 THEN '4:4:4' ELSE '4:2:0' END AS chroma FROM part""")
def codec_support(spark, d):
    k = F.col("p_partkey")
    quality = k % 100
    reason = F.when(k % 4 == 0, "10 bits a sample; the hardware takes 8").when(quality >= T.CHROMA_QUALITY, "whole chroma asked for; the hardware subsamples")
    return _t(spark, d, "part").select("p_partkey", reason.alias("reason"), F.when(reason.isNull(), "hardware").otherwise("software").alias("engine"), T.chroma_for(quality).alias("chroma"))


# ---- relations of a container ---------------------------------------------------------

ITEMS = "SELECT p_partkey AS item_id, CASE p_partkey % 5 WHEN 0 THEN 'hvc1' WHEN 1 THEN 'mime' WHEN 2 THEN 'Exif' WHEN 3 THEN 'uri ' ELSE 'tmap' END AS item_type FROM part"
REFS = "SELECT l_partkey AS from_id, l_suppkey AS to_id, CASE l_linenumber % 3 WHEN 0 THEN 'cdsc' WHEN 1 THEN 'auxl' ELSE 'dimg' END AS ref_type, l_orderkey * 10 + l_linenumber AS ord FROM lineitem"


def _items(spark, d):
    k = F.col("p_partkey") % 5
    return _t(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.when(k == 0, "hvc1").when(k == 1, "mime").when(k == 2, "Exif").when(k == 3, "uri ").otherwise("tmap").alias("item_type"))


def _refs(spark, d):
    k = F.col("l_linenumber") % 3
    return _t(spark, d, "lineitem").select(F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id"), F.when(k == 0, "cdsc").when(k == 1, "auxl").otherwise("dimg").alias("ref_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


@query(f"WITH i AS ({ITEMS}), r AS ({REFS}) SELECT item_id, item_type FROM i WHERE item_id IN (SELECT from_id FROM r WHERE ref_type = 'cdsc' AND to_id = 7) AND item_type NOT IN ('hvc1', 'Exif', 'tmap')")
def describing_items_semi_join(spark, d):
    """Items that describe the primary one and are not images or Exif."""
    about = _refs(spark, d).where("ref_type = 'cdsc' AND to_id = 7")
    return _items(spark, d).where(~F.col("item_type").isin("hvc1", "Exif", "tmap")).join(about, F.col("item_id") == F.col("from_id"), "left_semi")


@query(f"SELECT p_partkey AS tag, p_size AS typ FROM part WHERE p_partkey NOT IN {tuple(sorted(DROPPED))} AND p_size BETWEEN 1 AND 12")
def exif_denylist_anti_join(spark, d):
    drop = spark.createDataFrame([(t,) for t in DROPPED], "tag long")
    return _t(spark, d, "part").select(F.col("p_partkey").alias("tag"), F.col("p_size").alias("typ")).where("typ BETWEEN 1 AND 12").join(F.broadcast(drop), "tag", "left_anti")


@query(f"WITH i AS ({ITEMS}), r AS ({REFS}) SELECT i.item_id, count(r.to_id) AS n, arg_max(r.to_id, r.ord) AS last_to, count(DISTINCT r.to_id) AS n_to FROM i LEFT JOIN r ON r.from_id = i.item_id AND r.ref_type = 'auxl' GROUP BY i.item_id")
def item_prop_join(spark, d):
    """Associations of each item; of several the last one counts."""
    r = _refs(spark, d).where("ref_type = 'auxl'").groupBy("from_id").agg(F.count("*").alias("n"), F.max_by("to_id", "ord").alias("last_to"), F.countDistinct("to_id").alias("n_to"))
    zero = F.lit(0).cast("long")
    return _items(spark, d).join(r, F.col("item_id") == F.col("from_id"), "left").select("item_id", F.coalesce("n", zero).alias("n"), "last_to", F.coalesce("n_to", zero).alias("n_to"))


@query(f"""WITH r AS ({REFS}), a AS (SELECT from_id, arg_min(to_id, ord) AS aux FROM r WHERE ref_type = 'auxl' GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY ord) AS k FROM r WHERE ref_type = 'dimg'), t AS (SELECT from_id, to_id AS second FROM n WHERE k = 2)
SELECT item_id, coalesce(aux, second) AS gain FROM ({ITEMS}) i LEFT JOIN a ON a.from_id = item_id LEFT JOIN t ON t.from_id = item_id""")
def gain_item_coalesce(spark, d):
    """The gain item: the auxiliary, else the second input of the tone-mapped item."""
    r = _refs(spark, d)
    both = r.where("ref_type IN ('auxl', 'dimg')").groupBy("from_id").agg(F.min_by(F.when(F.col("ref_type") == "auxl", F.col("to_id")), F.when(F.col("ref_type") == "auxl", F.col("ord"))).alias("aux"), F.get(F.array_sort(F.collect_list(F.when(F.col("ref_type") == "dimg", F.struct("ord", "to_id")))), F.lit(1)).alias("second"))
    return _items(spark, d).join(both, F.col("item_id") == F.col("from_id"), "left").select("item_id", F.coalesce("aux", "second.to_id").alias("gain"))


@query("""SELECT p_partkey, (p_partkey % 3 + 1)::INTEGER AS profile, (p_partkey % 4)::INTEGER AS chroma, (8 + p_partkey % 5)::INTEGER AS depth FROM part""")
def hvcc_fields(spark, d):
    """Profile, chroma format and bit depth of decoder configuration records."""
    k = F.col("p_partkey")

    def byte(c):
        return F.lpad(F.hex(c.cast("long")), 2, "0")

    record = F.concat(F.lit("01"), byte(k % 3 + 1 + 32), F.repeat(F.lit("00"), 14), byte(k % 4 + 0xFC), byte(k % 5 + 0xF8))

    def at(i: int, mask: int):
        return F.conv(F.substring("hvcc", i * 2 + 1, 2), 16, 10).cast("int").bitwiseAND(mask)

    return _t(spark, d, "part").select("p_partkey", record.alias("hvcc")).select("p_partkey", at(1, 31).alias("profile"), at(16, 3).alias("chroma"), (at(17, 7) + 8).alias("depth"))


@query("SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'bt709' WHEN 1 THEN 'display-p3' WHEN 2 THEN 'bt2020' END AS primaries FROM nation")
def icc_match_argmin(spark, d):
    """Colorants against each known set after adaptation to D50; none within 0.004 is NULL."""
    known = {p: C.multiply(C.BRADFORD, C.to_xyz(p)) for p in C.PRIMARIES}
    k = F.col("n_nationkey")
    order = list(C.PRIMARIES)
    own = [F.when(k % 4 == 3, 0.33).when(k % 4 == 0, known[order[0]][i][j] + 1e-4).when(k % 4 == 1, known[order[1]][i][j] - 1e-4).otherwise(known[order[2]][i][j]) for i in range(3) for j in range(3)]
    errors = F.array(*(F.struct(F.greatest(*(F.abs(own[3 * i + j] - known[p][i][j]) for i in range(3) for j in range(3))).alias("err"), F.lit(p).alias("p")) for p in order))
    best = F.array_min(errors)
    return _t(spark, d, "nation").select(k.alias("id"), F.when(best["err"] < 0.004, best["p"]).alias("primaries"))


# ---- rules ----------------------------------------------------------------------------

_N = "s_suppkey"
FACTS_SQL = f"""SELECT {_N} AS id, CASE WHEN {_N} % 11 <> 0 THEN 1 END AS prim, CASE WHEN {_N} % 7 = 0 THEN 'mime' ELSE 'hvc1' END AS ptype, {_N} % 13 = 0 AS hid, {_N} % 3 <> 0 AS apple, {_N} % 4 <> 0 AS iso, {_N} % 5 <> 0 AS iso_read,
round(abs(s_acctbal) / 2500, 2) AS alt, round(s_acctbal / 2500, 2) AS mx FROM supplier"""


@query(f"""WITH f AS ({FACTS_SQL}), g AS (SELECT *, iso AND iso_read AS ok FROM f) SELECT id,
CASE WHEN apple OR iso THEN 'pass' ELSE 'fail' END AS r0, CASE WHEN prim IS NOT NULL AND NOT hid AND ptype = 'hvc1' THEN 'pass' ELSE 'fail' END AS r1,
CASE WHEN NOT apple THEN 'skip' WHEN prim IS NOT NULL THEN 'pass' ELSE 'fail' END AS r3, CASE WHEN ok THEN CASE WHEN abs(alt - greatest(mx, 0.0)) <= 1e-3 THEN 'pass' ELSE 'fail' END WHEN iso THEN 'fail' ELSE 'skip' END AS r5,
CASE WHEN ok THEN 'pass' WHEN iso THEN 'fail' ELSE 'skip' END AS r6, CASE WHEN ok THEN CASE WHEN mx >= -1 THEN 'pass' ELSE 'fail' END WHEN iso THEN 'fail' ELSE 'skip' END AS r7 FROM g""")
def rule_statuses(spark, d):
    """The rule engine on facts made from rows, statuses side by side."""
    k, bal = F.col("s_suppkey"), F.col("s_acctbal")
    iso, apple, one = k % 4 != 0, k % 3 != 0, F.lit(1).cast("long")
    ok = iso & (k % 5 != 0)
    mx = F.round(bal / 2500, 2)
    none = F.lit(None)
    facts = _t(spark, d, "supplier").select(
        k.cast("string").alias("path"), F.when(k % 11 != 0, one).alias("primary"), F.when(k % 7 == 0, "mime").otherwise("hvc1").alias("primary_type"), (k % 13 == 0).alias("primary_hidden"),
        F.lit(2).cast("long").alias("gain"), F.array(F.lit(8)).alias("gain_bits"), F.when(apple, F.lit(2).cast("long")).alias("apple_aux"), F.array(one).alias("auxl_to"),
        F.when(iso, F.lit(3).cast("long")).alias("tmap"), F.array(one, F.lit(2).cast("long")).alias("tmap_dimg"), F.lit(True).alias("tmap_brand"), F.lit(62).alias("payload_len"), F.lit(62).alias("payload_want"),
        ok.alias("iso_ok"), F.lit(-1.0).alias("min_log2"), mx.alias("max_log2"), F.lit(1.0).alias("gamma"), F.lit(0.0).alias("base_headroom"), F.round(F.abs(bal) / 2500, 2).alias("alt_headroom"),
        none.cast("double").alias("xmp_headroom"), none.cast("double").alias("tag33"), none.cast("double").alias("tag48"), F.lit(True).alias("altr_ok"),
    )
    c = K.rule_statuses(facts)
    return c.groupBy(F.col("path").cast("long").alias("id")).agg(*(F.max(F.when(F.col("criterion") == n, F.col("status"))).alias(f"r{n}") for n in (0, 1, 3, 5, 6, 7)))


@query(f"""WITH f AS ({FACTS_SQL}), c AS (SELECT id, CASE WHEN iso THEN pow(2.0, alt) END AS a, CASE WHEN apple THEN pow(2.0, greatest(mx, 0.0)) END AS b, CASE WHEN id % 2 = 0 THEN pow(2.0, alt) + 0.0005 END AS c FROM f)
SELECT id, (a IS NOT NULL)::INTEGER + (b IS NOT NULL)::INTEGER + (c IS NOT NULL)::INTEGER AS copies, CASE WHEN (a IS NOT NULL)::INTEGER + (b IS NOT NULL)::INTEGER + (c IS NOT NULL)::INTEGER < 2 THEN 'skip' WHEN greatest(a, b, c) - least(a, b, c) <= 1e-3 THEN 'pass' ELSE 'fail' END AS status FROM c""")
def headroom_copies_agree(spark, d):
    k, bal = F.col("s_suppkey"), F.col("s_acctbal")
    alt = F.pow(F.lit(2.0), F.round(F.abs(bal) / 2500, 2))
    n, spread = K.copies_spread([F.when(k % 4 != 0, alt), F.when(k % 3 != 0, F.pow(F.lit(2.0), F.greatest(F.round(bal / 2500, 2), F.lit(0.0)))), F.when(k % 2 == 0, alt + 0.0005)])
    return _t(spark, d, "supplier").select(k.alias("id"), n.alias("copies"), F.when(n < 2, "skip").when(spread <= 1e-3, "pass").otherwise("fail").alias("status"))


@query("""WITH m AS (SELECT s_suppkey AS id, unnest(['exif', 'xmp', 'iptc', 'opaque']) AS kind FROM supplier), e AS (SELECT * FROM (VALUES ('hardware', 'exif', true), ('hardware', 'xmp', false), ('hardware', 'iptc', false), ('hardware', 'opaque', false), ('software', 'exif', true), ('software', 'xmp', true), ('software', 'iptc', true), ('software', 'opaque', true)) v(engine, kind, carried))
SELECT id, CASE WHEN id % 2 = 0 THEN 'hardware' ELSE 'software' END AS engine, coalesce(string_agg(CASE WHEN NOT carried THEN m.kind END, ',' ORDER BY m.kind), '') AS dropped FROM m JOIN e ON e.kind = m.kind AND e.engine = CASE WHEN id % 2 = 0 THEN 'hardware' ELSE 'software' END GROUP BY id""")
def metadata_drops(spark, d):
    """What an engine cannot carry, from its row of capabilities."""
    caps = spark.createDataFrame([("hardware", ["iptc", "opaque", "xmp"]), ("software", [])], "engine string, dropped array<string>")
    k = F.col("s_suppkey")
    files = _t(spark, d, "supplier").select(k.alias("id"), F.when(k % 2 == 0, "hardware").otherwise("software").alias("engine"))
    return files.join(F.broadcast(caps), "engine").select("id", "engine", F.array_join("dropped", ",").alias("dropped"))
