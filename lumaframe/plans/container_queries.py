"""Queries over containers that the engine writes and reads back.

Their inputs are files made from rows: planes of the embedding images, coded losslessly,
muxed, then read by both parsers. What SQL can say about such files it says.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import iso as I
from ..functions.color import pq_to_nits, srgb_to_linear
from ..functions.gain import decode
from ..operators import derive as D
from ..operators import frames as P
from ..operators import tiles as L
from ..operators.codec import DeflateCodec, encode_within, gain_quality
from ..operators.derive import attach
from ..operators.mux import MuxRequest, mux
from ..sources import boxes as B
from ..sources import carriers as M
from ..sources import images as S
from ..sources.camera import align, exif_with_note, graft, make_note, note_of, note_place, tags_for
from ..sources.gainmap_tiff import write_gain_map
from ..sources.files import parsed, resolved_items, structure, table
from ..sources.loading import tiff_light
from . import checker
from . import checks as K
from .pixel_queries import GAIN, PX

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Stops by which a headroom that is asked for may differ from the derived one unremarked.
UNREMARKED = 1e-3


def packed_images(tiles: DataFrame, subsample: int = 2, headroom: Column | None = None) -> DataFrame:
    """image_id, width, height, base (RGB bytes), gain (bytes), payload, warning: one row
    an image, its planes joined from tiles, its metadata serialised in SQL. ``headroom``
    (stops, an expression of image_id and max_log2; NULL keeps the derived one) is stated
    in its place, with a warning where it differs: displays then apply too much or too little."""
    lit = L.with_white(tiles)
    ranges = L.gain_range(lit)
    gain = L.joined_codes(L.gain_plane(lit, ranges, subsample))
    m = D.consistent_meta(ranges)
    channel = {"min_log2": F.col("min_log2"), "max_log2": F.col("max_log2"), "gamma": F.col("gamma"), "base_offset": F.col("base_offset"), "alt_offset": F.col("alt_offset")}
    asked = F.lit(None).cast("double") if headroom is None else headroom
    m = m.withColumn("asked", asked)
    payload = F.unhex(F.concat(F.lit("00"), I.serialize([channel], F.col("base_headroom"), F.coalesce("asked", "alt_headroom"), F.lit(False))))
    warning = F.when(F.abs(F.col("asked") - F.col("max_log2")) > UNREMARKED, F.format_string("headroom %.3f overrides the derived %.3f stops", "asked", "max_log2"))
    return L.joined_base(lit).join(gain, "image_id").join(m.select("image_id", payload.alias("payload"), warning.alias("warning")), "image_id")


def _request(width: int, height: int, base: bytes, gain: bytes, payload: bytes, flavor: str, quality: int, subsample: int, metadata: dict, plane_quality: int | None = None) -> MuxRequest:
    codec = DeflateCodec()
    xmp = metadata.get("xmp") or (b'<x HDRGainMapHeadroom="1.0"/>' if flavor == "apple" else None)
    coded = codec.encode(-(-width // subsample), -(-height // subsample), 1, gain, plane_quality or quality)
    return MuxRequest(codec.encode(width, height, 3, base, quality), coded, flavor, payload, exif=metadata.get("exif"), xmp=xmp)


def convert(packed: DataFrame, flavor: str = "both", quality: int = 100, subsample: int = 2) -> DataFrame:
    """path, content, error: each image's file, of any size. Columns ``exif`` and ``xmp``
    (binary), where there are any, are carried. A failure is a row, not the job's end."""
    carried = [c for c in ("exif", "xmp") if c in packed.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, errors = [], []
            for row in b.to_pylist():
                try:
                    out.append(mux(_request(row["width"], row["height"], row["base"], row["gain"], row["payload"], flavor, quality, subsample, {c: row[c] for c in carried})))
                    errors.append(None)
                except Exception as e:
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            paths = pa.array([f"image{i}.heic" for i in b["image_id"].to_pylist()])
            yield pa.RecordBatch.from_arrays([paths, pa.array(out, pa.binary()), pa.array(errors, pa.string())], ["path", "content", "error"])

    return packed.mapInArrow(run, "path string, content binary, error string")


def container_facts(files: DataFrame) -> DataFrame:
    """One row of facts for each file, by the checker's own parser."""
    schema = K.FACTS.split(",", 1)[1]
    return parsed(files, lambda d: [checker.facts("", d)[1:]], schema)


def _files(spark, d, flavor="both") -> DataFrame:
    return convert(packed_images(P.embedding_tiles(spark, d)), flavor)


IMAGES = "SELECT DISTINCT vec_id // 3 AS image_id FROM embeddings"


@query(f"SELECT 'image' || image_id || '.heic' AS path, k.type, k.n FROM ({IMAGES}), (VALUES ('ftyp', 1), ('meta', 1), ('mdat', 1), ('hdlr', 1), ('pitm', 1), ('iinf', 1), ('iref', 1), ('iprp', 1), ('ipco', 1), ('ipma', 1), ('iloc', 1), ('grpl', 1), ('altr', 1), ('hvcC', 2), ('ispe', 2), ('pixi', 2), ('colr', 1), ('auxC', 1)) k(type, n)")
def heif_boxes(spark, d):
    """How often each box stands in each file."""
    return table(_files(spark, d), "boxes").groupBy("path", "type").agg(F.count("*").cast("int").alias("n"))


@query(f"SELECT 'image' || image_id || '.heic' AS path, i.* FROM ({IMAGES}), (VALUES (1::BIGINT, 'hvc1', false, 8::BIGINT), (2, 'hvc1', true, 4), (3, 'tmap', false, 8)) i(item_id, item_type, hidden, width)")
def heif_items(spark, d):
    """Items with the width that their associated property states."""
    return resolved_items(structure(_files(spark, d))).select("path", "item_id", "item_type", "hidden", "width")


#: What container_checks does to the file of an image, by its id modulo their number, and
#: what becomes of the rules: all others pass but 8 and 9, which the file has nothing for.
FAULTS: tuple[tuple[str, dict[int, str]], ...] = (
    ("none", {}), ("gain of 10 bits", {2: "fail"}), ("auxiliary type", {3: "skip"}), ("brand", {4: "fail"}), ("alternate headroom", {5: "fail", 10: "fail"}), ("base headroom", {6: "fail", 10: "fail"}), ("gamma of zero", {7: "fail"}),
    ("group type", {17: "fail"}), ("hidden primary", {1: "fail"}), ("reference to another item", {3: "fail"}), ("tags that agree", {8: "pass", 9: "pass"}), ("tags that do not", {8: "pass", 9: "fail"}),
    ("a negative tag", {8: "fail", 9: "fail"}), ("payload cut", {4: "fail", 5: "fail", 6: "fail", 7: "fail", 10: "fail"}), ("another input", {4: "fail"}),
)


def broken(content: bytes, fault: int) -> bytes:
    """A file that the muxer wrote, with one of FAULTS."""
    name = FAULTS[fault][0]

    def swap(old: bytes, new: bytes) -> bytes:
        if old not in content:
            raise ValueError(f"{name}: not in the file")
        return content.replace(old, new, 1)

    if name == "gain of 10 bits":
        return swap(b"pixi\0\0\0\0\x01\x08", b"pixi\0\0\0\0\x01\x0a")
    if name == "auxiliary type":
        return swap(b"hdrgainmap", b"hdrgainmaq")
    if name == "brand":
        return swap(b"mif1tmap", b"mif1xxxx")
    if name == "group type":
        return swap(b"altr", b"alts")
    if name == "hidden primary":
        return swap(b"infe\x02\0\0\0\0\x01", b"infe\x02\0\0\x01\0\x01")
    if name == "reference to another item":
        return swap(b"auxl\0\x02\0\x01\0\x01", b"auxl\0\x02\0\x01\0\x03")
    if name == "another input":
        return swap(b"dimg\0\x03\0\x02\0\x01\0\x02", b"dimg\0\x03\0\x02\0\x01\0\x07")
    return content


def rewritten(payload: bytes, fault: int) -> bytes:
    """The metadata of a file, with one of FAULTS."""
    name = FAULTS[fault][0]
    if name == "alternate headroom":
        return payload[:14] + (63 * 1_000_000).to_bytes(4, "big") + (1_000_000).to_bytes(4, "big") + payload[22:]
    if name == "base headroom":
        return payload[:6] + (500_000).to_bytes(4, "big") + (1_000_000).to_bytes(4, "big") + payload[14:]
    if name == "gamma of zero":
        return payload[:38] + bytes(4) + payload[42:]
    return payload[:40] if name == "payload cut" else payload


def noted(payload: bytes, fault: int) -> bytes | None:
    """An Exif block whose maker's note states the payload's headroom, or another."""
    name = FAULTS[fault][0]
    if "tag" not in name:
        return None
    stops = int.from_bytes(payload[14:18], "big") / int.from_bytes(payload[18:22], "big")
    return b"II*\0" + bytes(8) + make_note(tags_for(2.0 ** (stops + (name == "tags that do not")), name == "a negative tag"))


@query(f"""WITH {PX}, {GAIN} SELECT image_id, CASE image_id % 3 WHEN 0 THEN round(round(greatest(hi, 0.0) * 65536) / 65536, 6) WHEN 1 THEN 1.5 ELSE round(round(hi * 65536) / 65536, 6) END AS stated, image_id % 3 = 1 AND abs(hi - 1.5) > 0.001 AS warned FROM rg""")
def headroom_override(spark, d):
    """Headrooms asked for in place of the derived ones, as the payload then states them."""
    asked = F.when(F.col("image_id") % 3 == 1, 1.5).when(F.col("image_id") % 3 == 2, F.col("max_log2"))
    packed = packed_images(P.embedding_tiles(spark, d), 2, asked)
    return packed.select("image_id", F.round(I.parse(F.hex(F.substring("payload", 2, 100)))["alt_headroom"], 6).alias("stated"), F.col("warning").isNotNull().alias("warned"))


@query(f"""WITH {PX}, {GAIN}, i AS (SELECT image_id, hi FROM rg), r AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 17]) AS criterion),
f AS (SELECT * FROM (VALUES {", ".join(f"({k}, {c}, '{s}')" for k, (_, of) in enumerate(FAULTS) for c, s in of.items())}) v(fault, criterion, status))
SELECT 'image' || image_id || '.heic' AS path, r.criterion, coalesce(CASE WHEN r.criterion = 10 AND f.fault = 5 AND NOT (hi > 1 AND abs(hi * 0.5 / (hi - 0.5) - 1) > 0.001) THEN 'pass' ELSE f.status END, CASE WHEN r.criterion IN (8, 9) THEN 'skip' ELSE 'pass' END) AS status FROM i CROSS JOIN r LEFT JOIN f ON f.fault = i.image_id % {len(FAULTS)} AND f.criterion = r.criterion""")
def container_checks(spark, d):
    """All rules, each of which fails for some files and passes for others: files that the
    muxer wrote, with faults by id, read by the independent parser. A base headroom of half a stop
    is no matter where the first display shows all of the map."""
    packed = packed_images(P.embedding_tiles(spark, d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                fault = row["image_id"] % len(FAULTS)
                metadata = {"exif": noted(row["payload"], fault)}
                out.append(broken(mux(_request(row["width"], row["height"], row["base"], row["gain"], rewritten(row["payload"], fault), "both", 100, 2, metadata)), fault))
            yield pa.RecordBatch.from_arrays([pa.array([f"image{i}.heic" for i in b["image_id"].to_pylist()]), pa.array(out, pa.binary())], ["path", "content"])

    files = packed.mapInArrow(run, "path string, content binary")
    return K.rule_statuses(container_facts(files)).select("path", "criterion", "status")


@query(f"SELECT 'image' || image_id || '.heic' AS path, 0::BIGINT AS failed, false AS has_iso FROM ({IMAGES})")
def container_checks_apple(spark, d):
    """Files of one flavor: the other's rules are skipped."""
    facts = container_facts(_files(spark, d, "apple"))
    v = K.verdicts(K.rule_statuses(facts, "apple"))
    return facts.select("path", F.col("tmap").isNotNull().alias("has_iso")).join(v, "path").select("path", "failed", "has_iso")


@query("""WITH e AS (SELECT vec_id // 3 AS image_id, vec_id % 3 AS ch, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT 'image' || image_id || '.heic' AS path, 192 AS n_base, 16 AS n_gain, true AS same FROM (SELECT DISTINCT image_id FROM e)""")
def mux_roundtrip(spark, d):
    """Planes coded, muxed, found again through the item tables and decoded are as before."""
    packed = packed_images(P.embedding_tiles(spark, d))

    def planes(data: bytes) -> list[tuple]:
        h = B.parse(data)
        return [(zlib.decompress(B.item_bytes(data, h, 1)), zlib.decompress(B.item_bytes(data, h, 2)))]

    read = parsed(convert(packed), planes, "base2 binary, gain2 binary")
    was = packed.select(F.concat(F.lit("image"), F.col("image_id").cast("string"), F.lit(".heic")).alias("path"), "base", "gain")
    return read.join(was, "path").select("path", F.length("base2").alias("n_base"), F.length("gain2").alias("n_gain"), ((F.col("base") == F.col("base2")) & (F.col("gain") == F.col("gain2"))).alias("same"))


@query(f"SELECT 'image' || image_id || '.heic' AS path, NULL::VARCHAR AS error, false AS ok FROM ({IMAGES}) WHERE false UNION ALL SELECT 'image' || image_id || '.heic', 'ValueError', false FROM ({IMAGES})")
def broken_files(spark, d):
    """Files cut short are rows with an error."""
    cut = _files(spark, d).select("path", F.substring("content", 1, 60).alias("content"))
    t = table(cut, "items")
    return t.select("path", F.substring_index("error", ":", 1).alias("error"), F.col("item_id").isNotNull().alias("ok"))


def _tiffs(spark: SparkSession, d: str, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = L.Lot(b)
            light = np.stack(t.rgb(), axis=1)
            files = [S.write_tiff(w, h, light[a : a + w * h].reshape(-1) / (1 if bits == 32 else 8), bits) for a, h, w in zip(t.first.tolist(), t.height.tolist(), t.width.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([f"{i}.tif" for i in b["image_id"].to_pylist()]), pa.array(files, pa.binary())], ["path", "content"])

    return P.embedding_tiles(spark, d).mapInArrow(run, "path string, content binary")


@query("WITH i AS (SELECT DISTINCT vec_id // 3 AS id FROM embeddings) SELECT id || '.tif' AS path, t.* FROM i, (VALUES (256, 4, 1::BIGINT), (257, 4, 1), (258, 3, 3), (259, 3, 1), (262, 3, 1), (273, 4, 1), (277, 3, 1), (278, 4, 1), (279, 4, 1), (284, 3, 1), (339, 3, 3)) t(tag, typ, count)")
def tiff_entries(spark, d):
    return table(_tiffs(spark, d, 32), "tiff_entries").select("path", "tag", "typ", "count")


@query("""WITH e AS (SELECT vec_id // 3 AS id, unnest(embedding) AS v FROM embeddings) SELECT id || '.tif' AS path, 64::BIGINT AS n, round(sum(abs(v::DOUBLE) * 8), 4) AS total FROM e GROUP BY id""")
def tiff_linear_pixels(spark, d):
    """Float pixels written and read back, summed."""
    px = table(_tiffs(spark, d, 32), "tiff_pixels")
    return px.groupBy("path").agg(F.count("*").alias("n"), F.round(F.sum(F.col("r") + F.col("g") + F.col("b")), 4).alias("total"))


_PQ = [f"round(10000 * pow(greatest(pow({c}, 1 / 78.84375::DOUBLE) - 0.8359375, 0.0) / (18.8515625 - 18.6875 * pow({c}, 1 / 78.84375::DOUBLE)), 1 / 0.1593017578125::DOUBLE) / 203, 6) AS {c}" for c in "rgb"]


@query(f"""WITH e AS (SELECT vec_id // 3 AS id, vec_id % 3 AS ch, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
c AS (SELECT id, i, ch, round_even(least(abs(v::DOUBLE), 1.0) * 65535, 0) / 65535 AS c FROM e),
p AS (SELECT id, i, {", ".join(f"coalesce(max(CASE WHEN ch = {k} THEN c END), 0.0) AS {n}" for k, n in enumerate("rgb"))} FROM c GROUP BY id, i)
SELECT id || '.tif' AS path, (i // 8)::INTEGER AS y, (i % 8)::INTEGER AS x, {", ".join(_PQ)} FROM p""")
def tiff_pq_pixels(spark, d):
    """16-bit pixels, read as PQ against a reference white of 203 nits."""
    px = table(_tiffs(spark, d, 16), "tiff_pixels")
    return px.select("path", "y", "x", *(F.round(pq_to_nits(F.col(c)) / 203, 6).alias(c) for c in "rgb"))


def _jpegs(spark: SparkSession, d: str) -> DataFrame:
    t = _tiffs(spark, d, 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["path"], pa.array([S.jpeg_with_exif(c) for c in b["content"].to_pylist()], pa.binary())], ["path", "content"])

    return t.mapInArrow(run, "path string, content binary")


@query("WITH i AS (SELECT DISTINCT vec_id // 3 AS id FROM embeddings) SELECT id || '.tif' AS path, 0 AS ord, 225 AS marker, 356::INTEGER AS size FROM i")
def jpeg_segments(spark, d):
    return table(_jpegs(spark, d), "jpeg_segments").select("path", "ord", "marker", F.length("body").alias("size"))


@query("""WITH e AS (SELECT vec_id // 3 AS id, unnest(embedding) AS v FROM embeddings), c AS (SELECT id, abs(v::DOUBLE) * 8 AS l FROM e),
d AS (SELECT id, CASE id % 3 WHEN 0 THEN l::FLOAT::DOUBLE WHEN 1 THEN round_even(least(l / 8, 1.0) * 65535, 0) / 65535 ELSE round_even(least(l / 8, 1.0) * 255, 0) / 255 END AS s FROM c),
n AS (SELECT id, CASE id % 3 WHEN 0 THEN s WHEN 1 THEN 10000 * pow(greatest(pow(s, 1 / 78.84375::DOUBLE) - 0.8359375, 0.0) / (18.8515625 - 18.6875 * pow(s, 1 / 78.84375::DOUBLE)), 1 / 0.1593017578125::DOUBLE) / 203 WHEN 2 THEN CASE WHEN s <= 0.04045 THEN s / 12.92 ELSE pow((s + 0.055) / 1.055, 2.4) END END AS lin FROM d)
SELECT id || '.tif' AS path, 1::BIGINT AS n_tiles, round(sum(lin), 4) AS total, round(max(lin), 5) AS peak FROM n GROUP BY id""")
def loaded_light(spark, d):
    """Files of three sample formats, each read as what it is: linear, PQ or sRGB."""
    kinds = [_tiffs(spark, d, bits).where(F.regexp_extract("path", r"(\d+)", 1).cast("long") % 3 == k) for k, bits in enumerate((32, 16, 8))]
    tiles = tiff_light(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]))
    light = L.each(tiles, lambda t: {"path": t.b["path"], "total": np.add.reduceat(sum(t.rgb()), t.first), "peak": t.most(np.max(t.rgb(), axis=0))}, "path string, total double, peak double")
    return light.groupBy("path").agg(F.count("*").alias("n_tiles"), F.round(F.sum("total"), 4).alias("total"), F.round(F.max("peak"), 5).alias("peak"))


@query(f"""SELECT 'image' || image_id || '.heic' AS path, CASE WHEN image_id % 4 = 3 THEN NULL ELSE 8::BIGINT END AS width, CASE WHEN image_id % 4 = 3 THEN NULL ELSE 3 END AS chroma, CASE WHEN image_id % 4 = 3 THEN NULL ELSE 8 END AS depth,
CASE WHEN image_id % 4 = 3 THEN 'ValueError: the primary item is grid, not one coded picture' END AS error FROM ({IMAGES})""")
def coded_images(spark, d):
    """The primary picture of each file as it was coded; grids are refused."""
    def grids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b["path"].to_pylist()
            out = [c.replace(b"hvc1", b"grid", 1) if int(p[5:-5]) % 4 == 3 else c for p, c in zip(paths, b["content"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["path"], pa.array(out, pa.binary())], ["path", "content"])

    files = _files(spark, d).select("path", "content").mapInArrow(grids, "path string, content binary")
    return table(files, "coded_images").select("path", "width", "chroma", "depth", "error")


@query(f"""WITH i AS ({IMAGES}) SELECT image_id, ['tiff', 'jpeg', 'heif'][image_id % 3 + 1] AS kind, 38 AS exif_bytes, CASE WHEN image_id % 3 = 0 THEN NULL ELSE 'xmp' || image_id END AS xmp,
CASE WHEN image_id % 3 = 1 AND image_id % 2 = 1 AND image_id % 5 <> 0 THEN 3 END::INTEGER AS iptc_bytes, CASE WHEN image_id % 3 = 1 AND image_id % 5 = 0 THEN 'iptc' ELSE '' END AS left_out FROM i""")
def metadata_by_magic(spark, d):
    """Blocks put into TIFF, JPEG and HEIF files by id, and found again by the first bytes."""
    base = MuxRequest(DeflateCodec().encode(8, 8, 3, bytes(192), 100), DeflateCodec().encode(4, 4, 1, bytes(16), 100), "apple")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in b["image_id"].to_pylist():
                exif, xmp, left = S.write_tags([(274, 3, b"\1\0"), (33432, 2, b"abc\0")], []), f"xmp{i}".encode(), []
                if i % 3 == 0:
                    file = exif
                elif i % 3 == 1:
                    file, left = M.wrapped(exif, bytes(70_000) if i % 5 == 0 else b"abc" if i % 2 else None, xmp)
                else:
                    file = mux(replace(base, exif=exif, xmp=xmp))
                found = {kind: data for kind, _, data in M.sidecar(file)}
                text = found.get("xmp")
                rows.append((i, M.kind_of(file), len(M.exif_block(file) or b""), None if text is None else text.decode(), len(found["iptc"]) if "iptc" in found else None, ",".join(left)))
            types = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, types)], ["image_id", "kind", "exif_bytes", "xmp", "iptc_bytes", "left_out"])

    return P.embedding_tiles(spark, d).select("image_id").mapInArrow(run, "image_id long, kind string, exif_bytes int, xmp string, iptc_bytes int, left_out string")


#: Tags that exif_rebuild gives to the file of an image, if its id divides by the number
#: beside: some to be carried over, some to stay behind.
_GIVEN = ((256, 1), (274, 2), (519, 2), (532, 3), (559, 1), (700, 5), (50706, 1), (50740, 3), (33432, 3))
_GONE = (519, 532, 559, 700, 50706, 50740)


@query(f"""WITH i AS (SELECT DISTINCT vec_id // 3 AS id FROM embeddings), t AS (SELECT * FROM (VALUES {", ".join(map(str, _GIVEN))}) v(tag, every)),
k AS (SELECT id, tag FROM i JOIN t ON id % every = 0 WHERE tag NOT IN {_GONE})
SELECT id || '.tif' AS path, count(*)::INTEGER + (id % 4 = 0)::INTEGER AS tags, string_agg(tag::VARCHAR, ',' ORDER BY tag) || CASE WHEN id % 4 = 0 THEN ',37386' ELSE '' END AS kept,
(8 + 2 + 12 * (count(*) + (id % 4 = 0)::INTEGER) + 4 + CASE WHEN id % 4 = 0 THEN 2 + 12 + 4 + 8 ELSE 0 END + 6 * sum((tag = 33432)::INTEGER))::BIGINT AS n_bytes FROM k GROUP BY id""")
def exif_rebuild(spark, d):
    """Blocks made anew from files whose tags differ by id: what is carried over."""
    ids = P.embedding_tiles(spark, d).select("image_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [S.write_tags([(t, 2 if t == 33432 else 3, b"(c) x\0" if t == 33432 else bytes([t % 7 + 1, 0])) for t, k in _GIVEN if i % k == 0], [(37386, 5, bytes([50, 0, 0, 0, 1, 0, 0, 0]))] if i % 4 == 0 else []) for i in b["image_id"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f"{i}.tif" for i in b["image_id"].to_pylist()]), pa.array(out, pa.binary())], ["path", "content"])

    def rebuilt(content: bytes) -> list[tuple]:
        out, n = S.rebuild_exif(content)
        tags = sorted((ifd != "ifd0", tag) for ifd, tag, *_ in S.tiff_entries(out) if tag != S.EXIF_IFD)
        return [(n, ",".join(str(t) for _, t in tags), len(out))]

    return parsed(ids.mapInArrow(run, "path string, content binary"), rebuilt, "tags int, kept string, n_bytes long").drop("error")


#: budget_search: what a file may take, the qualities tried, and the gain map's highest.
_BUDGET, _HIGH, _LOW, _GAIN = 850, 100, 20, 90


@query(f"""WITH i AS ({IMAGES}) SELECT image_id, true AS within_or_floor, true AS no_better FROM i""")
def budget_search(spark, d):
    """The best quality whose measured file fits a size, image by image, held against
    trying every quality: what was found fits, or is the lowest; the next one does not."""
    packed = packed_images(P.embedding_tiles(spark, d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                file = lambda q: mux(_request(r["width"], r["height"], r["base"], r["gain"], r["payload"], "both", q, 2, {}, gain_quality(q, _HIGH, _GAIN)))
                found = encode_within(file, _HIGH, _LOW, _BUDGET)
                fits = [q for q in range(_LOW, _HIGH + 1) if len(file(q)) <= _BUDGET]
                rows.append((r["image_id"], found.within == (len(found.data) <= _BUDGET) and (found.within or found.quality == _LOW), found.quality == max(fits, default=_LOW)))
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.bool_()))], ["image_id", "within_or_floor", "no_better"])

    return packed.mapInArrow(run, "image_id long, within_or_floor boolean, no_better boolean")


@query("""WITH e AS (SELECT vec_id // 3 AS id, vec_id % 3 AS ch, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
p AS (SELECT id, ch, i, floor(least(abs(v::DOUBLE) * 8, 1.0) * 65535) / 65535 AS c, floor(least(abs(v::DOUBLE) * 2, 1.0) * 65535) / 65535 AS t FROM e),
k AS (SELECT *, CASE WHEN id % 2 = 0 THEN 0 ELSE ch END AS own FROM p),
r AS (SELECT id, greatest(((CASE WHEN c <= 0.04045 THEN c / 12.92 ELSE pow((c + 0.055) / 1.055, 2.4) END) + 0.015625) * pow(2.0, -0.5 - own / 4.0 + pow(t, 1 / (1 + own / 2.0)) * (2.5 + own * 0.75)) - 0.015625, 0.0) AS lin FROM k)
SELECT id || '.tif' AS path, 64::BIGINT AS n, round(sum(lin), 4) AS total, round(max(lin), 5) AS peak FROM r GROUP BY id""")
def gain_map_tiff_reconstruct(spark, d):
    """Files of a 16-bit base and a 16-bit gain map, read and reconstructed per channel, by
    metadata of one channel or of three that differ, which come from the file, in SQL."""
    tiles = P.embedding_tiles(spark, d)
    of = lambda c: {"min_log2": F.lit(-0.5 - c / 4), "max_log2": F.lit(2.0 + c / 2), "gamma": F.lit(1.0 + c / 2), "base_offset": F.lit(1 / 64), "alt_offset": F.lit(1 / 64)}
    rooms = (F.lit(0.0), F.lit(2.0), F.lit(False))
    meta = F.unhex(F.when(F.col("image_id") % 2 == 0, I.serialize([of(0)], *rooms)).otherwise(I.serialize([of(0), of(1), of(2)], *rooms)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = L.Lot(b)
            light = np.stack(t.rgb(), axis=1)
            base, gain = (np.floor(np.minimum(light / k, 1.0) * 65535).astype(int) for k in (1, 4))
            files = [write_gain_map(w, h, base[a : a + w * h].reshape(-1).tolist(), gain[a : a + w * h].reshape(-1).tolist(), m) for a, h, w, m in zip(t.first.tolist(), t.height.tolist(), t.width.tolist(), b["meta"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([f"{i}.tif" for i in b["image_id"].to_pylist()]), pa.array(files, pa.binary())], ["path", "content"])

    files = tiles.select("*", meta.alias("meta")).mapInArrow(run, "path string, content binary")
    m = I.parse_channels(F.col("meta"))
    of_file = table(files, "gain_maps").select("path", *(I.channel_of(m[f], k).alias(f"{f}_{c}") for f in I.FIELDS for k, c in enumerate("rgb")))
    t = attach(table(files, "gain_map_pixels"), of_file, "path")
    lin = [F.greatest((srgb_to_linear(F.col(f"b{c}") / 65535.0) + F.col(f"base_offset_{c}")) * F.pow(F.lit(2.0), decode(F.col(f"g{c}") / 65535.0, F.col(f"min_log2_{c}"), F.col(f"max_log2_{c}"), F.col(f"gamma_{c}"))) - F.col(f"alt_offset_{c}"), F.lit(0.0)) for c in "rgb"]
    return t.groupBy("path").agg(F.count("*").alias("n"), F.round(F.sum(lin[0] + lin[1] + lin[2]), 4).alias("total"), F.round(F.max(F.greatest(*lin)), 5).alias("peak"))


@query("""SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 5 = 4 THEN 'absent' WHEN 1 + n_nationkey / 2.0 <= 8.0 THEN 'rewritten' ELSE 'removed' END AS outcome FROM nation""")
def align_headroom(spark, d):
    """Maker's notes made to state a headroom: beyond 8x the tags cannot, and go."""
    t = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["id"].to_pylist()
            notes = [make_note({33: (1, 2), 48: (1, 1000000)} if i % 5 != 4 else {33: (1, 1)}) for i in ids]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([align(n, 1 + i / 2)[1] for n, i in zip(notes, ids)])], ["id", "outcome"])

    return t.mapInArrow(run, "id long, outcome string")


@query("""SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 6 = 0 THEN 'not-offered' WHEN n_nationkey % 4 = 1 THEN 'source-has-own' WHEN n_nationkey % 3 = 2 THEN 'byte-order-differs' WHEN n_nationkey % 5 = 3 THEN 'no-exif-ifd' WHEN n_nationkey * 100000 > 1048576 + 500 THEN 'unreachable-offset' ELSE 'carried' END AS outcome FROM nation""")
def maker_note_graft(spark, d):
    """Blocks and companions made by id, and what becomes of the companion's note."""
    ids = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in b["id"].to_pylist():
                note = make_note({33: (1, 1)})
                own = exif_with_note(note, "<") if i % 4 == 1 else S.write_tags([(274, 3, b"\1\0")], [] if i % 5 == 3 else [(37386, 5, bytes(8))])
                companion = None if i % 6 == 0 else exif_with_note(note, ">" if i % 3 == 2 else "<", i * 100_000)
                out, outcome = graft(own, companion)
                if outcome == "carried" and (note_of(out) != note or note_place(out)[0] != i * 100_000) or outcome != "carried" and out != own:
                    outcome = "wrong"
                rows.append((i, outcome))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 2, (pa.int64(), pa.string()))], ["id", "outcome"])

    return ids.mapInArrow(run, "id long, outcome string")


@query("""SELECT to_json({'id': s_suppkey, 'name': s_name, 'ok': s_suppkey % 3 = 0})::VARCHAR AS report FROM supplier""")
def json_report(spark, d):
    t = spark.read.parquet(f"{d}/supplier.parquet")
    return t.select(F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 3 == 0).alias("ok"))).alias("report"))


@query("""SELECT conv_id, turn, regexp_extract(text, '^\\s*([a-z]+):', 1) AS said FROM conversations WHERE regexp_matches(text, '^\\s*[a-z]+:') OR turn = 0""")
def advisory_lines(spark, d):
    """Lines that start with a program's name; others only as first turns."""
    t = spark.read.parquet(f"{d}/conversations.parquet")
    anchored = F.rlike("text", F.lit(r"^\s*[a-z]+:"))
    return t.where(anchored | (F.col("turn") == 0)).select("conv_id", "turn", F.regexp_extract("text", r"^\s*([a-z]+):", 1).alias("said"))


@query(f"SELECT 'image' || image_id || '.heic' AS path, 8::BIGINT AS width, 8::BIGINT AS height, 4::BIGINT AS gain_width, true AS apple_aux, true AS iso_aux FROM ({IMAGES})")
def inspect(spark, d):
    """What a file holds, one row each, from its own structure."""
    s = structure(_files(spark, d))
    items = resolved_items(s)
    gain = F.max(F.when(F.col("hidden"), F.col("width"))).alias("gain_width")
    own = items.groupBy("path").agg(F.max(F.when(F.col("item_id") == 1, F.col("width"))).alias("width"), F.max(F.when(F.col("item_id") == 1, F.col("height"))).alias("height"), gain, F.max(F.col("item_type") == "tmap").alias("iso_aux"))
    return own.join(s.select("path", F.exists("props", lambda p: p["prop_type"] == "auxC").alias("apple_aux")), "path")
