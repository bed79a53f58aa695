"""Parsers and muxer: round trips, truncation at every length, corruption, hostile counts."""

import random

import pytest

from lumaframe.operators.codec import DeflateCodec, encode_within
from lumaframe.operators.mux import MuxRequest, mux
from lumaframe.plans import checker
from lumaframe.plans import checks as K
from lumaframe.sources import boxes as B
from lumaframe.sources import images as S
from lumaframe.sources.files import binary_files, parsed, register, table

PAYLOAD = bytes.fromhex("000000000040" + "00000000000F4240" + "0022E605000F4240" + "FFFFF855000F4240" + "0022E605000F4240" + "000C9954000F4240" + "0000000A000F4240" + "0000000A000F4240")


def sample(flavor="both", **more):
    c = DeflateCodec()
    base, gain = bytes(range(192)), bytes(range(16))
    return mux(MuxRequest(c.encode(8, 8, 3, base, 100), c.encode(4, 4, 1, gain, 100), flavor, PAYLOAD, **more))


def statuses(spark, data, expect=None):
    schema = K.FACTS.split(",", 1)[1]
    files = spark.createDataFrame([("f", bytearray(data))], "path string, content binary")
    facts = parsed(files, lambda d: [checker.facts("", d)[1:]], schema)
    return {r["criterion"]: r["status"] for r in K.rule_statuses(facts, expect).collect()}


def test_both_parsers_agree():
    for flavor in ("apple", "iso", "both"):
        d = sample(flavor, exif=b"II*\0", xmp=b"<x/>", opaque=(("uri ", "blob", b"1234"),), turns=1, mirror=0)
        h = B.parse(d)
        f = checker.facts("f", d)
        assert h.primary == f[1] == 1
        assert [i[1] for i in h.items if i[0] == 1] == [f[2]]
        assert {x[2] for x in h.refs if x[0] == "cdsc"} == {1}
        assert (any(i[1] == "tmap" for i in h.items)) == (f[8] is not None) == (flavor != "apple")
        assert B.item_bytes(d, h, max(i[0] for i in h.items)) == b"1234"


def test_good_file_passes(spark):
    s = statuses(spark, sample())
    assert s[8] == s[9] == "skip" and all(v == "pass" for k, v in s.items() if k not in (8, 9))
    s = statuses(spark, sample("apple"), "both")
    assert s[4] == "fail" and s[3] == "pass"
    s = statuses(spark, sample("apple"), "apple")
    assert s[4] == "skip" and s[5] == "skip"


def patched(data, old, new, count=1):
    assert data.count(old) >= 1 and len(old) == len(new)
    return data.replace(old, new, count)


@pytest.mark.parametrize(
    "rule, change",
    [
        (2, lambda d: patched(d, b"pixi\0\0\0\0\x01\x08", b"pixi\0\0\0\0\x01\x0a")),
        (3, lambda d: patched(d, b"hdrgainmap", b"hdrgainmaq")),
        (4, lambda d: patched(d, b"mif1tmap", b"mif1xxxx")),
        (5, lambda d: patched(d, bytes.fromhex("0022E605000F4240FFFFF855"), bytes.fromhex("0012E605000F4240FFFFF855"))),
        (6, lambda d: patched(d, bytes.fromhex("4000000000000F4240"), bytes.fromhex("4000010000000F4240"))),
        (7, lambda d: patched(d, bytes.fromhex("000C9954"), bytes.fromhex("00000000"))),
        (17, lambda d: patched(d, b"altr", b"alts")),
    ],
)
def test_one_broken_field_fails_its_rule(spark, rule, change):
    assert statuses(spark, sample(), "both")[rule] == "pass"
    assert statuses(spark, change(sample()), "both")[rule] == "fail"


def test_truncation_and_corruption_never_hang():
    d = sample()
    for n in range(len(d)):
        for parse in (B.parse, lambda x: checker.facts("", x)):
            try:
                parse(d[:n])
            except (ValueError, IndexError):
                pass
    random.seed(3)
    for _ in range(400):
        x = bytearray(d)
        x[random.randrange(len(x))] = random.randrange(256)
        try:
            h = B.parse(bytes(x))
            for i in h.items:
                try:
                    B.item_bytes(bytes(x), h, i[0])
                except ValueError:
                    pass
        except (ValueError, IndexError):
            pass
        list(B.tree(bytes(x)))


def test_hostile_counts():
    d = sample()
    at = d.index(b"iloc") + 10
    x = d[:at] + b"\xff\xff" + d[at + 2 :]
    try:
        assert len(B.parse(x).locs) < 100_000
    except (ValueError, IndexError):
        pass
    assert list(S.icc_tags(bytes(128) + b"\xff\xff\xff\xff")) == []


def test_wide_and_open_sizes():
    wide = b"\0\0\0\x01free" + (24).to_bytes(8, "big") + bytes(8)
    last = b"\0\0\0\0mdatrest"
    assert [(t, e - o) for t, o, _, e in B.walk(wide + last)] == [("free", 24), ("mdat", 12)]
    assert list(B.walk(b"\0\0\0\x04oops")) == []


def test_errors_are_rows(spark):
    files = spark.createDataFrame([("good", bytearray(sample())), ("bad", bytearray(b"x")), ("none", None)], "path string, content binary")
    rows = table(files, "items").collect()
    assert {r["path"] for r in rows if r["error"]} == {"bad", "none"}
    assert sum(r["path"] == "good" for r in rows) == 3


def test_sql_functions(spark):
    register(spark)
    spark.createDataFrame([("f", bytearray(sample()))], "path string, content binary").createOrReplaceTempView("files")
    assert spark.sql("SELECT count(*) FROM files, LATERAL boxes(content) b WHERE b.type = 'ispe'").first()[0] == 2


def test_sql_functions_say_what_is_wrong(spark):
    register(spark)
    spark.createDataFrame([("f", bytearray(b"no such file")), ("t", bytearray(S.write_tiff(2, 1, [0.5] * 6)))], "path string, content binary").createOrReplaceTempView("some")
    rows = spark.sql("SELECT path, p.r, p.error FROM some, LATERAL tiff_pixels(content) p").collect()
    assert [(r["r"], r["error"][:10]) for r in rows if r["path"] == "f"] == [(None, "ValueError")]
    assert [(r["r"], r["error"]) for r in rows if r["path"] == "t"] == [(0.5, None)] * 2


def test_inputs(spark, tmp_path):
    """Folders by suffix, in any case; files named outright whatever their name."""
    for name in ("a.tif", "b.TIF", "c.Orf", "d.rw2", "e.txt", "f"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "g.tif").write_bytes(b"x")
    names = lambda paths: sorted(r["path"].rsplit("/", 1)[1] for r in binary_files(spark, paths).collect())
    assert names([str(tmp_path)]) == ["a.tif", "b.TIF", "c.Orf", "d.rw2"]
    assert names([str(tmp_path / "e.txt"), str(tmp_path / "f")]) == ["e.txt", "f"]
    assert names([str(tmp_path), str(tmp_path / "f"), str(tmp_path / "a.tif")]) == ["a.tif", "b.TIF", "c.Orf", "d.rw2", "f"]


def test_budget():
    sizes = []

    def encode(q):
        sizes.append(q)
        return bytes(q * 10)

    assert encode_within(encode, 90, 40, 900).quality == 90
    got = encode_within(encode, 90, 40, 655)
    assert (got.quality, got.within) == (65, True)
    low = encode_within(encode, 90, 40, 100)
    assert (low.quality, low.within, low.attempts) == (40, False, 2)


def test_tiff_and_jpeg():
    values = [0.5, 2.0, -1.0] * 4
    t = S.write_tiff(2, 2, values)
    (y, x, *rgb), = S.tiff_pixels(t)
    assert y.tolist() == [0, 0, 1, 1] and x.tolist() == [0, 1, 0, 1] and [c.tolist() for c in rgb] == [[0.5] * 4, [2.0] * 4, [0.0] * 4]
    assert [(a, h, w) for a, h, w, *_ in S.tiff_tiles(S.write_tiff(3, 100, [0.25] * 900, 8))] == [(0, 48, 3), (48, 48, 3), (96, 4, 3)]
    assert S.exif_of(S.jpeg_with_exif(t)) == t
    assert S.jpeg_with_exif(bytes(70_000)) is None and S.jpeg_with_exif(b"") is None
    for n in range(len(t)):
        try:
            list(S.tiff_entries(t[:n]))
        except Exception as e:
            assert type(e).__name__ in ("ValueError", "error")


def test_exif_keeps_what_describes_the_picture():
    import struct

    def ifd(entries, after):
        return struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHI4s", *e) for e in entries) + struct.pack("<I", after)

    exif = ifd([(37386, 3, 1, b"\x32\0\0\0")], 0)
    first = ifd([(256, 3, 1, b"\x08\0\0\0"), (274, 3, 1, b"\x06\0\0\0"), (34665, 4, 1, struct.pack("<I", 8 + 42))], 0)
    out, n = S.rebuild_exif(b"II*\0" + struct.pack("<I", 8) + first + exif)
    kept = {(i, tag): v for i, tag, _, _, v in S.tiff_entries(out)}
    assert n == 3 and kept["ifd0", 274] == b"\x06\0" and kept["exif", 37386] == b"\x32\0" and kept["ifd0", 256] == b"\x08\0"
    stays = S.write_tags([(t, 3, b"\1\0") for t in (519, 559, 532, 263, 50740, 50706, 273)])
    assert S.rebuild_exif(stays) == (None, 0)


def test_stream(spark, tmp_path):
    from lumaframe.streaming.files import stream_table

    (tmp_path / "in").mkdir()
    for name in ("0.heic", "1.HEIC", "2.Heic"):
        (tmp_path / "in" / name).write_bytes(sample())
    q = stream_table(spark, str(tmp_path / "in"), "items", str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9
