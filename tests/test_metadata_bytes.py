"""Notes, gain-map TIFFs and HEVC units as bytes."""

import random

import pytest

from lumaframe.operators.codec import DeflateCodec
from lumaframe.operators.mux import MuxRequest, mux
from lumaframe.plans import checker
from lumaframe.sources import camera as N
from lumaframe.sources import gainmap_tiff as G
from lumaframe.sources import hevc as V
from lumaframe.sources import images as S

META = bytes.fromhex("0000000000" + "0000000000010000" + "0002000000010000" + "FFFF800000010000" + "0002000000010000" + "0001000000010000" + "0000040000010000" * 2)


@pytest.mark.parametrize("headroom, what", [(1.0, "rewritten"), (2.0, "rewritten"), (4.88, "rewritten"), (8.0, "rewritten"), (11.86, "removed")])
def test_align(headroom, what):
    note = N.make_note({1: (7, 2), 33: (1, 2), 48: (-8, 1000)})
    out, done = N.align(note, headroom)
    assert done == what and len(out) == len(note)
    if what == "rewritten":
        assert N.decoded(*N.headroom_tags(out)) == pytest.approx(headroom, abs=1e-3)
    else:
        assert N.headroom_tags(out) == (None, None) and N._rationals(out)[1] == 1


def test_align_without_a_pair():
    for note in (b"", b"Nikon", N.make_note({33: (1, 1)}), N.make_note({33: (1, 1), 48: (1, 9)})[:30]):
        assert N.align(note, 2.0) == (note, "absent")


def test_notes_reach_the_rules():
    c = DeflateCodec()
    exif = N.exif_with_note(N.make_note({33: (1, 1), 48: (-8, 1000)}))
    assert N.note_of(exif) and N.note_state(exif, True) == "found"
    assert N.note_state(exif[:20], False) == "beyond" and N.note_state(b"II*\0\x08\0\0\0\0\0\0\0\0\0", True) == "absent"
    data = mux(MuxRequest(c.encode(8, 8, 3, bytes(192), 100), c.encode(4, 4, 1, bytes(16), 100), "apple", exif=exif))
    f = checker.facts("f", data)
    assert f[20:22] == (1.0, -0.008)


def test_a_companions_note_keeps_its_place():
    note = N.make_note({33: (1, 1), 48: (9, 1000)})
    own = S.write_tags([(274, 3, b"\6\0")], [(37386, 5, bytes(8))])
    out, outcome = N.graft(own, N.exif_with_note(note, "<", 500))
    kept = {(i, t): v for i, t, _, _, v in S.tiff_entries(out)}
    assert outcome == "carried" and kept["exif", N.NOTE_TAG] == note and out[500 : 500 + len(note)] == note
    assert kept["ifd0", 274] == b"\6\0" and kept["exif", 37386] == bytes(8)
    assert N.graft(own, None)[1] == N.graft(own, own)[1] == "not-offered" and N.graft(out, N.exif_with_note(note, "<", 500))[1] == "source-has-own"
    assert N.graft(own, N.exif_with_note(note, "<", 50))[1] == N.graft(own, N.exif_with_note(note, "<", 3 << 20))[1] == "unreachable-offset"
    assert N.graft(own, N.exif_with_note(note, ">", 500))[1] == "byte-order-differs"


def test_gain_map_tiff():
    base, gain = list(range(0, 48 * 1000, 1000)), list(range(48))
    d = G.write_gain_map(4, 4, base, gain, META)
    (columns,) = G.gain_map(d)
    assert all(len(c) == 16 for c in columns) and [int(c[5]) for c in columns] == [1, 1, *base[15:18], *gain[15:18]]
    assert list(G.gain_map_meta(d)) == [(4, 4, META.hex().upper())]
    assert list(G.gain_map(S.write_tiff(2, 2, [0.0] * 12))) == []
    hdr = META[:5] + b"\0\1" + META[7:]
    with pytest.raises(ValueError, match="HDR side"):
        list(G.gain_map(G.write_gain_map(4, 4, base, gain, hdr)))
    for n in range(0, len(d), 3):
        try:
            list(G.gain_map(d[:n]))
        except Exception as e:
            assert type(e).__name__ in ("ValueError", "error")


def test_user_data_goes():
    def unit(body):
        return len(body).to_bytes(4, "big") + body

    sei = unit(bytes([39 << 1, 1, 5, 4]) + b"abcd\x80")
    long_sei = unit(bytes([39 << 1, 1, 5, 255, 10]) + bytes([1]) * 265 + b"\x80")
    other = unit(bytes([39 << 1, 1, 137, 1]) + b"x\x80")
    picture = unit(bytes([19 << 1, 1]) + bytes(20))
    assert V.strip_user_data(sei + picture + long_sei + other) == picture + other
    assert V.strip_user_data(picture + b"\0\0\1") == picture + b"\0\0\1"
    assert V.unescape(b"\0\0\3\1") == b"\0\0\1"
    random.seed(1)
    for _ in range(300):
        V.strip_user_data(bytes(random.choices(range(256), k=40)))


def test_profiles():
    def profile(tags):
        at, head, body = 132 + 12 * len(tags), b"", b""
        for s, p in tags.items():
            head += s + (at + len(body)).to_bytes(4, "big") + len(p).to_bytes(4, "big")
            body += p
        return bytes(128) + len(tags).to_bytes(4, "big") + head + body

    p = profile({b"desc": b"desc\0\0\0\0" + (5).to_bytes(4, "big") + b"sRGB\0", b"cicp": b"cicp" + bytes(4) + b"\x0c"})
    assert S.icc_description(p) == "sRGB" and dict(S.icc_tags(p))["cicp"][8] == 12
    m = profile({b"desc": b"mluc" + bytes(12) + b"enUS" + (4).to_bytes(4, "big") + (28).to_bytes(4, "big") + "P3".encode("utf-16-be")})
    assert S.icc_description(m) == "P3" and S.icc_description(b"") is None
