"""Headroom tags within a camera maker's note, and notes of companion files."""

from __future__ import annotations

import math
import struct

from ..functions.headroom import BRANCHES, MEETING, MOST_EXPRESSIBLE, MOST_STOPS
from .images import EXIF_IFD, byte_order, tiff_entries

#: What the note starts with, where its directory is, its two tags, the
#: Exif tag that holds a note, and how closely copies of a headroom must agree.
SIGNATURE, DIRECTORY, TAG33, TAG48, NOTE_TAG, AGREE = b"Apple iOS\0", 14, 33, 48, 37500, 1e-3
DENOMINATOR = 1_000_000
#: Bytes of a companion file that are read before the whole of it is.
HEAD = 1 << 20


def note_of(tiff: bytes) -> bytes | None:
    return next((v for ifd, tag, _, _, v in tiff_entries(tiff) if ifd == "exif" and tag == NOTE_TAG), None)


def note_state(data: bytes, whole: bool) -> str:
    """found, absent, or beyond (what was read ends too soon to tell)."""
    try:
        if note_of(data) is not None:
            return "found"
    except (ValueError, struct.error):
        return "absent" if whole else "beyond"
    order = byte_order(data)
    first = struct.unpack_from(order + "I", data, 4)[0]
    cut = first + 2 > len(data) or first + 2 + 12 * struct.unpack_from(order + "H", data, first)[0] > len(data)
    return "beyond" if cut and not whole else "absent"


#: Bytes of padding that keeping a note in its place may cost.
MOST_PADDING = 1 << 20


def _directory(d: bytes, order: str, at: int) -> list[tuple[int, int, int, bytes]]:
    """(tag, type, count, cell) of the directory at a place."""
    count = struct.unpack_from(order + "H", d, at)[0]
    return [struct.unpack_from(order + "HHI4s", d, at + 2 + 12 * i) for i in range(min(count, (len(d) - at - 2) // 12))]


def _exif_place(d: bytes, order: str) -> int | None:
    first = struct.unpack_from(order + "I", d, 4)[0]
    return next((struct.unpack(order + "I", cell)[0] for tag, _, _, cell in _directory(d, order, first) if tag == EXIF_IFD), None)


def note_place(d: bytes) -> tuple[int, int] | None:
    """Where a block's maker's note is, and its length."""
    order = byte_order(d)
    at = _exif_place(d, order)
    return None if at is None else next(((struct.unpack(order + "I", cell)[0], n) for tag, _, n, cell in _directory(d, order, at) if tag == NOTE_TAG and n > 4), None)


def graft(block: bytes, companion: bytes | None) -> tuple[bytes, str]:
    """The block with its companion's maker's note, and what became of it: not-offered,
    source-has-own, byte-order-differs, no-exif-ifd, unreachable-offset or carried.

    Offsets within a note may count from the block's start, so a note keeps its place: the
    block is padded up to it, and the Exif directory, with one entry more, follows.
    """
    place = None if companion is None else note_place(companion)
    if place is None or place[0] + place[1] > len(companion):
        return block, "not-offered"
    if note_place(block) is not None:
        return block, "source-has-own"
    order = byte_order(block)
    if order != byte_order(companion):
        return block, "byte-order-differs"
    at = _exif_place(block, order)
    if at is None:
        return block, "no-exif-ifd"
    start, size = place
    if not len(block) <= start <= len(block) + MOST_PADDING:
        return block, "unreachable-offset"
    rows = sorted([*_directory(block, order, at), (NOTE_TAG, 7, size, struct.pack(order + "I", start))])
    out = block.ljust(start, b"\0") + companion[start : start + size]
    out += b"\0" * (len(out) % 2)
    first = struct.unpack_from(order + "I", block, 4)[0]
    pointer = next(i for i, r in enumerate(_directory(block, order, first)) if r[0] == EXIF_IFD)
    where = first + 2 + 12 * pointer + 8
    out = out[:where] + struct.pack(order + "I", len(out)) + out[where + 4 :]
    return out + struct.pack(order + "H", len(rows)) + b"".join(struct.pack(order + "HHI4s", *r) for r in rows) + b"\0\0\0\0", "carried"


def _rationals(note: bytes) -> tuple[str, int, dict[int, tuple[int, int]]] | None:
    """Byte order, entry count, and for each single rational its (entry, value) places."""
    if not note.startswith(SIGNATURE) or len(note) < DIRECTORY + 2:
        return None
    order = "<" if note[12:14] == b"II" else ">"
    count = struct.unpack_from(order + "H", note, DIRECTORY)[0]
    if DIRECTORY + 2 + 12 * count + 4 > len(note):
        return None
    found = {}
    for i in range(count):
        at = DIRECTORY + 2 + 12 * i
        tag, typ, n, place = struct.unpack_from(order + "HHII", note, at)
        if typ in (5, 10) and n == 1 and place + 8 <= len(note):
            found.setdefault(tag, (at, place))
    return order, count, found


def headroom_tags(note: bytes) -> tuple[float | None, float | None]:
    parsed = _rationals(note)
    if parsed is None:
        return None, None
    order, _, places = parsed

    def value(tag: int) -> float | None:
        if tag not in places:
            return None
        a, b = struct.unpack_from(order + "ii", note, places[tag][1])
        return a / b if b else None

    return value(TAG33), value(TAG48)


def decoded(tag33: float, tag48: float) -> float:
    slope, at_zero = BRANCHES[tag33 >= 1, tag48 <= 0.01]
    return 2.0 ** min(MOST_STOPS, max(0.0, slope * tag48 + at_zero))


def encoded(headroom: float) -> float:
    stops = math.log2(min(16.0, max(1.0, headroom)))
    if stops >= MOST_EXPRESSIBLE:
        return 0.0
    slope, at_zero = BRANCHES[True, stops >= MEETING]
    return max(0.0, (stops - at_zero) / slope)


def align(note: bytes, headroom: float) -> tuple[bytes, str]:
    """The note with its tags stating ``headroom``, and what was done: rewritten;
    removed, where the numbers as written would not agree with it; or absent, where
    there is no pair of tags. The length never changes."""
    parsed = _rationals(note)
    if parsed is None or not {TAG33, TAG48} <= parsed[2].keys():
        return note, "absent"
    order, count, places = parsed
    out = bytearray(note)
    n33, d33 = struct.unpack_from(order + "ii", note, places[TAG33][1])
    d48 = struct.unpack_from(order + "ii", note, places[TAG48][1])[1]
    want = encoded(headroom)
    d48 = d48 if d48 > 0 and want * d48 <= 2**31 - 1 else DENOMINATOR
    n48 = round(want * d48)
    tag33 = n33 / d33 if d33 else 1.0
    raised = tag33 < 1
    if abs(decoded(1.0 if raised else tag33, n48 / d48) - headroom) < AGREE:
        struct.pack_into(order + "ii", out, places[TAG48][1], n48, d48)
        if raised:
            d = d33 if d33 > 0 else DENOMINATOR
            struct.pack_into(order + "ii", out, places[TAG33][1], d, d)
        return bytes(out), "rewritten"
    gone = {places[TAG33][0], places[TAG48][0]}
    start = DIRECTORY + 2
    entries = b"".join(note[start + 12 * i : start + 12 * (i + 1)] for i in range(count) if start + 12 * i not in gone)
    tail = note[start + 12 * count : start + 12 * count + 4]
    struct.pack_into(order + "H", out, DIRECTORY, len(entries) // 12)
    out[start : start + len(entries) + 4] = entries + tail
    return bytes(out), "removed"


def tags_for(headroom: float, negative: bool = False) -> dict[int, tuple[int, int]]:
    """The two tags that state ``headroom``, or a tag 48 that none has."""
    return {TAG33: (1, 1), TAG48: (-DENOMINATOR // 2 if negative else round(encoded(headroom) * DENOMINATOR), DENOMINATOR)}


def make_note(rationals: dict[int, tuple[int, int]]) -> bytes:
    """A note with these tags, big-endian."""
    at = DIRECTORY + 2 + 12 * len(rationals) + 4
    body = b"".join(struct.pack(">HHII", t, 10, 1, at + 8 * i) for i, t in enumerate(sorted(rationals)))
    values = b"".join(struct.pack(">ii", *rationals[t]) for t in sorted(rationals))
    return SIGNATURE + b"\0\1MM" + struct.pack(">H", len(rationals)) + body + b"\0\0\0\0" + values


def exif_with_note(note: bytes, order: str = ">", place: int = 44) -> bytes:
    """A TIFF block whose Exif directory holds the note, which is at ``place``."""
    def one(tag: int, typ: int, n: int, value: int) -> bytes:
        return struct.pack(order + "H", 1) + struct.pack(order + "HHII", tag, typ, n, value) + b"\0\0\0\0"

    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    return (head + one(EXIF_IFD, 4, 1, 26) + one(NOTE_TAG, 7, len(note), place)).ljust(place, b"\0") + note
