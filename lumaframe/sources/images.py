"""TIFF directories, JPEG segments and ICC tags of one file's bytes, as rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from ..operators.tiles import BAND

#: Bytes of each TIFF type.
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
SUB_IFDS, EXIF_IFD, GPS_IFD = 330, 34665, 34853
MOST_TAGS = 1024


def tiff_entries(d: bytes) -> Iterator[tuple[str, int, int, int, bytes]]:
    """(ifd, tag, type, count, value bytes) of every directory that can be reached,
    each once. Entries of unknown type or that reach beyond the file are left out."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(d[:4])
    if order is None or len(d) < 8:
        raise ValueError("not a TIFF file")
    todo, seen, number = [("ifd0", struct.unpack_from(order + "I", d, 4)[0])], set(), 0
    while todo:
        name, at = todo.pop(0)
        if at in seen or at == 0 or at + 2 > len(d):
            continue
        seen.add(at)
        count = struct.unpack_from(order + "H", d, at)[0]
        for i in range(min(count, (len(d) - at - 2) // 12)):
            tag, typ, n = struct.unpack_from(order + "HHI", d, at + 2 + 12 * i)
            size = TYPE_SIZE.get(typ, 0) * n
            place = at + 10 + 12 * i
            if size > 4:
                place = struct.unpack_from(order + "I", d, place)[0]
            if not TYPE_SIZE.get(typ) or place + size > len(d):
                continue
            value = d[place : place + size]
            yield name, tag, typ, n, value
            if tag in (SUB_IFDS, EXIF_IFD, GPS_IFD) and typ == 4:
                kind = {SUB_IFDS: "sub", EXIF_IFD: "exif", GPS_IFD: "gps"}[tag]
                todo += [(f"{kind}{k}" if tag == SUB_IFDS else kind, x) for k, x in enumerate(struct.unpack(order + f"{n}I", value))]
        after = at + 2 + 12 * count
        if after + 4 <= len(d):
            number += 1
            todo.append((f"ifd{number}", struct.unpack_from(order + "I", d, after)[0]))


def byte_order(d: bytes) -> str:
    return "<" if d[:2] == b"II" else ">"


def integers(value: bytes, typ: int, order: str) -> list[int]:
    code = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}[typ]
    return list(struct.unpack(order + f"{len(value) // TYPE_SIZE[typ]}{code}", value))


#: Pixels of an image that are decoded at most.
MOST_PIXELS = 512 << 20


def samples(d: bytes, tags: dict[int, list[int]], order: str) -> np.ndarray:
    """The strips of a directory as [row, column, channel]: uncompressed, chunky, three
    samples of 8 or 16 bits or of 32-bit floats."""
    width, height = tags[256][0], tags[257][0]
    if tags.get(259, [1])[0] != 1 or tags.get(284, [1])[0] != 1 or tags.get(277, [1])[0] != 3:
        raise ValueError("compressed, planar, or not three samples")
    kind = {(8, 1): "u1", (16, 1): "u2", (32, 3): "f4"}.get((tags[258][0], tags.get(339, [1])[0]))
    if kind is None or width * height > MOST_PIXELS:
        raise ValueError("too large, or samples of another kind")
    data = b"".join(d[o : o + n] for o, n in zip(tags[273], tags[279]))
    if len(data) < width * height * 3 * int(kind[1]):
        raise ValueError("strips are cut short")
    return np.frombuffer(data, order + kind, width * height * 3).reshape(height, width, 3)


def tags_of(d: bytes, name: str) -> dict[int, list[int]]:
    """The whole numbers of a directory's tags."""
    order = byte_order(d)
    return {tag: integers(value, typ, order) for ifd, tag, typ, _, value in tiff_entries(d) if ifd == name and typ in (1, 3, 4)}


def tiff_image(d: bytes) -> np.ndarray:
    """[row, column, channel] of the first directory: codes as 0..1, floats as they are
    with negatives as 0."""
    found = samples(d, tags_of(d, "ifd0"), byte_order(d))
    return np.maximum(found.astype(np.float64), 0.0) if found.dtype.kind == "f" else found / float(np.iinfo(found.dtype).max)


def places(height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """y and x of each pixel, row by row."""
    return np.repeat(np.arange(height, dtype=np.int32), width), np.tile(np.arange(width, dtype=np.int32), height)


def tiff_pixels(d: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns (y, x, r, g, b) of ``tiff_image``."""
    image = tiff_image(d)
    yield (*places(*image.shape[:2]), *image.reshape(-1, 3).T)


def tiff_tiles(d: bytes) -> Iterator[tuple[int, int, int, bytes, bytes, bytes]]:
    """(y0, height, width, r, g, b) of the bands of ``tiff_image``."""
    image = tiff_image(d)
    for y0 in range(0, len(image), BAND):
        band = image[y0 : y0 + BAND]
        yield y0, len(band), band.shape[1], *(c.astype("<f8").tobytes() for c in band.reshape(-1, 3).T)


def write_tiff(width: int, height: int, values: list[float] | np.ndarray, bits: int = 32) -> bytes:
    """An uncompressed little-endian RGB file of 32-bit floats, or codes of 8 or 16 bits."""
    values = np.asarray(values, dtype=np.float64)
    data = values.astype("<f4").tobytes() if bits == 32 else np.rint(np.clip(values, 0, 1) * ((1 << bits) - 1)).astype(f"<u{bits // 8}").tobytes()
    tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [bits] * 3), (259, 3, [1]), (262, 3, [2]), (273, 4, [0]), (277, 3, [3]), (278, 4, [height]), (279, 4, [len(data)]), (284, 3, [1]), (339, 3, [3 if bits == 32 else 1] * 3)]
    after = 8 + 2 + 12 * len(tags) + 4
    extra, body = b"", b""
    sizes = [len(v) * TYPE_SIZE[t] for _, t, v in tags]
    start = after + sum(s for s in sizes if s > 4)
    for (tag, typ, v), size in zip(tags, sizes):
        v = [start] if tag == 273 else v
        packed = struct.pack(f"<{len(v)}{'H' if typ == 3 else 'I'}", *v)
        body += struct.pack("<HHI", tag, typ, len(v)) + (packed.ljust(4, b"\0") if size <= 4 else struct.pack("<I", after + len(extra)))
        extra += packed if size > 4 else b""
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + body + b"\0\0\0\0" + extra + data


def write_tags(first: list[tuple[int, int, bytes]], exif: list[tuple[int, int, bytes]] = ()) -> bytes:
    """A little-endian block with these tags (tag, type, value) in its first directory, and
    those of an Exif directory where there are any."""
    def directory(rows: list[tuple[int, int, bytes]], at: int) -> bytes:
        body, blobs, room = b"", b"", at + 2 + 12 * len(rows) + 4
        for tag, typ, value in sorted(rows):
            cell = value.ljust(4, b"\0") if len(value) <= 4 else struct.pack("<I", room + len(blobs))
            blobs += value if len(value) > 4 else b""
            body += struct.pack("<HHI", tag, typ, len(value) // TYPE_SIZE[typ]) + cell
        return struct.pack("<H", len(rows)) + body + b"\0\0\0\0" + blobs

    rows = list(first) + ([(EXIF_IFD, 4, b"\0\0\0\0")] if exif else [])
    at = 8 + len(directory(rows, 8))
    rows = [(t, k, struct.pack("<I", at) if t == EXIF_IFD else v) for t, k, v in rows]
    return b"II*\0" + struct.pack("<I", 8) + directory(rows, 8) + (directory(list(exif), at) if exif else b"")


def jpeg_segments(d: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(ordinal, marker, body) up to the scan; fill bytes are skipped, and a file cut
    short ends the list."""
    if d[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, n = 2, 0
    while at + 4 <= len(d) and d[at] == 0xFF:
        marker = d[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0xD9, 0xDA):
            return
        size = int.from_bytes(d[at + 2 : at + 4], "big")
        if size < 2 or at + 2 + size > len(d):
            return
        yield n, marker, d[at + 4 : at + 2 + size]
        at, n = at + 2 + size, n + 1


MOST_SEGMENT = 65533 - 6  # fixed value: bytes of Exif that a segment can carry


def jpeg_with_exif(tiff: bytes) -> bytes | None:
    """A JPEG header that carries Exif; None where it does not fit."""
    if not tiff or len(tiff) > MOST_SEGMENT:
        return None
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xd9"


def exif_of(d: bytes) -> bytes | None:
    return next((b[6:] for _, m, b in jpeg_segments(d) if m == 0xE1 and b[:6] == b"Exif\0\0"), None)


def iptc_of(d: bytes) -> bytes | None:
    """The IPTC resource (0x0404) of the first photoshop segment that has it."""
    for _, m, b in jpeg_segments(d):
        if m != 0xED or not b.startswith(b"Photoshop 3.0\0"):
            continue
        at = 14
        while at + 12 <= len(b) and b[at : at + 4] == b"8BIM":
            kind = int.from_bytes(b[at + 4 : at + 6], "big")
            at += 6 + (b[at + 6] + 2) // 2 * 2
            size = int.from_bytes(b[at : at + 4], "big")
            if kind == 0x0404:
                return b[at + 4 : at + 4 + size]
            at += 4 + (size + 1) // 2 * 2
    return None


def icc_tags(d: bytes) -> Iterator[tuple[str, bytes]]:
    """(signature, payload) of a profile's tags; an absurd count gives none."""
    if len(d) < 132:
        return
    count = int.from_bytes(d[128:132], "big")
    if count > MOST_TAGS:
        return
    for i in range(count):
        e = d[132 + 12 * i : 144 + 12 * i]
        if len(e) < 12:
            return
        off, size = int.from_bytes(e[4:8], "big"), int.from_bytes(e[8:12], "big")
        if off + size <= len(d):
            yield e[:4].decode("latin-1"), d[off : off + size]


def icc_description(d: bytes) -> str | None:
    tag = next((p for s, p in icc_tags(d) if s == "desc"), None)
    if tag is None:
        return None
    if tag[:4] == b"desc":
        return tag[12 : 12 + min(256, int.from_bytes(tag[8:12], "big"))].split(b"\0")[0].decode("latin-1")
    if tag[:4] == b"mluc":
        size, off = int.from_bytes(tag[20:24], "big"), int.from_bytes(tag[24:28], "big")
        return tag[off : off + min(512, size)].decode("utf-16-be", "replace")
    return None


#: Tags of the first directory that are not carried over. Offsets and
#: lengths of bytes that stay behind, and vendor blobs with offsets inside; how the source's
#: own pixels are laid out; what another part of the output states.
DROPPED = frozenset((
    273, 279, 288, 289, 324, 325, 330, 513, 514, 519, 520, 521, 559, 50740,
    254, 255, 258, 259, 262, 263, 264, 265, 266, 277, 278, 284, 290, 291, 292, 293, 301, 317, 320, 322, 323, 332, 333, 334, 336, 337, 338, 339, 340, 341, 342, 512, 515, 517, 518, 532, 50706, 50707,
    700, 34675,
))


def rebuild_exif(d: bytes) -> tuple[bytes | None, int]:
    """A TIFF block of what may be carried over, and how many tags: the first directory
    without ``DROPPED``, and the Exif and GPS directories whole. None without any."""
    order = byte_order(d)
    kept: dict[str, list[tuple[int, int, int, bytes]]] = {"ifd0": [], "exif": [], "gps": []}
    for ifd, tag, typ, n, value in tiff_entries(d):
        if ifd in kept and tag not in (EXIF_IFD, GPS_IFD) and not (ifd == "ifd0" and tag in DROPPED):
            kept[ifd].append((tag, typ, n, value))
    total = sum(map(len, kept.values()))
    if not total:
        return None, 0
    pointers = [(tag, name) for tag, name in ((EXIF_IFD, "exif"), (GPS_IFD, "gps")) if kept[name]]
    at = {"ifd0": 8}
    sizes = {name: 2 + 12 * (len(v) + (len(pointers) if name == "ifd0" else 0)) + 4 for name, v in kept.items()}
    at["exif"] = 8 + sizes["ifd0"]
    at["gps"] = at["exif"] + (sizes["exif"] if kept["exif"] else 0)
    blob_at = at["gps"] + (sizes["gps"] if kept["gps"] else 0)
    out, blobs = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8), b""
    for name, rows in kept.items():
        if not rows and name != "ifd0":
            continue
        rows = sorted(rows + ([(t, 4, 1, struct.pack(order + "I", at[n])) for t, n in pointers] if name == "ifd0" else []))
        out += struct.pack(order + "H", len(rows))
        for tag, typ, n, value in rows:
            if len(value) <= 4:
                cell = value.ljust(4, b"\0")
            else:
                cell = struct.pack(order + "I", blob_at + len(blobs))
                blobs += value + b"\0" * (len(value) % 2)
            out += struct.pack(order + "HHI", tag, typ, n) + cell
        out += b"\0\0\0\0"
    return out + blobs, total
