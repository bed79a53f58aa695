"""Metadata blocks by what a file starts with, and the JPEG segments that carry them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from . import boxes
from .images import exif_of, iptc_of, jpeg_segments, tiff_entries

#: What stands before each block in its segment, and the most that a
#: segment holds beside its length.
EXIF, XMP, IPTC = b"Exif\0\0", b"http://ns.adobe.com/xap/1.0/\0", b"Photoshop 3.0\0"
MOST_BODY = 65_533
XMP_TAG, XMP_TYPE = 700, "application/rdf+xml"


def kind_of(d: bytes) -> str | None:
    """tiff, jpeg or heif, by the first bytes."""
    if d[:4] in (b"II*\0", b"MM\0*"):
        return "tiff"
    return "jpeg" if d[:2] == b"\xff\xd8" else "heif" if d[4:8] == b"ftyp" else None


def segment(marker: int, body: bytes) -> bytes | None:
    """A JPEG segment; None where there is nothing or too much for one."""
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body if len(body) <= MOST_BODY else None


def wrapped(exif: bytes | None = None, iptc: bytes | None = None, xmp: bytes | None = None) -> tuple[bytes | None, list[str]]:
    """A JPEG header that carries the blocks, and the names of those that do not fit."""
    resource = b"" if not iptc else IPTC + b"8BIM" + struct.pack(">H2xI", 0x0404, len(iptc)) + iptc + b"\0" * (len(iptc) % 2)
    parts, left = [], []
    for name, marker, body in (("exif", 0xE1, EXIF + exif if exif else b""), ("iptc", 0xED, resource), ("xmp", 0xE1, XMP + xmp if xmp else b"")):
        if body:
            made = segment(marker, body)
            parts.append(made) if made else left.append(name)
    return (b"\xff\xd8" + b"".join(parts) + b"\xff\xd9" if parts else None), left


def exif_block(d: bytes) -> bytes | None:
    """The Exif block of a TIFF (itself), a JPEG (its segment) or a HEIF file (its item,
    after the offset that it starts with)."""
    kind = kind_of(d)
    if kind == "tiff":
        return d
    if kind == "jpeg":
        return exif_of(d)
    if kind != "heif":
        return None
    h = boxes.parse(d)
    item = next((i[0] for i in h.items if i[1] == "Exif"), None)
    if item is None:
        return None
    data = boxes.item_bytes(d, h, item)
    start = 4 + int.from_bytes(data[:4], "big")
    return data[start:] if len(data) > start else None


def xmp_of(d: bytes) -> bytes | None:
    """The XMP of a file: tag 700 without trailing NULs, the APP1 segment, or the item."""
    kind = kind_of(d)
    if kind == "tiff":
        return next((v.rstrip(b"\0") for ifd, tag, _, _, v in tiff_entries(d) if ifd == "ifd0" and tag == XMP_TAG), None)
    if kind == "jpeg":
        return next((b[len(XMP) :] for _, m, b in jpeg_segments(d) if m == 0xE1 and b.startswith(XMP)), None)
    if kind != "heif":
        return None
    h = boxes.parse(d)
    item = next((i[0] for i in h.items if i[1] == "mime" and i[3] == XMP_TYPE), None)
    return None if item is None else boxes.item_bytes(d, h, item)


def sidecar(d: bytes) -> Iterator[tuple[str, str, bytes]]:
    """(kind, label, data) of what is carried beside the picture: xmp, iptc, and of a HEIF
    file the other items that describe the primary one."""
    if (xmp := xmp_of(d)) is not None:
        yield "xmp", "xmp", xmp
    if kind_of(d) == "jpeg" and (iptc := iptc_of(d)) is not None:
        yield "iptc", "iptc", iptc
    if kind_of(d) == "heif":
        h = boxes.parse(d)
        about = {f for kind, f, to, _ in h.refs if kind == "cdsc" and to == h.primary}
        for item, kind, name, content, _ in h.items:
            if item in about and kind not in ("hvc1", "tmap", "Exif") and content != XMP_TYPE:
                yield "item", ":".join(x for x in (kind, name, content) if x), boxes.item_bytes(d, h, item)


def coded_image(d: bytes) -> tuple[int, int, int, int, bytes, bytes]:
    """(width, height, chroma, depth, configuration, data) of the primary picture. Chroma
    and depth are the decoder configuration's, not what ``pixi`` says. A picture made
    of tiles has no data of its own and is refused."""
    h = boxes.parse(d)
    kind = next((i[1] for i in h.items if i[0] == h.primary), None)
    if kind != "hvc1":
        raise ValueError(f"the primary item is {kind}, not one coded picture")
    own = {p for i, p, _, _ in h.assoc if i == h.primary}
    size = [(p[2], p[3]) for p in h.props if p[0] in own and p[1] == "ispe"]
    config = next((d[b:e] for k, b, e in _properties(d) if k in own and d[b - 4 : b] == b"hvcC"), None)
    if not size or config is None or len(config) < 19:
        raise ValueError("no size or no decoder configuration")
    return *size[-1], config[16] & 3, (config[17] & 7) + 8, config, boxes.item_bytes(d, h, h.primary)


def _properties(d: bytes) -> Iterator[tuple[int, int, int]]:
    """(place from 1, body, end) of each property box."""
    def inside(start: int, end: int, names: tuple[str, ...]) -> Iterator[tuple[int, int, int]]:
        for n, (typ, _, b, e) in enumerate(boxes.walk(d, start, end), 1):
            if not names:
                yield n, b, e
            elif typ == names[0]:
                yield from inside(b + boxes.HOLDERS[typ], e, names[1:])

    yield from inside(0, len(d), ("meta", "iprp", "ipco"))
