"""Writing HEIF files: base and gain planes, metadata items and signalling to bytes."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The auxiliary type of the gain map, and what signalling each flavor writes.
GAIN_URN = "urn:com:apple:photo:2020:aux:hdrgainmap"
FLAVORS = {"apple": (True, False), "iso": (False, True), "both": (True, True)}


@dataclass(frozen=True)
class CodedImage:
    """A plane as a codec left it; the muxer does not look inside."""

    width: int
    height: int
    depth: int
    channels: int
    config: bytes
    data: bytes


@dataclass(frozen=True)
class MuxRequest:
    base: CodedImage
    gain: CodedImage
    flavor: str = "both"
    iso_payload: bytes | None = None
    exif: bytes | None = None
    xmp: bytes | None = None
    opaque: tuple[tuple[str, str, bytes], ...] = ()  # (item type, name, data)
    turns: int = 0
    mirror: int | None = None
    nclx: tuple[int, int, int] = (1, 13, 6)
    brands: tuple[str, ...] = field(default=("heic", "mif1"))


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return (len(body) + 8).to_bytes(4, "big") + kind.encode("latin-1") + body


def full(kind: str, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, bytes([version]) + flags.to_bytes(3, "big"), *parts)


def n(value: int, size: int) -> bytes:
    return value.to_bytes(size, "big")


def _infe(item: int, kind: str, name: str = "", content: str | None = None, hidden: bool = False) -> bytes:
    tail = b"" if content is None else content.encode() + b"\0"
    return full("infe", 2, int(hidden), n(item, 2), n(0, 2), kind.encode("latin-1"), name.encode() + b"\0", tail)


def mux(q: MuxRequest) -> bytes:
    """The file. Item 1 is the base and primary, item 2 the gain map; offsets are known
    once the meta box's length is, so it is built twice, the second time in place."""
    apple, iso = FLAVORS[q.flavor]
    items: list[tuple[int, str, str, str | None, bool, bytes | None]] = [(1, "hvc1", "", None, False, q.base.data), (2, "hvc1", "", None, True, q.gain.data)]
    refs: list[tuple[str, int, list[int]]] = []
    if apple:
        refs.append(("auxl", 2, [1]))
    tmap = None
    if iso:
        if q.iso_payload is None:
            raise ValueError("iso flavors need a payload")
        tmap = 3
        items.append((tmap, "tmap", "", None, False, q.iso_payload))
        refs.append(("dimg", tmap, [1, 2]))
    extra = [("Exif", "", None, n(0, 4) + q.exif)] if q.exif else []
    extra += [("mime", "XMP", "application/rdf+xml", q.xmp)] if q.xmp else []
    extra += [(kind, name, None, data) for kind, name, data in q.opaque]
    for kind, name, content, data in extra:
        item = len(items) + 1
        items.append((item, kind, name, content, kind != "Exif", data))
        refs.append(("cdsc", item, [1]))

    def ispe(c: CodedImage) -> bytes:
        return full("ispe", 0, 0, n(c.width, 4), n(c.height, 4))

    def pixi(c: CodedImage) -> bytes:
        return full("pixi", 0, 0, bytes([c.channels] + [c.depth] * c.channels))

    props = [box("hvcC", q.base.config), ispe(q.base), pixi(q.base), box("colr", b"nclx", *(n(x, 2) for x in q.nclx), b"\x80"), box("hvcC", q.gain.config), ispe(q.gain), pixi(q.gain)]
    base, gain = [1, 2, 3, 4], [5, 6, 7]
    if q.turns:
        props.append(box("irot", bytes([q.turns & 3])))
        base.append(len(props))
    if q.mirror is not None:
        props.append(box("imir", bytes([q.mirror & 1])))
        base.append(len(props))
    if apple:
        props.append(full("auxC", 0, 0, GAIN_URN.encode() + b"\0"))
        gain.append(len(props))
    assoc = [(1, base), (2, gain)] + ([(tmap, [2, 3, 4])] if tmap else [])
    ipma = full("ipma", 0, 0, n(len(assoc), 4), *(n(i, 2) + bytes([len(p)]) + bytes(0x80 | x if x in (1, 5) else x for x in p) for i, p in assoc))

    def meta(data_at: int) -> bytes:
        locs, at = b"", data_at
        for item, *_, data in items:
            locs += n(item, 2) + n(0, 2) + n(0, 2) + n(1, 2) + n(at, 4) + n(len(data), 4)
            at += len(data)
        parts = [
            full("hdlr", 0, 0, n(0, 4), b"pict", n(0, 12), b"\0"), full("pitm", 0, 0, n(1, 2)),
            full("iinf", 0, 0, n(len(items), 2), *(_infe(i, k, name, c, hid) for i, k, name, c, hid, _ in items)),
            full("iref", 0, 0, *(box(k, n(f, 2), n(len(to), 2), *(n(t, 2) for t in to)) for k, f, to in refs)),
            box("iprp", box("ipco", *props), ipma), full("iloc", 1, 0, b"\x44\0", n(len(items), 2), locs),
        ]
        if tmap:
            parts.append(box("grpl", full("altr", 0, 0, n(100, 4), n(2, 4), n(tmap, 4), n(1, 4))))
        return full("meta", 0, 0, *parts)

    brands = q.brands + (("tmap",) if iso else ())
    ftyp = box("ftyp", b"heic", n(0, 4), *(b.encode() for b in brands))
    head = len(ftyp) + len(meta(0)) + 8
    return ftyp + meta(head) + box("mdat", *(x[-1] for x in items))
