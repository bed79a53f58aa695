"""ISO base-media boxes and HEIF structure of one file's bytes, as rows.

Parsers stop at the first malformed header and never trust a count further than the
bytes that are there. The checker has a parser of its own (``plans.checker``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

#: Boxes that hold boxes, and how many bytes stand before those.
HOLDERS = {"meta": 4, "iprp": 0, "ipco": 0, "moov": 0, "grpl": 0, "dinf": 0}


def be(data: bytes, at: int, n: int) -> int:
    if at < 0 or at + n > len(data):
        raise ValueError("read beyond the end")
    return int.from_bytes(data[at : at + n], "big")


def walk(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[str, int, int, int]]:
    """(type, offset, body, end) of the boxes in [start, end): 32-bit, 64-bit and
    to-the-end sizes."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, body = be(data, start, 4), start + 8
        if size == 1:
            if start + 16 > end:
                return
            size, body = be(data, start + 8, 8), start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            return
        yield data[start + 4 : start + 8].decode("latin-1"), start, body, start + size
        start += size


def tree(data: bytes) -> Iterator[tuple[int, str, str, int, int]]:
    """(depth, path, type, offset, length) of every box, depth first."""

    def under(start: int, end: int, depth: int, path: str) -> Iterator[tuple[int, str, str, int, int]]:
        for typ, off, body, stop in walk(data, start, end):
            here = f"{path}/{typ}"
            yield depth, here, typ, off, stop - off
            if typ in HOLDERS and depth < 8:
                yield from under(body + HOLDERS[typ], stop, depth + 1, here)

    yield from under(0, len(data), 0, "")


@dataclass
class Heif:
    """A file's structure as the tables of FIXTURES: one tuple per row."""

    brands: list[str] = field(default_factory=list)
    primary: int | None = None
    items: list[tuple] = field(default_factory=list)  # item_id, type, name, content_type, hidden
    refs: list[tuple] = field(default_factory=list)  # ref_type, from_id, to_id, ord
    props: list[tuple] = field(default_factory=list)  # prop_idx, type, width, height, bits, urn, value
    assoc: list[tuple] = field(default_factory=list)  # item_id, prop_idx, essential, ord
    locs: list[tuple] = field(default_factory=list)  # item_id, method, off, len, ord
    groups: list[tuple] = field(default_factory=list)  # group_type, group_id, entity_id, ord
    idat: tuple[int, int] | None = None


def _text(data: bytes, at: int, end: int) -> tuple[str, int]:
    stop = data.find(b"\0", at, end)
    stop = end if stop < 0 else stop
    return data[at:stop].decode("utf-8", "replace"), min(stop + 1, end)


def _items(h: Heif, d: bytes, body: int, end: int) -> None:
    version = d[body]
    at = body + (6 if version == 0 else 8)
    for typ, _, b, e in walk(d, at, end):
        if typ != "infe" or d[b] < 2:
            continue
        wide = d[b] == 3
        item = be(d, b + 4, 4 if wide else 2)
        p = b + (10 if wide else 8)
        kind = d[p : p + 4].decode("latin-1")
        name, p = _text(d, p + 4, e)
        content = _text(d, p, e)[0] if kind in ("mime", "uri ") else None
        h.items.append((item, kind, name, content, bool(be(d, b + 1, 3) & 1)))


def _refs(h: Heif, d: bytes, body: int, end: int) -> None:
    n = 4 if d[body] else 2
    for typ, _, b, e in walk(d, body + 4, end):
        source, count = be(d, b, n), be(d, b + n, 2)
        for i in range(min(count, (e - b - n - 2) // n)):
            h.refs.append((typ, source, be(d, b + n + 2 + i * n, n), len(h.refs)))


def _props(h: Heif, d: bytes, body: int, end: int) -> None:
    for typ, _, b, e in walk(d, body, end):
        if typ == "ipco":
            for i, (kind, _, pb, pe) in enumerate(walk(d, b, e), 1):
                w = hh = urn = None
                bits: list[int] | None = None
                value: int | None = None
                if kind == "ispe":
                    w, hh = be(d, pb + 4, 4), be(d, pb + 8, 4)
                elif kind == "pixi":
                    bits = list(d[pb + 5 : min(pe, pb + 5 + d[pb + 4])])
                elif kind == "auxC":
                    urn = _text(d, pb + 4, pe)[0]
                elif kind in ("irot", "imir") and pb < pe:
                    value = d[pb] & 3
                h.props.append((i, kind, w, hh, bits, urn, value))
        elif typ == "ipma":
            wide_id, wide_index = d[b] >= 1, be(d, b + 1, 3) & 1
            at = b + 8
            for _ in range(be(d, b + 4, 4)):
                if at >= e:
                    break
                item = be(d, at, 4 if wide_id else 2)
                at += 4 if wide_id else 2
                many, at = d[at], at + 1
                for _ in range(many):
                    v = be(d, at, 2 if wide_index else 1)
                    at += 2 if wide_index else 1
                    top = 15 if wide_index else 7
                    h.assoc.append((item, v & ((1 << top) - 1), bool(v >> top), len(h.assoc)))


def _locs(h: Heif, d: bytes, body: int, end: int) -> None:
    version = d[body]
    sizes = be(d, body + 4, 2)
    off_n, len_n, base_n, index_n = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15
    id_n = 2 if version < 2 else 4
    at = body + 6 + id_n
    for _ in range(be(d, body + 6, id_n)):
        if at >= end:
            break
        item = be(d, at, id_n)
        at += id_n
        method = 0
        if version:
            method, at = be(d, at, 2) & 15, at + 2
        at += 2
        base = be(d, at, base_n) if base_n else 0
        at += base_n
        extents, at = be(d, at, 2), at + 2
        for i in range(extents):
            if at >= end:
                break
            at += index_n if version else 0
            off = base + (be(d, at, off_n) if off_n else 0)
            size = be(d, at + off_n, len_n) if len_n else 0
            at += off_n + len_n
            h.locs.append((item, method, off, size, i))


def parse(d: bytes) -> Heif:
    """The structure of a file; raises ValueError for one that is cut short or no HEIF."""
    h = Heif()
    meta = None
    for typ, _, b, e in walk(d):
        if typ == "ftyp":
            h.brands = [d[i : i + 4].decode("latin-1") for i in range(b + 8, e - 3, 4)]
        elif typ == "meta":
            meta = b + 4, e
    if meta is None:
        raise ValueError("no meta box")
    for typ, _, b, e in walk(d, *meta):
        if typ == "pitm":
            h.primary = be(d, b + 4, 4 if d[b] else 2)
        elif typ == "iinf":
            _items(h, d, b, e)
        elif typ == "iref":
            _refs(h, d, b, e)
        elif typ == "iprp":
            _props(h, d, b, e)
        elif typ == "iloc":
            _locs(h, d, b, e)
        elif typ == "idat":
            h.idat = b, e
        elif typ == "grpl":
            for kind, _, gb, ge in walk(d, b, e):
                for i in range(min(be(d, gb + 8, 4), (ge - gb - 12) // 4)):
                    h.groups.append((kind, be(d, gb + 4, 4), be(d, gb + 12 + 4 * i, 4), i))
    return h


def item_bytes(d: bytes, h: Heif, item: int) -> bytes:
    """An item's data; its extents must be in bounds and follow each other."""
    parts, expected = [], None
    for _, method, off, size, _ in sorted((x for x in h.locs if x[0] == item), key=lambda x: x[4]):
        if method == 1:
            if h.idat is None:
                raise ValueError("no idat box")
            off += h.idat[0]
            if off + size > h.idat[1]:
                raise ValueError("extent beyond idat")
        elif method:
            raise ValueError("unsupported construction method")
        if off + size > len(d) or expected not in (None, off):
            raise ValueError("extent out of bounds or scattered")
        expected = off + size
        parts.append(d[off : off + size])
    if not parts:
        raise ValueError("no location")
    return b"".join(parts)
