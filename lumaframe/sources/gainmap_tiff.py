"""TIFF files that carry an SDR base and a gain map as two images."""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

from .images import byte_order, integers, places, samples, tiff_entries

#: The photometric interpretation and metadata tag of a gain map, and the
#: bytes that stand before its ISO metadata.
PHOTOMETRIC_GAIN, METADATA_TAG, PREFIX = 52553, 52557, 4


def _parts(data: bytes) -> tuple[dict, dict, bytes] | None:
    """Tags of the base and of the gain map, and the metadata; None without a gain map."""
    ifds: dict[str, dict[int, tuple[int, bytes]]] = defaultdict(dict)
    for ifd, tag, typ, _, value in tiff_entries(data):
        ifds[ifd][tag] = (typ, value)
    order = byte_order(data)
    numbers = {name: {tag: integers(v, typ, order) for tag, (typ, v) in t.items() if typ in (1, 3, 4)} for name, t in ifds.items()}
    name = next((n for n in sorted(ifds) if n.startswith("sub") and METADATA_TAG in ifds[n] and numbers[n].get(262, [0])[0] == PHOTOMETRIC_GAIN), None)
    if name is None:
        return None
    meta = ifds[name][METADATA_TAG][1][PREFIX:]
    if len(meta) < 61:
        raise ValueError("metadata are cut short")
    if struct.unpack_from(">I", meta, 5)[0]:
        raise ValueError("the base is the HDR side")
    return numbers["ifd0"], numbers[name], meta


def _plane(data: bytes, tags: dict[int, list[int]], what: str) -> np.ndarray:
    missing = [t for t in (256, 257, 258, 273, 279) if t not in tags]
    if missing:
        raise ValueError(f"{what}: tag {missing[0]} is missing")
    try:
        found = samples(data, tags, byte_order(data))
    except ValueError as e:
        raise ValueError(f"{what}: {e}") from e
    if found.dtype.itemsize != 2:
        raise ValueError(f"{what}: not 16-bit integers")
    return found


def gain_map(data: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns (y, x, three base codes, three gain codes).

    Nothing for files that hold no gain map; ValueError for ones that say they do and
    cannot be read, or whose base is the HDR side.
    """
    parts = _parts(data)
    if parts is None:
        return
    base, gain = _plane(data, parts[0], "base"), _plane(data, parts[1], "gain map")
    if gain.shape != base.shape:
        raise ValueError("the gain map is of another size")
    yield (*places(*base.shape[:2]), *base.reshape(-1, 3).T.astype(np.int32), *gain.reshape(-1, 3).T.astype(np.int32))


def gain_map_meta(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(width, height, metadata in hex) of a file with a gain map."""
    parts = _parts(data)
    if parts is not None:
        yield parts[0][256][0], parts[0][257][0], parts[2].hex().upper()


def write_gain_map(width: int, height: int, base: list[int], gain: list[int], meta: bytes) -> bytes:
    """A little-endian file of both planes, 16 bits a sample."""
    planes = [struct.pack(f"<{len(p)}H", *p) for p in (base, gain)]
    common = [(256, 4, [width]), (257, 4, [height]), (258, 3, [16, 16, 16]), (259, 3, [1])]
    n0, n1 = 9, 10
    at0 = 8
    at1 = at0 + 2 + 12 * n0 + 4
    extra_at = at1 + 2 + 12 * n1 + 4
    tag = b"\0" * PREFIX + meta
    places = [extra_at, extra_at + 6, extra_at + 12, extra_at + 12 + len(tag)]
    data_at = places[3] + (places[3] % 2)

    def directory(rows: list[tuple[int, int, int, int]]) -> bytes:
        return struct.pack("<H", len(rows)) + b"".join(struct.pack("<HHII", *r) for r in sorted(rows)) + b"\0\0\0\0"

    def rows(k: int) -> list[tuple[int, int, int, int]]:
        out = [(t, typ, 1, v[0]) for t, typ, v in common if t != 258] + [(258, 3, 3, places[k])]
        return out + [(273, 4, 1, data_at + k * len(planes[0])), (277, 3, 1, 3), (279, 4, 1, len(planes[k]))]

    first = rows(0) + [(262, 3, 1, 2), (330, 4, 1, at1)]
    second = rows(1) + [(262, 3, 1, PHOTOMETRIC_GAIN), (278, 4, 1, height), (METADATA_TAG, 7, len(tag), places[2])]
    head = b"II*\0" + struct.pack("<I", at0) + directory(first) + directory(second) + struct.pack("<6H", *[16] * 6) + tag
    return head.ljust(data_at, b"\0") + planes[0] + planes[1]
