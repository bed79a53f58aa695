"""The seam for plane codecs, a lossless one for tests, and the search for a size."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from .mux import CodedImage


class PlaneCodec(Protocol):
    """Encodes one plane; HEVC encoders plug in here and are not part of this engine."""

    def encode(self, width: int, height: int, channels: int, samples: bytes, quality: int) -> CodedImage: ...


class DeflateCodec:
    """Deflated samples, with low bits dropped as quality falls. Lossless at 100."""

    def encode(self, width: int, height: int, channels: int, samples: bytes, quality: int) -> CodedImage:
        mask = 0xFF << ((100 - quality) // 13) & 0xFF
        data = zlib.compress(samples.translate(bytes(s & mask for s in range(256))), 6)
        config = bytes([1, 1]) + bytes(14) + bytes([0xFC | (0 if channels == 1 else 3), 0xF8]) + bytes(5)
        return CodedImage(width, height, 8, channels, config, data)

    def decode(self, coded: CodedImage) -> bytes:
        return zlib.decompress(coded.data)


@dataclass(frozen=True)
class Budgeted:
    data: bytes
    quality: int
    attempts: int
    within: bool


def gain_quality(quality: int, high: int, gain: int) -> int:
    """The gain map's quality beside a base's of ``quality``, in proportion to their
    highest, so that the map does not stay dear while the base starves."""
    return min(100, max(1, math.floor(quality * gain / high + 0.5)))


def encode_within(encode: Callable[[int], bytes], high: int, low: int, budget: int) -> Budgeted:
    """The best quality in [low, high] whose measured size fits: the highest first, then
    the floor, then halves. If not even the floor fits, the floor, marked so."""
    first = encode(high)
    if len(first) <= budget:
        return Budgeted(first, high, 1, True)
    if low >= high:
        return Budgeted(first, high, 1, False)
    best, tries = encode(low), 2
    if len(best) > budget:
        return Budgeted(best, low, tries, False)
    fits, over = low, high
    while over - fits > 1:
        middle = (fits + over) // 2
        out, tries = encode(middle), tries + 1
        if len(out) <= budget:
            fits, best = middle, out
        else:
            over = middle
    return Budgeted(best, fits, tries, True)
