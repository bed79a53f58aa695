"""The colour and gain arithmetic over flat arrays of samples, for tiles.

Same definitions as the column expressions of ``color`` and ``gain``; NaN is 0 as there.
"""

from __future__ import annotations

import numpy as np

from .color import EPS, LUMA
from .gain import OFFSET


def positive(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, 0.0)


def clamp(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.minimum(x, 1.0), 0.0)


def luma(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def codes(x: np.ndarray, top: int = 255) -> np.ndarray:
    """Nearest code of a value in 0..1."""
    return np.floor(x * top + 0.5).astype(np.uint8 if top < 256 else np.uint16)


def srgb_to_linear(x: np.ndarray) -> np.ndarray:
    return np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)


def linear_to_srgb8(x: np.ndarray) -> np.ndarray:
    x = clamp(x)
    return codes(np.where(x <= 0.0031308, x * 12.92, 1.055 * x ** (1 / 2.4) - 0.055))


#: Linear light of each 8-bit code.
LINEAR = srgb_to_linear(np.arange(256) / 255.0)


def tone_map(r: np.ndarray, g: np.ndarray, b: np.ndarray, white: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """8-bit codes of the SDR rendition; ``white`` of None clips."""
    l = positive(luma(r, g, b))
    if white is None:
        mapped = clamp(l)
    else:
        w = np.maximum(white, 1.0)
        mapped = clamp(l * (1 + l / (w * w)) / (1 + l))
    lit = l > EPS
    scale = np.where(lit, mapped / np.where(lit, l, 1.0), 1.0)
    return tuple(linear_to_srgb8(c * scale) for c in (r, g, b))


def log2_gain(alt: np.ndarray, base: np.ndarray) -> np.ndarray:
    ratio = (alt + OFFSET) / (base + OFFSET)
    return np.log2(np.where(np.isnan(ratio), ratio, np.maximum(ratio, EPS)))


def normalise(gain: np.ndarray, low: np.ndarray, high: np.ndarray, gamma: float = 1.0) -> np.ndarray:
    span = np.where(high > low, high - low, 1.0)
    t = clamp((np.clip(np.where(np.isnan(gain), low, gain), low, high) - low) / span)
    return np.where(high > low, t if gamma == 1.0 else t**gamma, 0.0)


def decode(t: np.ndarray, low: np.ndarray, high: np.ndarray, gamma: float = 1.0) -> np.ndarray:
    t = t if gamma == 1.0 else t ** (1 / max(gamma, EPS))
    return np.where(high > low, low + t * (high - low), low)


def apply_gain(channel: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return np.maximum((channel + OFFSET) * 2.0**stops - OFFSET, 0.0)
