"""Gain-map arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import EPS, clamp

#: Defaults of derivation.
OFFSET = 1 / 64
#: Displays, in stops, that delivery is checked on.
DISPLAYS = (1.0, 1.5, 2.0, 2.3, 2.98, 4.0)


def log2_gain(alt: Column, base: Column, alt_offset: float = OFFSET, base_offset: float = OFFSET) -> Column:
    """Stops from base to alternate luma; NaN stays NaN, and Spark's NULL of log2 at
    zero cannot arise."""
    ratio = (alt + alt_offset) / (base + base_offset)
    return F.when(F.isnan(ratio), F.lit(float("nan"))).otherwise(F.log2(F.greatest(ratio, F.lit(EPS))))


def normalise(gain: Column, low: Column, high: Column, gamma: float = 1.0) -> Column:
    """0..1 within the range; NaN counts as ``low``, infinities as the ends."""
    v = F.when(F.isnan(gain), low).otherwise(F.greatest(low, F.least(high, gain)))
    t = clamp((v - low) / F.when(high > low, high - low).otherwise(1.0))
    t = t if gamma == 1.0 else F.pow(t, F.lit(gamma))
    return F.when(high > low, t).otherwise(0.0)


def decode(t: Column, low: Column, high: Column, gamma: float | Column = 1.0) -> Column:
    """Stops of a normalised gain."""
    if isinstance(gamma, (int, float)):
        t = t if gamma == 1.0 else F.pow(t, F.lit(1 / max(gamma, EPS)))
    else:
        t = F.pow(t, 1 / F.greatest(gamma, F.lit(EPS)))
    return F.when(high > low, low + t * (high - low)).otherwise(low)


def gain_weight(base: Column, alt: Column, display: Column) -> Column:
    """How much of the map a display applies: linear in stops between the two
    headrooms, clamped, then negated where the alternate is the darker one."""
    w = clamp((display - base) / F.when(alt == base, 1.0).otherwise(alt - base))
    return F.when(alt == base, 0.0).when(alt < base, -w).otherwise(w)


def apply_gain(channel: Column, stops: Column, alt_offset: float = OFFSET, base_offset: float = OFFSET) -> Column:
    """Linear alternate of a linear base channel; not clamped above."""
    return F.greatest((channel + base_offset) * F.pow(F.lit(2.0), stops) - alt_offset, F.lit(0.0))
