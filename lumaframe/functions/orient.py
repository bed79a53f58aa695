"""Exif orientations and the container's rotation and mirror."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Orientation -> (quarter turns anti-clockwise, mirror axis or None).
TRANSFORMS = {1: (0, None), 2: (0, 1), 3: (2, None), 4: (0, 0), 5: (1, 0), 6: (3, None), 7: (1, 1), 8: (1, None)}


def rotation(orientation: Column) -> Column:
    out = F.lit(0)
    for o, (turns, _) in TRANSFORMS.items():
        out = F.when(orientation == o, turns).otherwise(out)
    return out


def mirror(orientation: Column) -> Column:
    out = F.lit(None).cast("int")
    for o, (_, axis) in TRANSFORMS.items():
        out = F.when(orientation == o, F.lit(axis).cast("int")).otherwise(out)
    return out


def orientation_of(turns: Column, axis: Column) -> Column:
    """The orientation with this transform, or 1."""
    out = F.lit(1)
    for o, (t, a) in TRANSFORMS.items():
        out = F.when((turns == t) & axis.eqNullSafe(F.lit(a).cast("int")), o).otherwise(out)
    return out


def transformed(x: Column, y: Column, w: Column, h: Column, turns: Column, axis: Column) -> tuple[Column, Column]:
    """Where a pixel goes: turned first, then mirrored about the turned image's axis."""
    tx = F.when(turns == 1, y).when(turns == 2, w - 1 - x).when(turns == 3, h - 1 - y).otherwise(x)
    ty = F.when(turns == 1, w - 1 - x).when(turns == 2, h - 1 - y).when(turns == 3, x).otherwise(y)
    odd = turns % 2 == 1
    tw, th = F.when(odd, h).otherwise(w), F.when(odd, w).otherwise(h)
    return F.when(axis == 1, tw - 1 - tx).otherwise(tx), F.when(axis == 0, th - 1 - ty).otherwise(ty)
