"""Parsers and formatters of user-facing text as column expressions; errors are NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of sizes, spellings of names.
UNITS = {"": 1.0, "b": 1.0, "k": 1e3, "kb": 1e3, "kib": 1024.0, "m": 1e6, "mb": 1e6, "mib": 1024.0**2, "g": 1e9, "gb": 1e9, "gib": 1024.0**3}
PRIMARY_NAMES = {"srgb": "bt709", "bt709": "bt709", "rec709": "bt709", "709": "bt709", "p3": "display-p3", "displayp3": "display-p3", "dcip3": "display-p3", "bt2020": "bt2020", "rec2020": "bt2020", "2020": "bt2020"}
FLAVORS = {"apple": "apple", "iso": "iso", "ios": "iso", "both": "both"}
ENGINES = {"apple": "apple", "videotoolbox": "videotoolbox", "software": "software"}
TONE_MAPS = {"clip": "clip", "reinhard": "reinhard"}
CHROMA_QUALITY = 95  # fixed value: from here on chroma is kept whole


def choose(text: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    low = F.lower(text)
    for spelling, value in reversed(table.items()):
        out = F.when(low == spelling, value).otherwise(out)
    return out


def parse_primaries(text: Column) -> Column:
    return choose(F.translate(text, "-_. ", ""), PRIMARY_NAMES)


def parse_quality(text: Column) -> Column:
    n = F.when(F.rlike(text, F.lit(r"^\+?[0-9]{1,9}$")), text.cast("int"))
    return F.when(n.between(1, 100), n)


def parse_size(text: Column) -> Column:
    """Bytes: decimal for KB, MB, GB and bare letters, binary for KiB, MiB, GiB."""
    t = F.trim(text)
    number = F.regexp_extract(t, r"^([0-9.]*)", 1)
    unit = F.lower(F.trim(F.regexp_extract(t, r"^[0-9.]*(.*)$", 1)))
    factor = F.lit(None).cast("double")
    for name, value in UNITS.items():
        factor = F.when(unit == name, value).otherwise(factor)
    return F.when(F.rlike(number, F.lit(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$")), F.floor(number.try_cast("double") * factor))


def human_bytes(n: Column) -> Column:
    """Decimal units, halves to even. Of megabytes it is the double that is rounded, not its
    shortest decimals: 1.15 lies below the half, 1.05 above it, 1.25 on it."""
    mega = n / 1e6
    whole = F.floor(mega)
    # the fraction of a double from 1 on is a multiple of 2**-52, so this is exact
    left = F.floor((mega - whole) * 2.0**52) * 10
    tenths = whole * 10 + F.shiftright(left, 52)
    over = left.bitwiseAND(2**52 - 1)
    up = (over > 2**51) | ((over == 2**51) & (tenths % 2 == 1))
    tenths = tenths + up.cast("long")
    text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" MB"))
    return F.when(n >= 1_000_000, text).when(n >= 1_000, F.format_string("%.0f KB", F.bround(n / 1e3, 0))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def exit_code(status: Column) -> Column:
    """A raw wait status is a multiple of 256; anything else is a code already."""
    return F.when((status >= 256) & (status % 256 == 0), F.floor(status / 256)).otherwise(status)


def chroma_for(quality: Column) -> Column:
    return F.when(quality >= CHROMA_QUALITY, "4:4:4").otherwise("4:2:0")


def output_name(path: Column) -> Column:
    """Same stem, other extension; only the last extension goes."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.concat(F.when(F.rlike(name, F.lit(r"^.+\.[^.]*$")), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name), F.lit(".heic"))


def fourcc(code: Column) -> Column:
    """Four characters of a 32-bit code, or the other way round for strings by ``hex``."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "ISO-8859-1")
