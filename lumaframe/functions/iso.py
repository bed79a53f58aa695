"""ISO 21496-1 gain-map metadata (C.2.2) as hexadecimal strings in SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Denominator written, widest value read, payload lengths with the version byte.
DENOMINATOR, MOST = 65536, 64.0
PAYLOAD_MONO, PAYLOAD_THREE = 62, 142
FIELDS = ("min_log2", "max_log2", "gamma", "base_offset", "alt_offset")
SIGNED = {"min_log2", "max_log2", "base_offset", "alt_offset"}


def numerator(value: Column, signed: bool) -> Column:
    n = F.round(value * DENOMINATOR)
    low, high = (-(2.0**31), 2.0**31 - 1) if signed else (0.0, 2.0**32 - 1)
    return F.greatest(F.lit(low), F.least(F.lit(high), n)).cast("long")


def _word(n: Column) -> Column:
    return F.lpad(F.hex(n.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0")


def fraction(value: Column, signed: bool) -> Column:
    return F.concat(_word(numerator(value, signed)), F.lit(f"{DENOMINATOR:08X}"))


def serialize(channels: list[dict[str, Column]], base_headroom: Column, alt_headroom: Column, base_space: Column) -> Column:
    """Hexadecimal digits of the 61 bytes of one channel, or 141 of three."""
    flags = F.when(base_space, 0x40).otherwise(0) + F.lit(0x80 if len(channels) == 3 else 0)
    parts = [F.lit("00000000"), F.lpad(F.hex(flags.cast("long")), 2, "0"), fraction(base_headroom, False), fraction(alt_headroom, False)]
    parts += [fraction(c[f], f in SIGNED) for c in channels for f in FIELDS]
    return F.concat(*parts)


def channels_identical(arrays: list[Column]) -> Column:
    out = F.lit(True)
    for a in arrays:
        out = out & (F.size(F.array_distinct(a)) == 1)
    return out


def word_at(digits: Column, byte: int, signed: bool) -> Column:
    n = F.conv(F.substring(digits, byte * 2 + 1, 8), 16, 10).cast("long")
    return F.when(n >= 2**31, n - 2**32).otherwise(n) if signed else n


def fraction_at(digits: Column, byte: int, signed: bool) -> Column:
    """NULL for a zero denominator."""
    den = word_at(digits, byte + 4, False)
    return F.when(den != 0, word_at(digits, byte, signed) / F.when(den != 0, den).otherwise(1))


def _read(digits: Column) -> tuple[dict[str, Column], dict[str, list[Column]], Column, Column, Column]:
    """Headrooms, each field's three channels, flags, whether there are three, error."""
    flags = F.conv(F.substring(digits, 9, 2), 16, 10).cast("int")
    three = flags.bitwiseAND(0x80) != 0
    need = F.when(three, 141).otherwise(61) * 2
    rooms = {"base_headroom": fraction_at(digits, 5, False), "alt_headroom": fraction_at(digits, 13, False)}
    fields = {f: [fraction_at(digits, 21 + 40 * c + 8 * i, f in SIGNED) for c in range(3)] for i, f in enumerate(FIELDS)}
    version = F.conv(F.substring(digits, 1, 4), 16, 10).cast("int")
    zero, wide = F.lit(False), F.lit(False)
    for v, counts in [*((v, F.lit(True)) for v in rooms.values()), *((v, F.lit(True) if c == 0 else three) for of in fields.values() for c, v in enumerate(of))]:
        zero, wide = zero | (counts & v.isNull()), wide | (counts & (F.abs(v) > MOST))
    error = F.when(F.length(digits) < 10, "truncated").when(version != 0, "version").when(F.length(digits) < need, "truncated").when(zero, "denominator").when(wide, "range")
    return rooms, fields, flags, three, error


def parse(digits: Column) -> dict[str, Column]:
    """Fields of the (first) channel and ``error``: truncated, version, denominator, range
    or NULL, of any channel. Fields are NULL where there is an error."""
    rooms, fields, flags, _, error = _read(digits)
    values = rooms | {f: v[0] for f, v in fields.items()}
    return {f: F.when(error.isNull(), v) for f, v in values.items()} | {"base_space": F.when(error.isNull(), flags.bitwiseAND(0x40) != 0), "error": error}


def parse_channels(digits: Column) -> dict[str, Column]:
    """``parse`` with each channel's field as an array of one or three: ``F.array_max`` is
    the greatest over channels, and ``channel_of`` a channel's own."""
    rooms, fields, flags, three, error = _read(digits)
    values = rooms | {f: F.when(three, F.array(*v)).otherwise(F.array(v[0])) for f, v in fields.items()}
    return {f: F.when(error.isNull(), v) for f, v in values.items()} | {"base_space": F.when(error.isNull(), flags.bitwiseAND(0x40) != 0), "error": error}


def channel_of(values: Column, channel: int) -> Column:
    """A channel's value; one that stands alone is that of all."""
    return F.coalesce(F.get(values, F.lit(channel)), F.get(values, F.lit(0)))


def expected_length(digits: Column) -> Column:
    """Bytes that a tone-map payload (with its version byte) should have by its flags."""
    flags = F.conv(F.substring(digits, 11, 2), 16, 10).cast("int")
    return F.when(flags.bitwiseAND(0x80) != 0, PAYLOAD_THREE).otherwise(PAYLOAD_MONO)
