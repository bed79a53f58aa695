"""Removing unregistered user data from length-prefixed HEVC units."""

from __future__ import annotations

#: The prefix-SEI unit type and the payload type of unregistered user data.
PREFIX_SEI, UNREGISTERED = 39, 5


def unescape(data: bytes) -> bytes:
    """Without emulation-prevention bytes."""
    return data.replace(b"\0\0\3", b"\0\0")


def _only_unregistered(unit: bytes) -> bool:
    if len(unit) < 3 or unit[0] >> 1 & 63 != PREFIX_SEI:
        return False
    body, at, seen = unescape(unit[2:]), 0, False
    while at < len(body) and body[at] != 0x80:
        header = []
        for _ in range(2):  # payload type, then size: runs of 255 and a last byte
            total = 0
            while at < len(body) and body[at] == 255:
                total, at = total + 255, at + 1
            if at >= len(body):
                return False
            header.append(total + body[at])
            at += 1
        kind, size = header
        if kind != UNREGISTERED or at + size > len(body):
            return False
        seen, at = True, at + size
    return seen


def strip_user_data(data: bytes) -> bytes:
    """Units as they are but for those that hold nothing else; what is no unit is kept."""
    out, at = [], 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        end = at + 4 + size
        if not size or end > len(data):
            break
        if not _only_unregistered(data[at + 4 : end]):
            out.append(data[at:end])
        at = end
    return b"".join(out) + data[at:]
