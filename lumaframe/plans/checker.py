"""Facts of a container for the rules, by a parser of its own.

It shares no code with ``sources.boxes``: agreement of two readers is what makes a check
of our own files worth something. It reads a file in one pass into one row of facts.
"""

from __future__ import annotations

import struct
from collections import defaultdict

#: Fixed value: the auxiliary type that marks a gain map.
AUXILIARY = b"urn:com:apple:photo:2020:aux:hdrgainmap"


class _Box:
    def __init__(self, raw: memoryview, kind: bytes, start: int, stop: int) -> None:
        self.raw, self.kind, self.start, self.stop = raw, kind, start, stop

    def children(self, skip: int = 0) -> list["_Box"]:
        out, at = [], self.start + skip
        while at + 8 <= self.stop:
            length, kind = struct.unpack_from(">I4s", self.raw, at)
            head = 8
            if length == 1 and at + 16 <= self.stop:
                length, head = struct.unpack_from(">Q", self.raw, at + 8)[0], 16
            elif length == 0:
                length = self.stop - at
            if length < head or at + length > self.stop:
                break
            out.append(_Box(self.raw, kind, at + head, at + length))
            at += length
        return out

    def child(self, kind: bytes, skip: int = 0) -> "_Box | None":
        return next((c for c in self.children(skip) if c.kind == kind), None)

    @property
    def version(self) -> int:
        return self.raw[self.start]

    def bytes(self, skip: int = 0) -> bytes:
        return bytes(self.raw[self.start + skip : self.stop])

    def u(self, code: str, at: int):
        return struct.unpack_from(">" + code, self.raw[: self.stop], self.start + at)


def _iso(payload: bytes) -> dict | None:
    """Fields of a payload after its version byte; None if it cannot be read."""
    try:
        minimum, _, flags = struct.unpack_from(">HHB", payload, 1)
        if minimum:
            return None
        channels = 3 if flags & 0x80 else 1
        words = struct.unpack_from(f">{4 + 10 * channels}I", payload, 6)
        pairs = [words[i : i + 2] for i in range(0, len(words), 2)]
        if any(d == 0 for _, d in pairs):
            return None
        signed = [(n - (1 << 32) if n >> 31 else n) / d for n, d in pairs]
        plain = [n / d for n, d in pairs]
        per = [dict(zip(("min", "max", "gamma"), (signed[2 + 5 * c], signed[3 + 5 * c], plain[4 + 5 * c]))) for c in range(channels)]
        values = [plain[0], plain[1], *(v for p in per for v in p.values())]
        if any(abs(v) > 64 for v in values):
            return None
        return {"base": plain[0], "alt": plain[1], "min": min(p["min"] for p in per), "max": max(p["max"] for p in per), "gamma": min(p["gamma"] for p in per)}
    except struct.error:
        return None


def _headroom_tags(exif: bytes) -> tuple[float | None, float | None]:
    """Tags 33 and 48 of the maker's note, found by its signature: places in it count from
    where it starts. A missing tag 48 beside a tag 33 is zero."""
    at = exif.find(b"Apple iOS\0")
    if at < 0:
        return None, None
    note, out = exif[at:], {}
    code = "<" if note[12:14] == b"II" else ">"
    try:
        for i in range(struct.unpack_from(code + "H", note, 14)[0]):
            tag, kind, n, place = struct.unpack_from(code + "HHII", note, 16 + 12 * i)
            if tag in (33, 48) and kind in (5, 10) and n == 1:
                a, b = struct.unpack_from(code + "ii", note, place)
                out[tag] = a / b if b else None
    except struct.error:
        pass
    return out.get(33), out.get(48)


def facts(path: str, data: bytes) -> tuple:
    """One row of ``checks.FACTS``; raises ValueError for what is no HEIF file."""
    root = _Box(memoryview(data), b"", 0, len(data))
    meta = root.child(b"meta")
    ftyp = root.child(b"ftyp")
    if meta is None or ftyp is None:
        raise ValueError("no HEIF file")
    brands = {ftyp.bytes()[i : i + 4] for i in (0, *range(8, ftyp.stop - ftyp.start - 3, 4))}
    parts = {c.kind: c for c in meta.children(4)}
    pitm = parts.get(b"pitm")
    primary = pitm.u("I" if pitm.version else "H", 4)[0] if pitm else None

    kinds, hidden, mime = {}, {}, {}
    if iinf := parts.get(b"iinf"):
        for e in iinf.children(6 if iinf.version == 0 else 8):
            if e.kind == b"infe" and e.version >= 2:
                wide = e.version == 3
                item, kind = e.u("I" if wide else "H", 4)[0], e.bytes(10 if wide else 8)
                kinds[item], hidden[item] = kind[:4].decode("latin-1"), bool(e.raw[e.start + 3] & 1)
                mime[item] = kind[4:].split(b"\0")[1] if kind[4:].count(b"\0") > 1 else b""
    to = defaultdict(list)
    if iref := parts.get(b"iref"):
        code = "I" if iref.version else "H"
        for r in iref.children(4):
            size = struct.calcsize(code)
            source, many = r.u(code, 0)[0], r.u("H", size)[0]
            to[source, r.kind] += r.u(f"{min(many, (r.stop - r.start - size - 2) // size)}{code}", size + 2)
    props, own = [], defaultdict(list)
    if iprp := parts.get(b"iprp"):
        props = ipco.children() if (ipco := iprp.child(b"ipco")) else []
        if ipma := iprp.child(b"ipma"):
            at, narrow = 8, not ipma.raw[ipma.start + 3] & 1
            try:
                for _ in range(ipma.u("I", 4)[0]):
                    item = ipma.u("I" if ipma.version else "H", at)[0]
                    at += 4 if ipma.version else 2
                    many, at = ipma.u("B", at)[0], at + 1
                    for _ in range(many):
                        index = ipma.u("B", at)[0] & 0x7F if narrow else ipma.u("H", at)[0] & 0x7FFF
                        at += 1 if narrow else 2
                        if 1 <= index <= len(props):
                            own[item].append(props[index - 1])
            except struct.error:
                pass
    where = defaultdict(list)
    if iloc := parts.get(b"iloc"):
        a, b = iloc.u("BB", 4)
        code = {0: "", 4: "I", 8: "Q"}
        id_code = "I" if iloc.version == 2 else "H"
        at = 6 + struct.calcsize(id_code)
        try:
            for _ in range(iloc.u(id_code, 6)[0]):
                item, at = iloc.u(id_code, at)[0], at + struct.calcsize(id_code)
                method = 0
                if iloc.version:
                    method, at = iloc.u("H", at)[0] & 15, at + 2
                at += 2
                base = sum(iloc.u(code[b >> 4], at))
                at += b >> 4
                many, at = iloc.u("H", at)[0], at + 2
                for _ in range(many):
                    at += b & 15 if iloc.version else 0
                    off, at = sum(iloc.u(code[a >> 4], at)), at + (a >> 4)
                    size, at = sum(iloc.u(code[a & 15], at)), at + (a & 15)
                    where[item].append((method, base + off, size))
        except (struct.error, KeyError):
            pass
    idat = parts.get(b"idat")

    def content(item: int) -> bytes | None:
        out = b""
        for method, off, size in where.get(item, ()):
            start = off + (idat.start if method == 1 and idat else 0)
            if method > 1 or start + size > len(data):
                return None
            out += data[start : start + size]
        return out if item in where else None

    def prop(item: int | None, kind: bytes) -> _Box | None:
        return next((p for p in own.get(item, ()) if p.kind == kind), None)

    apple = next((i for i in kinds if (p := prop(i, b"auxC")) and p.bytes(4).split(b"\0")[0] == AUXILIARY), None)
    tmap = next((i for i, k in kinds.items() if k == "tmap"), None)
    inputs = to[tmap, b"dimg"] if tmap else []
    gain = apple if apple is not None else inputs[1] if len(inputs) > 1 else None
    pixi = prop(gain, b"pixi")
    payload = content(tmap) if tmap else None
    iso = _iso(payload) if payload is not None else None
    want = None if payload is None else 142 if len(payload) > 5 and payload[5] & 0x80 else 62
    xmp = None
    for item, m in mime.items():
        if m == b"application/rdf+xml" and (text := content(item)):
            _, found, rest = text.partition(b'HDRGainMapHeadroom="')
            xmp = float(rest.split(b'"')[0]) if found else xmp
    exif = next((content(i) for i, k in kinds.items() if k == "Exif"), None)
    tag33, tag48 = _headroom_tags(exif or b"")
    altr = [set(g.u(f"{min(g.u('I', 8)[0], (g.stop - g.start - 12) // 4)}I", 12)) for g in (parts[b"grpl"].children() if b"grpl" in parts else ()) if g.kind == b"altr"]
    iso = iso or {}
    return (
        path, primary, kinds.get(primary), hidden.get(primary, False), gain, list(pixi.bytes(5)[: pixi.bytes(4)[0]]) if pixi else None, apple, list(to[apple, b"auxl"]) if apple else [], tmap, list(inputs),
        b"tmap" in brands, None if payload is None else len(payload), want, bool(iso), iso.get("min"), iso.get("max"), iso.get("gamma"), iso.get("base"), iso.get("alt"),
        xmp, tag33, tag48, any({tmap, primary} <= g for g in altr),
    )
