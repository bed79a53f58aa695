"""Removal of repeated passages by threshold-bounded interval expansion on a BWT.

Every byte covered by a string of ``MIN_LENGTH`` (200) bytes that also starts
anywhere else, in any document or at another place of the same one, is removed.
Strings are judged on the input and never cross documents.

A suffix array of all text cannot be built in one place, so its suffixes are dealt
out so that suffixes which could share 200 bytes meet:

1. Anchors. In each run of 137 consecutive 64-byte grams the leftmost one with the
   least hash is an anchor; the 137 grams are the grams of one 200-byte string, so a
   string has one anchor, at the same place in each of its copies. An anchor owns the
   strings it is the anchor of: those that start at ``lo .. lo + n - 1``.
2. Copies of an anchor's whole stretch (its strings taken together) are found by
   hash: in an Arrow batch before anything is shuffled, then by a shuffle on the
   gram's hash. That settles all but the ends of repeated passages.
3. Where a gram occurs in different stretches, those stretches are fetched, one for
   each distinct one, and sorted by what follows the gram: the interval of the gram in
   the suffix array. Breadth first, all intervals of a task are extended backward
   by one byte at a time (a stable split by the byte before, as the last column of
   the Burrows-Wheeler transform gives it), which derives the common prefixes by
   increasing left extension d. Expansion is bounded by the threshold: a suffix whose
   common prefix can no longer reach 200 bytes leaves, and so do single intervals. A
   string is repeated where the interval's neighbours share 200 - d bytes or more.

Scale: about one short row per 69 bytes is shuffled once, text twice (compressed).
Copies collapse per batch before the shuffle, so a hot passage costs one row per
batch. Grams with more than ``HOT_GRAM`` of those rows are found by counts, with map-side
sums, before any of their rows meet. They are dealt out by gram and stretch, and
their strings are counted by two hashes of all 200 bytes with map-side sums instead.

Hashes are two polynomials modulo a prime, 62 bits; equality of stretches takes two such
hashes of different bases and the length.
Defined results: null text counts as empty; null doc_id is an id like any other;
repeated rows are copies of each other; texts under 200 bytes lose nothing; a very long
text is hashed a block at a time, all of it; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, materialize, sized, with_row_key

MIN_LENGTH = 200
GRAM = 64
GRAMS = MIN_LENGTH - GRAM + 1
#: Different stretches of one gram that a task compares.
HOT_GRAM = 20_000
#: Bytes of text hashed at a time, few enough for a processor's cache; places within one
#: take PLACE_BITS.
PLACE_BITS = 17
BLOCK = 1 << PLACE_BITS
#: Bytes of scanned input for each task of the gram shuffle.
BYTES_PER_TASK = 32 << 20
#: Rows whose intervals are expanded together.
ROWS_TOGETHER = 50_000
#: Kinds of row: an anchor, a stretch known to be repeated, one to compare, one of a hot gram.
ANCHOR, REPEATED, COMPARE, HOT = range(4)

_U = np.uint64
#: Hashes are polynomials modulo this prime; bases come two by two, for 62 bits.
PRIME = (1 << 31) - 1
GRAM_BASES, STRETCH_BASES = (1_103_515_245, 1_812_433_253), (1_664_525, 1_566_083_941)
#: Hash bits of gram, of at least this many rows each, by which hot grams are looked for.
LEAST_BUCKET_BITS, UNKNOWN_BUCKET_BITS = 16, 24
_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


# what stands for each byte: numbers below the prime, none of them zero
_BYTES = _mix(np.arange(1, 257, dtype=_U) * _U(_B1)) % _U(PRIME - 1) + _U(1)


def _folded(x: np.ndarray) -> np.ndarray:
    """A number that equals ``x`` modulo the prime; of less than 2^62 it is below 2^32."""
    return (x & _U(PRIME)) + (x >> _U(31))


class Roll:
    """Hashes of any substring of ``data`` (BLOCK bytes at most) in constant time: two
    polynomials modulo a prime, in which a string's place can be divided out. A
    modulus of 2^64 would do with one, but strings that double themselves defeat it."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, bases: tuple[int, int] = GRAM_BASES) -> None:
        self.sums, self.down = [], []
        values = _BYTES[data]
        for base in bases:
            up, down = self._of(base, len(data) + 1)
            sums = np.zeros(len(data) + 1, dtype=_U)
            np.cumsum(_folded(values * up[: len(data)]), out=sums[1:])
            self.sums.append(sums)
            self.down.append(down)

    @classmethod
    def _of(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(base)
        if have is None or len(have[0]) < n:
            size = 1 << max(16, (n - 1).bit_length())

            def powers(b: int) -> np.ndarray:
                p = np.ones(1, dtype=_U)
                while len(p) < size:
                    p = np.concatenate([p, p * _U(pow(b, len(p), PRIME)) % _U(PRIME)])
                return p

            have = cls._powers[base] = powers(base), powers(pow(base, -1, PRIME))
        return have

    @staticmethod
    def _hash(differences: list[np.ndarray], downs: list[np.ndarray]) -> np.ndarray:
        # sums of BLOCK numbers below 2^32 are below 2^52, so folded below 2^31 + 2^21
        one, two = (_folded(_folded(_folded(d) * down)) for d, down in zip(differences, downs))
        one, two = ((x + ((x + _U(1)) >> _U(31))) & _U(PRIME) for x in (one, two))  # the prime itself is zero
        return _mix(one << _U(32) | two)

    def __call__(self, start, end) -> np.ndarray:
        return self._hash([s[end] - s[start] for s in self.sums], [d[start] for d in self.down])

    def all(self, n: int) -> np.ndarray:
        """Of each substring of n bytes, by its start."""
        return self._hash([s[n:] - s[:-n] for s in self.sums], [d[: len(s) - n] for s, d in zip(self.sums, self.down)])


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each run of w."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of each anchor in texts that hold at most BLOCK bytes together: index of its
    text, gram hash, stretch hash, lo, n, at (the gram's place after lo).

    A stretch is text[lo : lo + n - 1 + MIN_LENGTH].
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(data) < MIN_LENGTH:
        return (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U), *(np.zeros(0, np.int64),) * 3)
    first = np.cumsum(sizes) - sizes
    roll = Roll(data)
    grams = roll.all(GRAM)
    place_mask = _U((1 << PLACE_BITS) - 1)
    # the least hash, and of equal ones the leftmost place
    least = _window_min((grams & ~place_mask) | np.arange(len(grams), dtype=_U), GRAMS)
    place = (least & place_mask).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(place)]
    valid = np.flatnonzero(np.arange(len(place)) + MIN_LENGTH <= (first + sizes)[owner])  # strings within one text
    place, owner = place[valid], owner[valid]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])) if len(valid) else np.zeros(0, np.int64)
    n = np.diff(np.append(new, len(valid)))
    lo, at, own = valid[new], place[new], owner[new]
    stretch = Roll(data, STRETCH_BASES)(lo, lo + n - 1 + MIN_LENGTH) ^ _mix(n.astype(_U) * _U(_B2) + (at - lo).astype(_U))
    return own, grams[at], stretch, lo - first[own], n, at - lo


def _chunks(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(index, begin, text) in lots of at most BLOCK bytes; longer texts come in parts
    that overlap so that each string is in one part."""
    index, begin, lot, size = [], [], [], 0
    for i, t in enumerate(texts):
        if len(t) < MIN_LENGTH:
            continue
        step = BLOCK - MIN_LENGTH + 1
        for at in range(0, len(t) - MIN_LENGTH + 1, step):
            part = t[at : at + BLOCK]
            if size + len(part) > BLOCK:
                yield index, begin, lot
                index, begin, lot, size = [], [], [], 0
            index.append(i)
            begin.append(at)
            lot.append(part)
            size += len(part)
    if lot:
        yield index, begin, lot


_COLUMNS = ("kind", "gram", "stretch", "doc", "lo", "n", "at", "copies")
#: Spark gives this size or more where it knows none.
UNKNOWN_SIZE = 1 << 60
_ANCHOR_ROW = f"kind int, gram long, stretch long, doc {ROW_KEY}, lo long, n int, at int, copies int"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _batch(kind, gram, stretch, doc: pa.Array, lo, n, at, copies) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), _signed(gram), _signed(stretch), doc, pa.array(lo), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(copies.astype(np.int32))], list(_COLUMNS))


def _same(gram: np.ndarray, stretch: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (gram, stretch, n), the starts of equal ones in it, and their numbers."""
    order = np.lexsort((n, stretch, gram))
    g, s, m = gram[order], stretch[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (m[1:] != m[:-1])])) if len(g) else np.zeros(0, np.int64)
    return order, starts, np.diff(np.append(starts, len(g)))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of each batch; stretches that the batch holds more than once are
    settled here, and one row of each goes on with ``copies`` above one."""
    for b in batches:
        found = []
        for index, begin, lot in _chunks([t or b"" for t in b["text"].to_pylist()]):
            own, gram, stretch, lo, n, at = anchors(lot)
            found.append((np.array(index)[own], gram, stretch, lo + np.array(begin)[own], n, at))
        if not found:
            continue
        row, gram, stretch, lo, n, at = (np.concatenate(c) for c in zip(*found))
        order, starts, many = _same(gram, stretch, n)
        for rows, kind, copies in ((order[starts], ANCHOR, np.minimum(many, 2)), (order[np.repeat(many, many) > 1], REPEATED, None)):
            if len(rows):
                yield _batch(np.full(len(rows), kind), gram[rows], stretch[rows], b["doc"].take(pa.array(row[rows])), lo[rows], n[rows], at[rows], np.full(len(rows), 2) if copies is None else copies)


def _buckets(bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(bucket, n): anchors by the first bits of their gram, as _scan sends them on."""
        lot, size = [], 0

        def flush() -> pa.RecordBatch:
            bucket, n = np.unique(np.concatenate(lot), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(n)], ["bucket", "n"])

        for b in _scan(batches):
            gram = b["gram"].to_numpy().view(_U)[b["kind"].to_numpy() == ANCHOR]
            lot.append(gram >> _U(64 - bits))
            size += len(gram)
            if size > 1 << 22:
                yield flush()
                lot, size = [], 0
        if size:
            yield flush()

    return count


def hot_grams(keyed: DataFrame, hot_gram: int, bits: int) -> DataFrame | None:
    """(gram) of all grams with more than ``hot_gram`` anchors, or None if there are none:
    counted before any of them meet. Most buckets of grams hold too few for one; only
    the grams of the others are counted themselves."""
    counts = keyed.mapInArrow(_buckets(bits), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    full = materialize(counts.where(F.col("n") > hot_gram).select("bucket"), "full_buckets")
    if full.isEmpty():
        return None
    grams = keyed.mapInArrow(_scan, _ANCHOR_ROW).where(f"kind = {ANCHOR}").select("gram", F.shiftrightunsigned("gram", 64 - bits).alias("bucket"))
    hot = materialize(grams.join(sized(full), "bucket").groupBy("gram").agg(F.count("*").alias("many")).where(F.col("many") > hot_gram).select("gram"), "hot_grams")
    return None if hot.isEmpty() else hot


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is settled already, as it is, and what _settle makes of the anchors."""
    waiting = []
    for b in batches:
        done = b["kind"].to_numpy() == REPEATED
        for rows, keep in ((np.flatnonzero(done), True), (np.flatnonzero(~done), False)):
            if len(rows):
                part = b.take(pa.array(rows))
                if keep:
                    yield part.select(list(_COLUMNS))
                else:
                    waiting.append(part)
    yield from _settle(waiting)


def _settle(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a task's anchors: which stretches are repeated, and which different ones of a
    gram are still to be compared. All anchors of a gram are here, or of a hot one
    all with a stretch."""
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    hot, lo, n, at, copies = (t[c].to_numpy() for c in ("hot", "lo", "n", "at", "copies"))
    gram, stretch = (t[c].to_numpy().view(_U) for c in ("gram", "stretch"))
    doc = t["doc"].combine_chunks()
    order, starts, many = _same(gram, stretch, n)
    again = order[np.repeat(np.add.reduceat(copies[order], starts) > 1, many)]
    first = order[starts]
    g = gram[first]
    begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    size = np.diff(np.append(begin, len(g)))
    ask = first[(np.repeat(size, size) > 1) | hot[first]]
    for rows, k in ((again, np.full(len(again), REPEATED)), (ask, np.where(hot[ask], HOT, COMPARE))):
        if len(rows):
            yield _batch(k, gram[rows], stretch[rows], doc.take(pa.array(rows)), lo[rows], n[rows], at[rows], copies[rows])


_CONTEXT_ROW = f"kind int, gram long, doc {ROW_KEY}, lo long, n int, at int, other long, before binary, after binary"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the gram of each stretch to compare; of a hot gram, two hashes
    of each of its strings (gram and other)."""
    codec = pa.Codec("zstd")
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    names = ["kind", "gram", "lo", "n", "at", "other", "before", "after"]
    for b in batches:
        rows, of = [], []

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            arrays.insert(2, b["doc"].take(pa.array(of)))
            return pa.RecordBatch.from_arrays(arrays, [*names[:2], "doc", *names[2:]])

        for i, (size, packed, asked) in enumerate(zip(*(b[c].to_pylist() for c in ("n_bytes", "packed", "asked")))):
            text = codec.decompress(packed, size, asbytes=True) if size else b""
            for r in asked:
                lo, n, at = r["lo"], r["n"], r["at"]
                end = lo + n - 1 + MIN_LENGTH
                if r["kind"] == COMPARE:
                    rows.append((COMPARE, r["gram"], lo, n, at, 0, text[lo : lo + at], text[lo + at + GRAM : end]))
                else:
                    part = np.frombuffer(text, dtype=np.uint8)[lo:end]
                    one, two = (Roll(part, bases).all(MIN_LENGTH).view(np.int64).tolist() for bases in (GRAM_BASES, STRETCH_BASES))
                    rows += [(HOT, x, lo + k, 1, 0, y, None, None) for k, (x, y) in enumerate(zip(one, two))]
            of += [i] * (len(rows) - len(of))
            if len(rows) >= 20_000:
                yield flush()
                rows, of = [], []
        if rows:
            yield flush()


def _matrix(parts: list[bytes], width: int, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts])
    joined = b"".join((p[::-1] if backward else p).ljust(width, b"\0") for p in parts)
    return np.frombuffer(joined, dtype=np.uint8).reshape(len(parts), width), sizes


def expand_intervals(gram: list[int], before: list[bytes], after: list[bytes]) -> np.ndarray:
    """Matrix [row, d]: whether the string of MIN_LENGTH bytes that starts d bytes
    before the row's gram also occurs at another row of the same gram."""
    most = MIN_LENGTH - GRAM
    n = len(gram)
    found = np.zeros((n, most + 1), dtype=bool)
    rows = np.array(sorted(range(n), key=list(zip(gram, after)).__getitem__), dtype=np.int64)
    right, right_size = _matrix([after[i] for i in rows], most)
    left, left_size = _matrix(before, most, backward=True)
    own = np.array(gram, dtype=np.int64)[rows]
    # common prefix with the suffix before it in the interval; -1 at the interval's start
    unlike = right[1:] != right[:-1]
    prefix = np.full(n, -1, dtype=np.int64)
    prefix[1:] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), most)
    prefix[1:] = np.minimum(prefix[1:], np.minimum(right_size[1:], right_size[:-1]))
    prefix[np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))] = -1
    interval = np.cumsum(prefix < 0)
    for d in range(most + 1):
        best = np.maximum(prefix, np.append(prefix[1:], -1))
        found[rows[best >= most - d], d] = True
        if d == most:
            break
        # bounded: what can still reach the threshold, and has a byte to extend by
        going = np.flatnonzero((left_size[rows] > d) & (best >= most - left_size[rows]))
        if len(going) < 2:
            break
        byte = left[rows[going], d]
        going = going[np.lexsort((byte, interval[going]))]  # stable: the order within an interval stays
        p, q = going[:-1], going[1:]
        joined = (interval[p] == interval[q]) & (left[rows[p], d] == left[rows[q], d])
        new = np.full(len(going), -1, dtype=np.int64)
        at = np.flatnonzero(joined)
        if not len(at):
            break
        spans = np.stack([p[at] + 1, q[at] + 1], axis=1).reshape(-1)
        new[at + 1] = np.minimum.reduceat(np.append(prefix, -1), spans)[::2]
        alone = (new < 0) & (np.append(new[1:], -1) < 0)
        going, new = going[~alone], new[~alone]
        rows, prefix = rows[going], new
        interval = np.cumsum(prefix < 0)
    return found


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated (doc, lo, n) among the stretches of a task's grams."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.Table.from_batches(tables).sort_by("gram")
    gram = t["gram"].to_numpy()
    begins = np.append(np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])), len(gram))
    at = 0
    while at < len(begins) - 1:
        to = max(at + 1, int(np.searchsorted(begins, begins[at] + ROWS_TOGETHER, side="right")) - 1)
        part = t.slice(begins[at], begins[to] - begins[at])
        found = expand_intervals(part["gram"].to_pylist(), part["before"].to_pylist(), part["after"].to_pylist())
        step = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(step == 1)
        _, high = np.nonzero(step == -1)  # d in [low, high)
        if len(row):
            base = part["lo"].to_numpy()[row] + part["at"].to_numpy()[row]
            yield pa.RecordBatch.from_arrays([part["doc"].combine_chunks().take(pa.array(row)), pa.array(base - high + 1), pa.array(high - low)], ["doc", "lo", "n"])
        at = to


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", compression_level=3)
    for b in batches:
        texts = [t or b"" for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["doc"], b["doc_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array([codec.compress(t, asbytes=True) if t else b"" for t in texts], pa.binary())], ["doc", "doc_id", "n_bytes", "packed"])


def _removed(spans: list[dict]) -> list[list[int]]:
    """Maximal runs [from, to) of the bytes under strings that start at lo .. lo + n - 1."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["lo"] + s["n"] - 1 + MIN_LENGTH) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for b in batches:
        rows = []
        for doc_id, size, packed, spans in zip(*(b[c].to_pylist() for c in ("doc_id", "n_bytes", "packed", "spans"))):
            text = codec.decompress(packed, size, asbytes=True) if size else b""
            runs = _removed(spans or [])
            digest, at = hashlib.sha256(), 0
            for lo, hi in runs:
                digest.update(text[at:lo])
                at = hi
            digest.update(text[at:])
            rows.append((doc_id, size, sum(hi - lo for lo, hi in runs), len(runs), digest.hexdigest(), [{"start": lo, "end": hi} for lo, hi in runs]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def repeated_strings(docs: DataFrame, hot_gram: int = HOT_GRAM) -> DataFrame:
    """(doc, lo, n): starts lo .. lo + n - 1 of repeated strings; doc is the row key."""
    spark = docs.sparkSession
    keyed = with_row_key(docs.select("doc_id", "text"), "doc").select("doc", F.col("text").cast("binary"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known_size = size < UNKNOWN_SIZE
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BYTES_PER_TASK if known_size else 1)
    # an eighth of what would make a gram hot, for each bucket on average
    bits = min(62, max(LEAST_BUCKET_BITS, (8 * size // GRAM // hot_gram).bit_length())) if known_size else UNKNOWN_BUCKET_BITS
    hot = hot_grams(keyed, hot_gram, bits)
    rows = keyed.mapInArrow(_scan, _ANCHOR_ROW)
    if hot is None:
        rows = rows.withColumn("hot", F.lit(False))
    else:
        rows = rows.join(sized(hot.withColumn("is_hot", F.lit(True))), "gram", "left").withColumn("hot", F.coalesce("is_hot", F.lit(False)))
    route = F.when(F.col("kind") == REPEATED, F.col("doc.a")).when(F.col("hot"), F.xxhash64("gram", "stretch")).otherwise(F.col("gram"))
    settled = materialize(rows.select("*", route.alias("route")).repartition(parts, "route").mapInArrow(_settled, _ANCHOR_ROW).select("kind", "gram", "doc", "lo", "n", "at"), "anchors")
    known = settled.where(f"kind = {REPEATED}").select("doc", "lo", F.col("n").cast("long").alias("n"))
    asked = settled.where(f"kind <> {REPEATED}").groupBy("doc").agg(F.collect_list(F.struct("kind", "gram", "lo", "n", "at")).alias("asked"))
    around = asked.join(_texts(docs), "doc").select("doc", "n_bytes", "packed", "asked").mapInArrow(_fetch, _CONTEXT_ROW)
    compared = around.where(f"kind = {COMPARE}").select("gram", "doc", "lo", "at", "before", "after").repartition(parts, "gram").mapInArrow(_expand, f"doc {ROW_KEY}, lo long, n long")
    out = known.unionByName(compared)
    if not settled.where(f"kind = {HOT}").isEmpty():
        strings = materialize(around.where(f"kind = {HOT}").select("gram", "other", "doc", "lo"), "hot_strings")
        twice = strings.groupBy("gram", "other").agg(F.count("*").alias("many")).where("many > 1").select("gram", "other")
        out = out.unionByName(strings.join(twice, ["gram", "other"]).select("doc", "lo", F.lit(1).cast("long").alias("n")))
    return out


def _texts(docs: DataFrame) -> DataFrame:
    keyed = with_row_key(docs.select("doc_id", "text"), "doc")
    return keyed.select("doc", F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(_pack, f"doc {ROW_KEY}, doc_id long, n_bytes long, packed binary")


def remove_repeats(docs: DataFrame, hot_gram: int = HOT_GRAM) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed,
    n_spans, kept_sha256, removed (array of byte ranges)."""
    spans = repeated_strings(docs, hot_gram).groupBy("doc").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    joined = _texts(docs).join(spans, "doc", "left").select("doc_id", "n_bytes", "packed", "spans")
    return joined.mapInArrow(_rest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:bigint,end:bigint>>")
