"""Language-model scores by deleted interpolation.

Tokens: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, then one end token. Documents whose
crc32 (of doc_id as text) modulo 7 is 2 are held out of training.

The model mixes maximum-likelihood estimates of three orders, from exact counts of all
n-grams of the training documents, each order resting on the one below:

    P1(w)       = l1 c(w) / N                + (1 - l1) / (V + 1)
    P2(w | v)   = l2[c(v)] c(v w) / c(v)     + (1 - l2[c(v)]) P1(w)
    P3(w | u v) = l3[c(u v)] c(u v w) / c(u v) + (1 - l3[c(u v)]) P2(w | v)

The last share of P1 is for each of V known tokens and one for all others, so that each P
sums to one. Weights go by the frequency of the context, one for each power of two, and
are zero for a context never seen. A document starts after an end token, and that after
a start of its own.

Weights are learned by expectation-maximisation on counts kept back from the
estimates: those of training documents with remainder 6. EM sees how often each pair of
context frequencies and of ratios of the estimates to P1 occurs, at two steps to an
octave with the mean within the step; the grid bounds what the driver gets, not the
input. The scores' estimates are then taken from all training documents.

Scale: the documents are dealt into chunks of about ``CHUNK_BYTES``, each of one kind
(main, kept back, held out), and written, compressed. A chunk sends each of its
different n-grams once, with its count, to the task that counts it, packed by ``2^bits``
buckets of hashes; what comes back are the totals of those n-grams that other chunks
have too. So a frequent n-gram costs one entry a chunk, texts are shuffled once (those
kept back twice), and nothing but sums of EM reaches the driver. What travels is sorted
hashes, as compressed differences: of tokens 48 bits and those of the bucket, 59 or more;
of pairs and triples 36 and those of the bucket, so that of 10 GB's pairs and triples
one in about 40,000 counts together with another.

Defined results: null text is one end token; a null doc_id counts as empty text in
the crc; repeated rows are scored and counted each; with no training documents
every token is unseen and scores zero; a very long text is a chunk of its own; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import count_groups, materialize
from .substring_dedup import Roll

FOLDS, HELD_OUT, KEPT_BACK = 7, 2, 6
#: Kinds of documents, and so of chunks.
MAIN, BACK, HELD = range(3)
#: No word has a space in it.
END = b" "
END_HASH = 0x2545F4914F6CDD1D
#: Text hashed at a time, few enough for a processor's cache; words over LONG_WORD bytes are
#: hashed one by one.
BLOCK, LONG_WORD = 1 << 16, 1024
#: Text of a chunk; chunks for each task that scores them.
CHUNK_BYTES, CHUNKS_PER_TASK = 5 << 20, 4
#: Text whose n-grams share a bucket or a counting task; bits of a bucket's number.
BUCKET_BYTES, TASK_BYTES = 16 << 20, 24 << 20
LEAST_BITS, MOST_BITS = 11, 20
#: Bits of a hash below its bucket, of tokens and of longer n-grams; the bytes that hold
#: them; and how many of those, the lowest, are too random to compress.
PAYLOADS = ((48, 6, 5), (36, 5, 3))
_SEED = 9
#: Steps to an octave of the ratio of two estimates, and octaves on each side of one.
STEPS, OCTAVES = 2, 64
#: EM ends when no weight moves by more than this, or after so many rounds.
STILL, EM_ROUNDS = 1e-6, 500
#: Cells of the table of totals, beside the steps of counts.
_TYPES, _TOKENS, _TOKENS_BACK = -1, -2, -3

_U = np.uint64
_CHUNK = "chunk long, kind int, bucket long, ids binary, sizes binary, packed binary"
_ASK = "chunk long, kind int, bucket long, many1 int, size1 int, data1 binary, many2 int, size2 int, data2 binary"
_REPLY = "cell long, n long, x double, chunk long, kind int, bucket long, size1 int, data1 binary, size2 int, data2 binary"
_SPACES = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def tokens(text: bytes | None) -> list[bytes]:
    out = (text or b"").lower().split()
    out.append(END)
    return out


def kind_of(doc_id: int | None) -> int:
    fold = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS
    return HELD if fold == HELD_OUT else BACK if fold == KEPT_BACK else MAIN


def _rows(columns: dict[str, str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    cols = list(zip(*rows)) or [[]] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(cols, columns.values())], list(columns))


def _columns(schema: str) -> dict[str, str]:
    return dict(x.split() for x in schema.split(", "))


# ---- chunks -----------------------------------------------------------------------------


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents of one kind: ids, with which are there; sizes; and texts, each
    with a line end."""
    codec = pa.Codec("zstd", compression_level=6)
    number = TaskContext.get().partitionId() << 24
    open_: list[tuple[list, list[bytes]]] = [([], []) for _ in range(3)]
    size = [0] * 3

    def close(kind: int) -> pa.RecordBatch:
        nonlocal number
        ids, texts = open_[kind]
        packed = codec.compress(b"".join(t + b"\n" for t in texts), asbytes=True)
        has = np.array([i is not None for i in ids])
        row = (number, kind, -1, np.array([i or 0 for i in ids], np.int64).tobytes() + has.tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), packed)
        number, open_[kind], size[kind] = number + 1, ([], []), 0
        return _rows(_columns(_CHUNK), [row])

    for b in batches:
        for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
            kind = kind_of(doc_id)
            if size[kind] and size[kind] + len(text or b"") > CHUNK_BYTES:
                yield close(kind)
            open_[kind][0].append(doc_id)
            open_[kind][1].append(text or b"")
            size[kind] += len(text or b"") + 16
    for kind in range(3):
        if open_[kind][0]:
            yield close(kind)


def token_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a text without capitals. Blocks end between
    words, and a word's hash does not depend on where it stands."""
    hashes, places, at = [], [], 0
    while at < len(text):
        data = np.frombuffer(text, np.uint8, min(BLOCK, len(text) - at), at)
        space = _SPACES[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = (edge[k:][::2] for k in ((0, 1) if space[0] else (1, 0)))
        if not space[0]:
            starts = np.concatenate([[0], starts])
        done = len(data)
        if not space[-1] and at + done < len(text) and not _SPACES[text[at + done]]:
            starts, done = starts[:-1], int(starts[-1])  # the last word goes on
        ends = ends[: len(starts)] if len(ends) >= len(starts) else np.append(ends, done)
        if not done:  # a word longer than a block
            done = next((k for k in range(at, len(text)) if _SPACES[text[k]]), len(text)) - at
            hashes.append(np.array([xxhash.xxh64_intdigest(text[at : at + done], _SEED)], dtype=_U))
            places.append(np.array([at]))
        elif len(starts):
            h = Roll(data[:done])(starts, ends)
            for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
                h[k] = xxhash.xxh64_intdigest(text[at + int(starts[k]) : at + int(ends[k])], _SEED)
            hashes.append(h)
            places.append(starts + at)
        at += done
    if not hashes:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


class Chunk:
    """The n-grams of a chunk's documents."""

    def __init__(self, ids: bytes, sizes: bytes, packed: bytes, bits: int) -> None:
        length = np.frombuffer(sizes, np.int64)
        n = len(length)
        self.ids, self.has_id = np.frombuffer(ids[: 8 * n], np.int64), np.frombuffer(ids[8 * n :], bool)
        text = pa.Codec("zstd").decompress(packed, int((length + 1).sum()), asbytes=True).lower() if packed else b""
        hashes, places = token_hashes(text)
        words = np.bincount(np.searchsorted(np.cumsum(length + 1), places, side="right"), minlength=n)
        ends = np.cumsum(words + 1)
        self.w = np.full(int(ends[-1]), END_HASH, dtype=_U)
        own = np.ones(len(self.w), bool)
        own[ends - 1] = False
        self.w[own] = hashes
        self.starts, self.many, self.bits = np.concatenate([[0], ends[:-1]]), words + 1, bits

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every token, itself; and its pair, then its triple."""
        first = self.starts
        v = np.concatenate([[0], self.w[:-1]]).astype(_U)
        v[first] = _U(END_HASH)
        pair = _mixed(v, self.w)
        before = np.concatenate([[0], pair[:-1]]).astype(_U)
        before[first] = _U(0)  # the start of its own
        triple = _mixed(before ^ _U(0x5851F42D4C957F2D), self.w)
        lists = (self.w, np.concatenate([pair, triple]))
        return tuple(x >> _U(64 - payload - self.bits) for x, (payload, *_) in zip(lists, PAYLOADS))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> _U(31))) * _U(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts, and its length."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(sorted_)))


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of numbers, byte by byte, as like compresses with like."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _of_planes(data: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = data[: n * width].reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _zipped(data: bytes, plain: int) -> tuple[int, bytes]:
    """The size of ``data``, and itself with all after the first ``plain`` bytes compressed."""
    return len(data), data[:plain] + (pa.Codec("zstd", compression_level=1).compress(data[plain:], asbytes=True) if len(data) > plain else b"")


def _unzipped(size: int, data: bytes, plain: int) -> np.ndarray:
    rest = pa.Codec("zstd").decompress(data[plain:], size - plain, asbytes=True) if size > plain else b""
    return np.frombuffer(data[:plain] + rest, np.uint8)


def _ask(bits: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The different n-grams of each chunk, by bucket, with how often they are there."""
        for b in batches:
            for chunk, kind, ids, sizes, packed in zip(*(b[c].to_pylist() for c in ("chunk", "kind", "ids", "sizes", "packed"))):
                parts: list[dict[int, tuple]] = []
                for gram, (payload, width, plain) in zip(Chunk(ids, sizes, packed, bits).grams(), PAYLOADS):
                    gram = np.sort(gram)
                    at, n = _runs(gram)
                    gram = gram[at]
                    first, size = _runs(gram >> _U(payload))
                    gaps = np.diff(gram, prepend=_U(0))
                    gaps[first] = gram[first] & _U((1 << payload) - 1)
                    small = np.minimum(n, 255).astype(np.uint8)
                    own = {}
                    for k, a, z in zip((gram[first] >> _U(payload)).tolist(), first.tolist(), (first + size).tolist()):
                        counts = b"" if kind == HELD else small[a:z].tobytes() + n[a:z][small[a:z] == 255].astype("<i8").tobytes()
                        own[k] = (z - a, *_zipped(_planes(gaps[a:z], width) + counts, plain * (z - a)))
                    parts.append(own)
                none = (0, 0, b"")
                yield _rows(_columns(_ASK), [(chunk, kind, k, *parts[0].get(k, none), *parts[1].get(k, none)) for k in sorted({*parts[0], *parts[1]})])

    return ask


# ---- counting ---------------------------------------------------------------------------


def _grouped(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """The rows of each value of ``by``, in which the batches are sorted."""
    held: list[pa.RecordBatch] = []
    value = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b[by].to_numpy()
        starts, sizes = _runs(keys)
        for a, n in zip(starts.tolist(), sizes.tolist()):
            if held and keys[a] != value:
                yield pa.Table.from_batches(held)
                held = []
            value = keys[a]
            held.append(b.slice(a, n))
    if held:
        yield pa.Table.from_batches(held)


class _Totals:
    """Totals of the n-grams of a list, over all chunks that ask for a bucket."""

    def __init__(self, kinds: list[int], many: list[int], sizes: list[int], data: list[bytes], width: int, plain: int) -> None:
        self.size = np.array(many)
        grams, ns = [], []
        for kind, m, size, packed in zip(kinds, many, sizes, data):
            raw = _unzipped(size, packed, plain * m)
            grams.append(np.cumsum(_of_planes(raw, m, width)))
            n = np.zeros(m, np.int64)
            if kind != HELD:
                n[:] = raw[m * width : m * (width + 1)]
                n[n == 255] = np.frombuffer(raw[m * (width + 1) :].tobytes(), "<i8")
            ns.append(n)
        gram, n = np.concatenate(grams), np.concatenate(ns)
        self.row = np.repeat(np.arange(len(many)), self.size)
        kind = np.array(kinds)[self.row]
        self.order = np.argsort(gram)
        self.first, self.many = _runs(gram[self.order])
        totals = (np.where(kind == k, n, 0)[self.order] for k in (MAIN, BACK))
        self.main, self.back = (np.add.reduceat(x, self.first) if len(self.first) else self.many for x in totals)

    def replies(self) -> dict[int, tuple[int, bytes]]:
        """For each row, which of its n-grams other rows have too, and their totals."""
        entry = self.order[np.repeat(self.many > 1, self.many)]
        of = np.repeat(np.arange(len(self.first)), self.many)[np.repeat(self.many > 1, self.many)]
        by_row = np.argsort(entry)
        entry, of = entry[by_row], of[by_row]
        start = np.cumsum(self.size) - self.size
        begin, length = _runs(self.row[entry])
        out = {}
        for a, k in zip(begin.tolist(), length.tolist()):
            r = int(self.row[entry[a]])
            shared = np.zeros(int(self.size[r]), bool)
            shared[entry[a : a + k] - start[r]] = True
            main, back = self.main[of[a : a + k]], self.back[of[a : a + k]]
            width = max(1, -(-int(max(main.max(), back.max())).bit_length() // 8))
            bits = np.packbits(shared).tobytes()
            out[r] = _zipped(bits + bytes([width]) + _planes(main, width) + _planes(back, width), len(bits))
        return out


def count_bucket(t: pa.Table) -> tuple[list[tuple], dict[int, list[float]]]:
    """Replies to the chunks that ask for a bucket's n-grams, and sums over its tokens."""
    kinds, chunks, bucket = (t[c].to_pylist() for c in ("kind", "chunk", "bucket"))
    one, more = (_Totals(kinds, *(t[f"{c}{k}"].to_pylist() for c in ("many", "size", "data")), *widths) for k, (_, *widths) in enumerate(PAYLOADS, 1))
    m, b = one.main, one.back
    sums = {_TYPES: [int((m + b > 0).sum()), 0.0], _TOKENS: [int((m + b).sum()), 0.0], _TOKENS_BACK: [int(b.sum()), 0.0]}
    cell, log = ratio_cells(m[b > 0].astype(float))
    for c, k, x in zip(cell.tolist(), b[b > 0].tolist(), log.tolist()):
        own = sums.setdefault(c, [0, 0.0])
        own[0] += k
        own[1] += k * x
    first, second = one.replies(), more.replies()
    none = (0, b"")
    return [(None, None, None, chunks[r], kinds[r], bucket[r], *first.get(r, none), *second.get(r, none)) for r in sorted({*first, *second})], sums


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list[float]] = {}
    rows: list[tuple] = []
    for t in _grouped(batches, "bucket"):
        more, own = count_bucket(t)
        rows += more
        for c, (n, x) in own.items():
            total = sums.setdefault(c, [0, 0.0])
            total[0] += n
            total[1] += x
        if len(rows) > 2000:
            yield _rows(_columns(_REPLY), rows)
            rows = []
    rows += [(c, n, x, *[None] * 7) for c, (n, x) in sums.items()]
    yield _rows(_columns(_REPLY), rows)


# ---- the model --------------------------------------------------------------------------


def buckets(counts: np.ndarray) -> np.ndarray:
    """Power of two of each context's frequency; 0 for one never seen."""
    return np.frexp(np.maximum(counts, 0).astype(float))[1].astype(np.int64)


def ratio_cells(ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The step of each ratio, 0 for zero, and its log2."""
    log = np.log2(np.maximum(ratio, 2.0**-OCTAVES))
    step = np.clip(np.floor((log + OCTAVES) * STEPS).astype(np.int64), 0, 2 * OCTAVES * STEPS - 1)
    return np.where(ratio > 0, step + 1, 0), np.where(ratio > 0, log, 0.0)


def token_weight(n: np.ndarray, ratio: np.ndarray) -> float:
    """EM: l1, from the counts kept back (n) of tokens whose estimate is ``ratio`` times
    that of all alike."""
    lam = 0.5
    for _ in range(EM_ROUNDS if n.sum() else 0):
        last, lam = lam, float((n * lam * ratio / (lam * ratio + 1 - lam)).sum() + 1) / (n.sum() + 2)
        if abs(lam - last) < STILL:
            break
    return lam


def context_weights(b2: np.ndarray, b3: np.ndarray, n: np.ndarray, r2: np.ndarray, r3: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM: l2 and l3 by the bucket of their context's frequency, from how many (n)
    counts kept back have which buckets and which ratios of the estimates to P1."""
    l2, l3 = np.full(64, 0.5), np.full(64, 0.5)
    l2[0] = l3[0] = 0
    for _ in range(EM_ROUNDS if len(n) else 0):
        two, three = l2[b2] * r2, l3[b3] * r3
        rest = 1 - l3[b3]
        total = three + rest * (two + 1 - l2[b2])
        g3, g2, g1 = n * three / total, n * rest * two / total, n * rest * (1 - l2[b2]) / total
        new2 = (np.bincount(b2, g2, 64) + 1) / (np.bincount(b2, g2 + g1, 64) + 2)
        new3 = (np.bincount(b3, g3, 64) + 1) / (np.bincount(b3, n, 64) + 2)
        new2[0] = new3[0] = 0
        moved = max(np.abs(new2 - l2).max(), np.abs(new3 - l3).max())
        l2, l3 = new2, new3
        if moved < STILL:
            break
    return l2, l3


class Counts:
    """Counts of a chunk's tokens, their n-grams and contexts: ``main`` without those kept
    back and ``all``, each of tokens, then of pairs, then of triples."""

    def __init__(self, chunk: Chunk, kind: int, replies: pa.Table) -> None:
        n_tokens = len(chunk.w)
        mains, alls = [], []
        for k, (gram, (payload, *_)) in enumerate(zip(chunk.grams(), PAYLOADS), 1):
            own, at, n = np.unique(gram, return_inverse=True, return_counts=True)
            main, both = (n if kind == MAIN else np.zeros_like(n)).copy(), np.zeros_like(n) if kind == HELD else n.copy()
            first, many = _runs(own >> _U(payload))
            places = dict(zip((own[first] >> _U(payload)).tolist(), zip(first.tolist(), many.tolist())))
            for bucket, size, data in zip(*(replies[c].to_pylist() for c in ("bucket", f"size{k}", f"data{k}"))):
                if size:
                    start, m = places[bucket]
                    ends = -(-m // 8)
                    raw = _unzipped(size, data, ends)
                    place, width = start + np.flatnonzero(np.unpackbits(raw[:ends], count=m)), int(raw[ends])
                    main[place] = _of_planes(raw[ends + 1 :], len(place), width).astype(np.int64)
                    both[place] = main[place] + _of_planes(raw[ends + 1 + len(place) * width :], len(place), width).astype(np.int64)
            mains.append(main[at]), alls.append(both[at])
        self.main, self.all = ((x[0], x[1][:n_tokens], x[1][n_tokens:]) for x in (mains, alls))
        self.starts, self.end = chunk.starts, int(chunk.starts[0] + chunk.many[0] - 1)

    def of(self, table: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """c(w), c(v), c(v w), c(u v), c(u v w) of every token."""
        one, two, three = table
        v, uv = np.concatenate([[0], one[:-1]]), np.concatenate([[0], two[:-1]])
        v[self.starts] = uv[self.starts] = one[self.end]
        return one, v, two, uv, three


def estimates(counts: tuple[np.ndarray, ...], tokens_: int, types: int, l1: float) -> tuple[np.ndarray, ...]:
    """P1, and the maximum-likelihood estimates of orders two and three."""
    one, v, two, uv, three = counts
    p1 = (l1 * one / tokens_ if tokens_ else 0) + (1 - l1 if tokens_ else 1) / (types + 1)
    return p1, two / np.maximum(v, 1), three / np.maximum(uv, 1)


def _chunks_with_replies(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[int, Chunk, Counts]]:
    for t in _grouped(batches, "chunk"):
        own = t["bucket"].to_numpy() < 0
        row = t.filter(pa.array(own)).to_pylist()[0]
        chunk = Chunk(row["ids"], row["sizes"], row["packed"], bits)
        yield row["kind"], chunk, Counts(chunk, row["kind"], t.filter(pa.array(~own)))


def score(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    chunks = materialize(texts.mapInArrow(_deal, _CHUNK), "chunks")
    n_chunks, n_docs, n_bytes = chunks.select(F.length("sizes"), F.length("packed")).toDF("s", "p").agg(F.count("*"), F.coalesce(F.sum("s"), F.lit(0)) / 8, F.coalesce(F.sum("p"), F.lit(0)) * 3).first()
    n_bytes = int(n_bytes + 16 * n_docs)  # texts compress to about a third
    bits = min(MOST_BITS, max(LEAST_BITS, (n_bytes // BUCKET_BYTES).bit_length()))

    asked = chunks.mapInArrow(_ask(bits), _ASK).repartition(count_groups(n_bytes, TASK_BYTES, least), "bucket").sortWithinPartitions("bucket")
    replies = materialize(asked.mapInArrow(_count, _REPLY), "replies")
    table = {r["cell"]: (r["n"], r["x"]) for r in replies.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()}  # a row for each step
    types, every, back = (int(table.pop(c, (0, 0.0))[0]) for c in (_TYPES, _TOKENS, _TOKENS_BACK))
    main = every - back
    n, x = (np.array([v[k] for v in table.values()], float) for k in (0, 1))
    some = np.array(list(table)) > 0 if table else np.zeros(0, bool)
    l1 = token_weight(n, np.where(some, 2.0 ** (x / np.maximum(n, 1)), 0) * (types + 1) / max(main, 1))

    parts = count_groups(n_chunks, CHUNKS_PER_TASK, least)

    def met(which: str) -> DataFrame:
        answer = replies.where("cell is null").drop("cell", "n", "x")
        own = chunks.select("chunk", "kind", "bucket", "ids", "sizes", "packed")
        return own.where(which).unionByName(answer.where(which), allowMissingColumns=True).repartition(parts, "chunk").sortWithinPartitions("chunk")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, counts in _chunks_with_replies(batches, bits):
            of = counts.of(counts.main)
            p1, two, three = estimates(of, main, types, l1)
            q2, log2 = ratio_cells(two / p1)
            q3, log3 = ratio_cells(three / p1)
            wide = 2 * OCTAVES * STEPS + 1
            cell, at = np.unique(((buckets(of[3]) * 64 + buckets(of[1])) * wide + q2) * wide + q3, return_inverse=True)
            sums = [np.bincount(at, y, len(cell)) for y in (np.ones(len(at)), log2, log3)]
            yield pa.RecordBatch.from_arrays([pa.array(cell), *map(pa.array, sums)], ["cell", "n", "x2", "x3"])

    cells = met(f"kind = {BACK}").mapInArrow(learn, "cell long, n double, x2 double, x3 double").groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "x2", "x3"))).toArrow()
    cell, n, x2, x3 = (cells[c].to_numpy() for c in ("cell", "n", "x2", "x3"))
    wide = 2 * OCTAVES * STEPS + 1
    both, q2, q3 = cell // wide**2, cell // wide % wide, cell % wide
    l2, l3 = context_weights(both % 64, both // 64, n, np.where(q2 > 0, 2.0 ** (x2 / np.maximum(n, 1)), 0), np.where(q3 > 0, 2.0 ** (x3 / np.maximum(n, 1)), 0))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, chunk, counts in _chunks_with_replies(batches, bits):
            of = counts.of(counts.all)
            p1, two, three = estimates(of, every, types, l1)
            lam2, lam3 = l2[buckets(of[1])], l3[buckets(of[3])]
            p = lam3 * three + (1 - lam3) * (lam2 * two + (1 - lam2) * p1)
            base = np.log10((of[0] + 1) / (every + types + 1))
            known, base, log = (np.add.reduceat(y, chunk.starts) for y in ((of[0] > 0).astype(np.int64), base, np.log10(p)))
            arrays = [pa.array(chunk.ids, mask=~chunk.has_id), pa.array(np.full(len(known), kind == HELD)), pa.array(chunk.many), pa.array(known), pa.array(np.full(len(known), every, np.int64)), pa.array(base), pa.array(log)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return met("true").mapInArrow(weigh, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
