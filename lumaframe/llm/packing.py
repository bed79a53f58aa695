"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Large-item matching: pieces above a third of the capacity fit at most twice in a
sequence; from the largest down each is matched greedily with the largest that still
fits beside it (neighbourhoods are nested, so this finds a maximum number of pairs).
The smaller pieces then go, longest first, each to the tightest gap that holds it;
a new sequence is opened only where no gap does.

Scale: only lengths matter to the plan, and there are at most ``capacity`` of them. One
pass tokenises and writes a short row per piece (no text moves). The driver gets the
histogram of lengths (at most ``capacity`` rows, whatever the input) and works out the
plan on counts: sequences filled alike are one run, so the plan has a few thousand
runs, not a line per sequence. Pieces then get their rank among those of their length
(a hot length is dealt over salts, each with a prefix sum), and a run maps ranks to
sequence and offset by arithmetic. Nothing is sampled or capped.

Defined results: a null text counts as empty and is one end token; null doc_id is
an id like any other; repeated rows are packed each; ties in length go by doc_id,
piece; an empty table gives an empty result; extra columns are ignored. Only a
document longer than the capacity is cut; its first piece takes the remainder.
"""

from __future__ import annotations

import base64
import bisect
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CAPACITY = 2048
END_ID = 0
#: Pieces of one length ranked by one task, at least; grows with the corpus.
RANK_BLOCK = 1000
#: Longer texts go to the tokenizer whose merges take n log n time.
LONG_TEXT = 1_000_000
SPECIAL = "<|endoftext|>"  # fixed value: the vocabulary's one special token
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@functools.lru_cache(maxsize=2)
def _tokenizers(json_path: str, ranks_path: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Tokenizer.from_file(json_path), tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, json_path: str, ranks_path: str) -> np.ndarray:
    """Ids of the tokenizer at ``json_path``; the same vocabulary as ranks gives
    equal ids faster for texts without special tokens."""
    whole, fast = _tokenizers(json_path, ranks_path)
    if len(text) > LONG_TEXT or SPECIAL in text:
        return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
    return np.array(fast.encode_ordinary(text), dtype="<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    first = n if n <= capacity else n % capacity
    out = [(0, first)] if first else []
    return out + [(at, capacity) for at in range(first, n, capacity)]


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        json_path, ranks_path = paths or tokenizer_paths()
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                ids = np.append(token_ids(text or "", json_path, ranks_path), np.uint32(END_ID)).astype("<u4")
                rows += [(doc_id, i, at, n, zlib.crc32(ids[at : at + n])) for i, (at, n) in enumerate(cut(len(ids), capacity))]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces per sequence, first sequence, offset) that
    place ``counts`` pieces of each length, and the number of sequences.

    The piece of rank r in a run is at sequence ``first + (r - rank) // per`` and
    offset ``offset + (r - rank) % per * length``.
    """
    left = {n: c for n, c in counts.items() if c}
    runs: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, sequences)
    order: list[int] = []  # the gaps that are open, ascending
    total = 0

    def place(n: int, per: int, first: int, sequences: int, offset: int, pieces: int) -> None:
        runs.append((n, used[n], per, first, offset))
        used[n] += pieces
        left[n] -= pieces

    def opened(gap: int, first: int, sequences: int) -> None:
        if sequences and gap:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, sequences))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        x = large[-1]
        at = bisect.bisect_right(large, capacity - x) - 1
        if at >= 0 and large[at] == x and left[x] < 2:
            at -= 1
        if at < 0:
            many = left[x]
            place(x, 1, total, many, 0, many)
            opened(capacity - x, total, many)
        else:
            y = large[at]
            many = left[x] // 2 if x == y else min(left[x], left[y])
            place(x, 1, total, many, 0, many)
            place(y, 1, total, many, x, many)
            opened(capacity - x - y, total, many)
        total += many
        large = [n for n in large if left[n]]

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(order, n)
            if at == len(order):  # no gap holds it
                per = capacity // n
                opened(capacity, total, -(-left[n] // per))
                total += -(-left[n] // per)
                continue
            gap = order[at]
            first, sequences = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            per = gap // n
            full = min(sequences, left[n] // per)
            if full:
                place(n, per, first, full, capacity - gap, full * per)
                opened(gap - per * n, first, full)
                opened(gap, first + full, sequences - full)
            else:  # the last few pieces of this length
                some = left[n]
                place(n, some, first, 1, capacity - gap, some)
                opened(gap - some * n, first, 1)
                opened(gap, first + 1, sequences - 1)
    return runs, total


def pack_pieces(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to the rows of ``pieces``."""
    spark = cut_pieces.sparkSession
    table = materialize(cut_pieces, "pieces")
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    runs, _ = plan(counts, capacity)
    runs.sort()
    run_at = spark.sparkContext.broadcast(np.array(runs, dtype=np.int64).reshape(-1, 5))  # bounded by the plan

    block = max(RANK_BLOCK, sum(counts.values()) // 10_000)
    salts = max(1, -(-max(counts.values(), default=0) // block))
    salted = table.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    per_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = per_salt.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("rank"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first_rank, per, first, offset = run_at.value.T
        keys = (n << 44) | first_rank
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            r = np.searchsorted(keys, (length << 44) | rank, side="right") - 1
            own = rank - first_rank[r]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(first[r] + own // per[r]), pa.array(offset[r] + own % per[r] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(assign, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text): one row per piece."""
    return pack_pieces(pieces(docs, capacity, paths), capacity)
