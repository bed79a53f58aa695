"""SimHash near-dedup with pigeonring filtering.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of four words
(all of a shorter text), repeats included, hashed by XXH64 (seed 42); a bit is one
if it is set in over half of the hashes. Fingerprints link at ``MAX_BITS`` (4)
differing bits or fewer; a document's class is its connected component.

Pigeonring: the 64 bits form a ring of m = 5 segments. If two fingerprints differ in
at most t bits, some segment i exists from which *every* chain of l consecutive
segments differs in at most floor(l * t / m) bits: 0, 1, 2, 3, 4. The first two
chains become the key of an equality search (segment i equal, segment i + 1 equal or
one bit off, so one side enumerates 1 + |segment i + 1| keys of about 26 bits), the
other chains prune candidates, segment by segment, before the full Hamming check.

Scale: equal fingerprints are one node, so copies are never paired. About 75 short
rows per distinct fingerprint are shuffled, whatever the size of its class. Within a
key only the links that join different parts are emitted (a spanning forest of the
links found), never all pairs. A key with more than ``HOT_KEY`` members is not
compared pairwise at all: its members are linked through midpoints, as two
fingerprints are within 4 bits exactly if some value is within 2 bits of both; that is
2,081 short rows for each such member, combined on the map side, and misses nothing.
Keys of 26 bits hold 75 rows in 2^28 on average: the pairs compared grow with the square
of the distinct fingerprints, and from about 14 billion of those on (some 70 TB of
documents) the mean key is hot, so that nearly all go by midpoints.
Components are found by shuffles; nothing of the documents reaches the driver.

Defined results: null and wordless texts have fingerprint zero and link like any
other; a null doc_id takes part but is never a component id unless its component
holds no other (then null); repeated rows are separate rows; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, by_merge, connected_components, count_groups, fresh, materialize, with_row_key

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: (first bit, bits) of the ring's segments.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Members of a key up to which they are compared within one task.
HOT_KEY = 4096
#: Rows of the key table for each task.
ROWS_PER_TASK = 1_000_000
_HASH_BLOCK = 1 << 18


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit SimHash of UTF-8 bytes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)  # of one hash, over half is that hash
    shifted = [words[i:] for i in range(SHINGLE)]
    hashes = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*shifted)), dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _HASH_BLOCK):  # a very long text needs no more memory
        block = hashes[at : at + _HASH_BLOCK]
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = np.array([fingerprint(t) for t in b["text"].to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["row_key"], pa.array(values)], ["doc_id", "row_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, fp (the 64 bits as a signed long) for each row of ``docs``."""
    keyed = with_row_key(docs.select("doc_id", "text"), "row_key")
    return keyed.select(F.col("doc_id").cast("long"), "row_key", F.col("text").cast("binary")).mapInArrow(_fingerprints, f"doc_id long, row_key {ROW_KEY}, fp long")


def _segment(fp: np.ndarray, i: int) -> np.ndarray:
    first, bits = SEGMENTS[i % len(SEGMENTS)]
    return (fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)


def ring_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp, probe): the exact key of each of the five chain starts, and the keys
    of all fingerprints one bit off in the chain's second segment (probe true)."""
    for b in batches:
        fp = b["fp"].to_numpy().view(np.uint64)
        if not len(fp):
            continue
        for i in range(len(SEGMENTS)):
            bits = SEGMENTS[(i + 1) % len(SEGMENTS)][1]
            exact = (np.uint64(i) << np.uint64(32)) | (_segment(fp, i) << np.uint64(bits)) | _segment(fp, i + 1)
            flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint64)
            keys = (exact[None, :] ^ flips[:, None]).reshape(-1)
            probe = np.repeat(flips > 0, len(fp))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.tile(fp, len(flips)).view(np.int64)), pa.array(probe)], ["key", "fp", "probe"])


def prune(p: np.ndarray, q: np.ndarray, i: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of places (p, q) that hold every chain from segment i.

    One segment at a time joins the chain, and pairs beyond the chain's share of
    MAX_BITS leave, so that later segments are looked at for few. The chain of the
    whole ring, the last one, is the full Hamming check.
    """
    m = len(SEGMENTS)
    first = np.array([s[0] for s in SEGMENTS], dtype=np.uint64)
    mask = np.array([(1 << s[1]) - 1 for s in SEGMENTS], dtype=np.uint64)
    total = np.zeros(len(p), dtype=np.uint8)
    for step in range(m):
        s = (i + step) % m
        total = total + np.bitwise_count(((fp[p] ^ fp[q]) >> first[s]) & mask[s])
        ok = total <= (step + 1) * MAX_BITS // m
        if not ok.all():
            p, q, i, total = p[ok], q[ok], i[ok], total[ok]
    return p, q


class _Forest:
    """Union-find over the values of one task; keeps the links that join."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def join(self, a: int, b: int) -> None:
        a2, b2 = self.root(a), self.root(b)
        if a2 != b2:
            self.up[max(a2, b2)] = min(a2, b2)
            self.links.append((a, b))


def _pairs(starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of all position pairs (p < q) within each [start, end)."""
    for size in np.unique(ends - starts):
        if size < 2:
            continue
        of = starts[ends - starts == size]
        p, q = np.triu_indices(int(size), 1)
        step = max(1, most // len(p))
        for at in range(0, len(of), step):
            base = of[at : at + step, None]
            yield (base + p).reshape(-1), (base + q).reshape(-1)


def links_of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links (a, b) of the fingerprints that share a key and hold the chains.

    The partition holds all rows of its keys, none of them above HOT_KEY members.
    """
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.Table.from_batches(tables)
    key, fp, probe = (t[c].to_numpy() for c in ("key", "fp", "probe"))
    order = np.lexsort((probe, key))
    key, fp, probe = key[order], fp[order].view(np.uint64), probe[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.append(starts[1:], len(key))
    exact = np.add.reduceat((~probe).astype(np.int64), starts)
    live = (exact > 0) & (ends - starts > 1)  # two probes alone are two bits apart: not a chain
    starts, ends = starts[live], ends[live]
    forest = _Forest()
    for p, q in _pairs(starts, ends):
        some = ~probe[p]  # exact rows come first within a key
        p, q = p[some], q[some]
        p, q = prune(p, q, key[p] >> 32, fp)
        for a, b in zip(fp[p].view(np.int64).tolist(), fp[q].view(np.int64).tolist()):
            forest.join(a, b)
    if forest.links:
        a, b = zip(*forest.links)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mid, fp) for each value within two bits of fp."""
    bit = (np.uint64(1) << np.arange(64, dtype=np.uint64))
    p, q = np.triu_indices(64, 1)
    flips = np.concatenate([[np.uint64(0)], bit, bit[p] | bit[q]])
    for b in batches:
        fps = b["fp"].to_numpy().view(np.uint64)
        for at in range(0, len(fps), 256):
            own = fps[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array((own[:, None] ^ flips).reshape(-1).view(np.int64)), pa.array(np.repeat(own, len(flips)).view(np.int64))], ["mid", "fp"])


def fingerprint_links(distinct: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """Links (a, b) that connect exactly what links of MAX_BITS connect.

    ``distinct``: fp long, each value once, in a written table.
    """
    spark = distinct.sparkSession
    keyed = distinct.select("fp").mapInArrow(ring_keys, "key long, fp long, probe boolean")
    hot = materialize(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("probe").alias("only_probes")).where(f"n > {hot_key} and not only_probes").select("key"), "hot")
    any_hot = not hot.isEmpty()
    cool = keyed.join(hot, "key", "left_anti") if any_hot else keyed
    parts = count_groups(75 * distinct.count(), ROWS_PER_TASK, int(spark.conf.get("spark.sql.shuffle.partitions")))
    links = cool.repartition(parts, "key").mapInArrow(links_of_keys, "a long, b long")
    if any_hot:
        mids = keyed.join(hot, "key").select("fp").distinct().mapInArrow(_midpoints, "mid long, fp long")
        low = mids.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("mid", "a")
        links = links.unionByName(mids.join(low, "mid").select("a", F.col("fp").alias("b")).where("a <> b").distinct())
    return links


def near_duplicates(docs: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, row_key, fp, fingerprint
    (16 hex digits), component_id (smallest doc_id reachable), root (the
    component's key, also where no row has an id)."""
    fps = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = connected_components(fingerprint_links(distinct, hot_key))
    node = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id")
    least = node.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = node.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    out = fps.join(of, "fp")
    return out.select("doc_id", "row_key", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component stays: the one with the smallest doc_id, and of
    rows that share it (or where all are null) the one with the smallest key. All
    columns of ``docs`` are kept."""
    near = near_duplicates(docs)
    near = near.withColumn("first", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    stay = near.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row_key").alias("row_key"))
    key = fresh(docs, "__row_key")
    keyed = with_row_key(docs, key)
    return keyed.join(by_merge(stay.withColumnRenamed("row_key", key)), key, "left_semi").dropDuplicates([key]).select(*docs.columns)
