"""Exact dedup by distributed MSD radix partitioning.

Texts count as equal when they are identical after every byte of [\\x20\\x09-\\x0D]
is deleted. The normalised bytes are cut into digits that grow from the front
(32 B, 512 B, 8 KiB, ...). Round r splits every group that still has two or more
members by its r-th digit; a group of one is done, and so is a group whose members
end within the digit, as all their bytes have then been compared. No digest takes
part: groups are formed on the bytes themselves.

Scale: equal texts within one Arrow batch collapse to one representative before
anything is shuffled, so a text that holds a third of all rows sends one row per
batch. Counts per digit combine on the map side; the join that carries group ids
forward is a plain sort-merge join, which adaptive execution splits if skewed. Only
members of groups that are still open take part in the next round, and each round
reads just its own digit's column of the written table.

Defined results: a null text counts as empty; null doc_id is a row like any other
and sorts after all ids; repeated rows are separate rows, of which one stays; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, by_merge, keep_rows, materialize, with_row_key

#: Bytes of each digit; what is left after them is the last digit.
DIGITS = (32, 512, 8192, 131072, 2097152)
SPACE = b" \t\n\x0b\x0c\r"

_SCAN = f"rid long, doc_id long, row_key {ROW_KEY}, n_points long, text_sha256 string, rep long, copies long, best struct<neg_points:long,no_id:boolean,doc_id:long,rid:long>, " + ", ".join(f"d{i} binary" for i in range(len(DIGITS) + 1))


def _cut(norm: bytes) -> list[bytes]:
    out, at = [], 0
    for w in DIGITS:
        out.append(norm[at : at + w])
        at += w
    return [*out, norm[at:]]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Normalise, and collapse equal texts of a batch to one representative."""
    rid = TaskContext.get().partitionId() << 40
    best_t = pa.struct([("neg_points", pa.int64()), ("no_id", pa.bool_()), ("doc_id", pa.int64()), ("rid", pa.int64())])
    for b in batches:
        ids, texts = b["doc_id"].to_pylist(), b["text"].to_pylist()
        groups: dict[bytes, list] = {}  # text -> [rep, copies, best]
        rows = []
        for doc_id, text in zip(ids, texts):
            text = text or b""
            points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
            norm = text.translate(None, SPACE)
            mine = (-points, doc_id is None, doc_id or 0, rid)
            g = groups.get(norm)
            if g is None:
                groups[norm] = g = [rid, 1, mine, hashlib.sha256(norm).hexdigest()]
            else:
                g[1] += 1
                g[2] = min(g[2], mine)
            rows.append((rid, doc_id, points, g[3], g[0]))
            rid += 1
        of = {g[0]: (norm, g) for norm, g in groups.items()}
        cols = list(zip(*rows)) if rows else [[]] * 5
        mine = [of.get(r) if r == p else None for r, p in zip(cols[0], cols[4])]
        digits = [_cut(m[0]) if m else [None] * (len(DIGITS) + 1) for m in mine]
        names = ("neg_points", "no_id", "doc_id", "rid")
        arrays = [pa.array(cols[i], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()))]
        arrays.insert(2, b["row_key"])
        arrays += [pa.array([m and m[1][1] for m in mine], pa.int64()), pa.array([m and dict(zip(names, m[1][2])) for m in mine], best_t)]
        arrays += [pa.array([d[i] for d in digits], pa.binary()) for i in range(len(DIGITS) + 1)]
        yield pa.RecordBatch.from_arrays(arrays, [f.strip().split(" ")[0] for f in ("rid,doc_id,row_key,n_points,text_sha256,rep,copies,best," + ",".join(f"d{i}" for i in range(len(DIGITS) + 1))).split(",")])


def radix_groups(digits: DataFrame) -> DataFrame:
    """(rep, gid) for members of equal groups of two or more; gid is the least rep.

    ``digits``: rep long (unique), d0..dK binary, the digits of each text.
    """
    spark = digits.sparkSession
    done = spark.createDataFrame([], "rep long, gid long")
    cur = digits.select("rep", F.lit(0).cast("long").alias("gid"), F.col("d0").alias("digit"))
    for r in range(len(DIGITS) + 1):
        open_groups = cur.groupBy("gid", "digit").agg(F.count("*").alias("n"), F.min("rep").alias("next")).where("n > 1")
        ended = F.length("digit") < DIGITS[r] if r < len(DIGITS) else F.lit(True)
        hits = materialize(cur.join(by_merge(open_groups), ["gid", "digit"]).select("rep", F.col("next").alias("gid"), ended.alias("ended")), f"radix{r}")
        done = done.unionByName(hits.where("ended").select("rep", "gid"))
        going = hits.where("not ended").select("rep", "gid")
        if going.isEmpty():
            break
        cur = digits.select("rep", F.col(f"d{r + 1}").alias("digit")).join(by_merge(going), "rep")
    return done


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, row_key, keep_id,
    group_size, kept, text_sha256. Of equal texts the row with the most code points,
    then the smallest doc_id, stays."""
    keyed = with_row_key(docs.select("doc_id", "text"), "row_key")
    scanned = materialize(keyed.select(F.col("doc_id").cast("long"), "row_key", F.col("text").cast("binary")).mapInArrow(_scan, _SCAN), "radix")
    reps = scanned.where("copies is not null")
    classes = radix_groups(reps)
    of = reps.select("rep", "copies", "best").join(by_merge(classes), "rep", "left").select("rep", F.coalesce("gid", "rep").alias("gid"), "copies", "best")
    size = of.groupBy("gid").agg(F.sum("copies").alias("group_size"), F.min("best").alias("best"))
    of = of.select("rep", "gid").join(by_merge(size), "gid").select("rep", "group_size", "best")
    out = scanned.select("rid", "doc_id", "row_key", "rep", "text_sha256").join(by_merge(of), "rep")
    return out.select("doc_id", "row_key", F.when(~F.col("best.no_id"), F.col("best.doc_id")).alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return keep_rows(docs, exact_dedup(docs).select("row_key", "kept"))
