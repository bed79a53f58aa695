"""Licence scans by the digest of a canonical text.

A text is brought to a canonical form (lower case; copyright lines out; equivalent
spellings as one; everything but letters and digits is a single space) and its SHA-256
is hash-joined to the digests of known licence texts. Entire texts are compared: that of
a document, and that of each of its lines with a letter or digit, as notices are one
line long; a document's lines are looked up within its row, by a map of the same digests.

Native throughout; the known digests are a fixed table of a few rows, so that is what
is broadcast. Scale: one scan, no shuffle.

Defined results: null text counts as empty and holds no licence; null doc_id is an id
like any other; repeated rows are scanned each, alike; several notices are listed by
name, once each; a very long text is read whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .known_licenses import ENTIRE, EQUIVALENT, KNOWN
from .native import let

#: A line that states who holds the copyright.
COPYRIGHT_LINE = r"(?m)^[^\n]{0,20}(?:copyright|\(c\)|©)[^\n]{0,20}(?:[0-9]{4}|\(c\)|©|<|\[)[^\n]*$"
#: A line that may state it in other words; it does if it is no part of a known text.
HOLDER_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\b|\(c\)|©|all rights reserved\b)"
#: One that is no part of any text's terms, though MPL-1.1 has the words.
RESERVED_LINE = r"^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for spelling, usual in EQUIVALENT:
        out = F.replace(out, F.lit(f" {spelling} "), F.lit(f" {usual} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def without_holders(text: Column, known_words: Column) -> Column:
    """``text`` in lower case without the lines that state a copyright, whatever follows
    and at any distance. ``known_words``: canonical known texts, with a space around each."""

    def stays(line: Column) -> Column:
        part = F.contains(known_words, F.concat(F.lit(" "), canonical(line), F.lit(" ")))
        return ~F.rlike(line, F.lit(HOLDER_LINE)) | (part & ~F.rlike(line, F.lit(RESERVED_LINE)))

    return F.array_join(F.filter(F.split(F.lower(text), "\n"), stays), "\n")


def known(spark, more: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """(digest, license, words) of the known texts and of ``more``: at most as many rows as those have."""
    return spark.createDataFrame(sorted({*KNOWN, *ENTIRE, *more}), "license string, known string").select(digest(F.col("known")).alias("digest"), "license", canonical(F.col("known")).alias("words")).dropDuplicates(["digest"])


def scan_licenses(docs: DataFrame, more: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """doc_id, text_digest, license (that of the digest, or of the entire text
    without any line that states a copyright, or null), notices (names of
    the licences whose notice is a line, comma-joined) and n_notices (such lines).

    ``more``: (licence, text) of a caller that are known too."""
    table = known(docs.sparkSession, more)
    rows = table.orderBy("license").collect()  # the fixed table
    names = F.create_map(*(F.lit(x) for r in rows for x in (r["digest"], r["license"])))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[\p{L}\p{N}]")))
    of_lines = let(lines, lambda xs: F.array_compact(F.transform(xs, lambda x: F.element_at(names, digest(x)))))
    words = F.lit(" " + " | ".join(r["words"] for r in rows) + " ")
    bare = F.when(F.rlike(F.lower(text), F.lit(HOLDER_LINE)), digest(without_holders(text, words)))
    found = docs.select("doc_id", digest(text).alias("text_digest"), bare.alias("bare"), of_lines.alias("found"))
    for digest_of, name in (("text_digest", "whole"), ("bare", "without")):
        found = found.join(F.broadcast(table.select(F.col("digest").alias(digest_of), F.col("license").alias(name))), digest_of, "left")
    notices = F.array_join(F.array_sort(F.array_distinct("found")), ",")
    return found.select("doc_id", "text_digest", F.coalesce("whole", "without").alias("license"), notices.alias("notices"), F.size("found").cast("long").alias("n_notices"))
