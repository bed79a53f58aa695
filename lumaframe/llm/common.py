"""Shared helpers: row keys, connected components; written intermediates are the engine's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.written import clear, materialize, release, scratch_dir

#: Type of a row key.
ROW_KEY = "struct<a:bigint,b:bigint>"

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_key(docs: DataFrame, name: str = "__row_key") -> DataFrame:
    """Add a key of (doc_id, text), two hashes of 64 bits; rows that agree in both share it."""
    doc_id, text = F.col("doc_id"), F.col("text")
    one = F.xxhash64(doc_id, text, doc_id.isNull(), text.isNull())
    two = F.xxhash64(text.isNull(), F.lit(1), text, doc_id, doc_id.isNull())
    return docs.withColumn(name, F.struct(one.alias("a"), two.alias("b")))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text) key has a kept row in ``decisions``.

    ``decisions``: row_key, kept boolean, one row per row of ``docs``. Of rows
    that agree in doc_id and text as many stay as are kept in ``decisions``; as
    such rows are interchangeable, which of them stays is not defined. Columns and
    their order are those of ``docs``.
    """
    key, stay, rows = (fresh(docs, x) for x in ("__row_key", "__stay", "__rows"))
    d = decisions.groupBy(F.col("row_key").alias(key)).agg(F.sum(F.col("kept").cast("int")).alias(stay), F.count("*").alias(rows)).where(F.col(stay) > 0)
    j = with_row_key(docs, key).join(by_merge(d), key)
    whole = j.where(F.col(stay) == F.col(rows)).select(*docs.columns)
    some = j.where(F.col(stay) < F.col(rows)).dropDuplicates([key])
    some = some.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(stay))).alias(fresh(docs, "__i"))).select(*docs.columns)
    return whole.unionByName(some)


def by_merge(df: DataFrame) -> DataFrame:
    """Join with ``df`` by sorting both sides. Its size grows with the input, so it is
    not left to its size at hand whether it is broadcast: plans, and what they
    shuffle, stay alike at every scale."""
    return df.hint("merge")


#: Rows of a few numbers up to which a table is broadcast.
MOST_BROADCAST = 1_000_000


def sized(df: DataFrame) -> DataFrame:
    """Join with ``df``, a written table of a few numbers a row: by broadcast if it has
    ``MOST_BROADCAST`` rows at most, else by sorting both sides."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else by_merge(df)


def count_groups(n_rows: int, per_part: int, least: int = 1) -> int:
    """Partitions that keep each at about ``per_part`` rows."""
    return max(least, -(-n_rows // per_part))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); root is the smallest
    node reachable.

    Alternating large-star and small-star passes (Kiveris et al., 2014), each a
    shuffle on the node with map-side partial minima. A hub's list of neighbours is
    never gathered: minima are aggregated, then joined back. Each pass is written to
    the shared folder, so a lost executor costs one pass at most.
    """
    def large_star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        j = down.join(low, "a")
        return j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    def signature(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    cur = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    sign = signature(cur)
    while sign[0]:
        new = materialize(small_star(large_star(cur)), "star")
        release(cur)
        cur, last, sign = new, sign, signature(new)
        if sign == last:
            break
    roots = cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
