"""Documents to packed training sequences: quality rules, exact dedup, near dedup,
secret scans, packing.

Each stage takes what its predecessor kept, as written Parquet, and all but the last
return the columns of ``documents``: junk and all but one of each group of copies or
near copies go; secrets are replaced within the texts that hold them; the rest is as it
was. The last returns one row per piece with its place in a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumaframe.llm.common import materialize, read_table
from lumaframe.llm.exact_dedup import drop_copies
from lumaframe.llm.packing import pack
from lumaframe.llm.quality import drop_junk
from lumaframe.llm.secrets import redact
from lumaframe.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_junk(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("secret_scans", secrets), ("best_fit_packing", packing)]

#: Tokenisation and XXH64 have no SQL here; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
