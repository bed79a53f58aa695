"""The thin ``opN_`` queries over the whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .exact_dedup import exact_dedup
from .known_licenses import KNOWN
from .licenses import scan_licenses
from .lm import score
from .packing import pack
from .pieces import round_trips
from .quality import judge
from .secrets import scan
from .simhash import near_duplicates
from .substring_dedup import remove_repeats
from .toxicity import classify

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(read_table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_clean")


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    out = classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), chain)
    return out.withColumn("toxic", F.col("p_toxic") >= 0.5)


def queries() -> dict[str, Query]:
    dealt = (
        op1_sentencepiece, op2_simhash_near_dedup, op3_best_fit_packing, op4_suffix_array_dedup, op5_secret_scans,
        op6_quality_rules, op7_license_scans, op8_exact_dedup, op9_lm_scoring, op10_toxicity,
    )
    return {f.__name__: f for f in dealt}


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY n) AS group_size,
       row_number() OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) = 1 AS kept, sha256(n) AS text_sha256
FROM d
"""


#: What the SQL takes for the same word, and for a line that states a copyright: its own.
_SAME_WORDS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sub license": "sublicense", "sub licence": "sublicense", "copyright owner": "copyright holder", "favour": "favor",
    "non infringement": "noninfringement", "v 2": "version 2", "v2": "version 2", "v 3": "version 3", "v3": "version 3", "organisation": "organization", "per cent": "percent", "while": "whilst",
}
_HOLDER = r"(^|\n)[^\n]{0,20}(copyright|\(c\)|©)[^\n]{0,20}([0-9][0-9][0-9][0-9]|\(c\)|©|<|\[)[^\n]*"


def _canonical_sql(text: str) -> str:
    out = f"' ' || trim(regexp_replace(regexp_replace(lower({text}), '{_HOLDER}', '\\1 ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for spelling, usual in _SAME_WORDS.items():
        out = f"replace({out}, ' {spelling} ', ' {usual} ')"
    return f"sha256(trim({out}))"


def _op7_sql() -> str:
    """All lines with a letter or digit are looked up, as are all texts."""
    known = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT license, {_canonical_sql("text")} AS digest FROM (VALUES {known}) AS k(license, text)),
d AS (SELECT doc_id, coalesce(text, '') AS text, {_canonical_sql("coalesce(text, '')")} AS text_digest FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
f AS (SELECT l.doc_id, k.license FROM (SELECT doc_id, {_canonical_sql("line")} AS digest FROM l WHERE regexp_matches(line, '[\\p{{L}}\\p{{N}}]')) l JOIN known k USING (digest)),
n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n_notices FROM f GROUP BY doc_id)
SELECT d.doc_id, d.text_digest, k.license, coalesce(n.notices, '') AS notices, coalesce(n.n_notices, 0) AS n_notices
FROM d LEFT JOIN known k ON d.text_digest = k.digest LEFT JOIN n ON d.doc_id = n.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_license_scans": _op7_sql(), "op8_exact_dedup": OP8_SQL}
