"""Secret scans by a trigram inverted index.

From each rule's expression a Boolean trigram query is derived. The index holds, for each
of the queries' trigrams and each shard of documents, the sorted numbers of the rows
whose text has the trigram in either case. A rule's query intersects and unites those
lists, which gives its candidates, and its expression verifies those alone; a rule
without mandatory trigrams (``hex``) scans every document.

Native: index, queries and spans are DataFrame expressions; no Python runs on
executors. Scale: a shard has about ``SHARD_ROWS`` rows, so a list has no more, however
frequent its trigram, and a shard's lists (one for each trigram of the queries) meet in
one row. A row's number is a hash within its shard; rows that share one share candidates,
which are verified anyway. Texts are shuffled once, to meet their candidates. The places
of matches come from the lengths of what lies between and within them, summed in
blocks, so that very many matches in one text stay cheap.

Defined results: null text counts as empty and has no spans; null doc_id is an id
like any other; repeated rows are scanned each, alike; a very long text is scanned whole;
spans that start together go by the order of ``RULES``; an empty table gives an empty
result; extra columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_merge, count_groups, fresh, materialize, with_row_key
from .native import let, running_sum
from .trigrams import query_of, trigrams_of

#: (kind, expression, least characters of a match or of its group 1). The first three
#: are the base; letters of ``assign``'s names count in either case.
#: ``{32,}`` and ``{12,}`` ask for what "+" and then a length would: their class is one run.
RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 16),
    ("hex", r"[0-9a-f]{32,}", 32),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    ("maps", r"AIza[0-9A-Za-z_-]{35}", 39),
    ("payment", r"sk_(?:live|test)_[0-9A-Za-z]{16,}", 24),
    ("webtoken", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", 29),
    ("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 20),
)
BASE = 3
MARK = "[SECRET]"
#: Rows of a shard of the index.
SHARD_ROWS = 4096
QUERIES = {kind: query_of(pattern) for kind, pattern, _ in RULES}
TRIGRAMS = sorted(set().union(*(trigrams_of(q) for q in QUERIES.values())))
_SPAN = "array<struct<start:bigint,kind_at:int,kind:string,end:bigint>>"


def numbered(docs: DataFrame, shards: int, shard: str, row: str) -> DataFrame:
    """``docs`` with a row's shard and its number in it, both from (doc_id, text)."""
    key = fresh(docs, "__row_key")
    keyed = with_row_key(docs, key)
    return keyed.withColumns({shard: F.pmod(F.col(f"{key}.a"), F.lit(shards)), row: F.col(f"{key}.b")}).drop(key)


def postings(rows: DataFrame) -> DataFrame:
    """(shard, trigram, rows): the index of ``rows`` (shard, row, text). ``trigram``
    counts TRIGRAMS from 0."""
    lower = rows.select("shard", "row", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("low"))  # once for all trigrams
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(TRIGRAMS))))
    each = lower.select("shard", "row", F.explode(held).alias("trigram"))
    return each.groupBy("shard", "trigram").agg(F.sort_array(F.collect_set("row")).alias("rows"))


def satisfying(query, lists: Column) -> Column:
    """The rows that a query's lists, intersected and united, leave."""
    if isinstance(query, str):
        return F.coalesce(F.element_at(lists, F.lit(TRIGRAMS.index(query))), F.array().cast("array<bigint>"))
    parts = [satisfying(q, lists) for q in sorted(query[1], key=repr)]
    out = parts[0]
    for p in parts[1:]:
        out = F.array_intersect(out, p) if query[0] == "and" else F.array_union(out, p)
    return out


def candidates(index: DataFrame) -> DataFrame:
    """(shard, row, rules): the rows that satisfy the query of a rule, and the numbers of
    those rules as bits. Rules without a query are not among them."""
    shards = index.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("lists"))
    by_rule = [F.struct(F.lit(1 << i).alias("bit"), satisfying(QUERIES[kind], F.col("lists")).alias("rows")) for i, (kind, _, _) in enumerate(RULES) if QUERIES[kind] is not None]
    each = shards.select("shard", F.explode(F.array(*by_rule)).alias("of")).select("shard", "of.bit", F.explode("of.rows").alias("row"))
    return each.groupBy("shard", "row").agg(F.bit_or("bit").alias("rules"))


def _spans(text: Column, at: int) -> Column:
    """Matches of a rule in order, as code points from 0, ends exclusive."""
    kind, pattern, least = RULES[at]
    group = 1 if "([" in pattern else 0

    def located(matches: Column) -> Column:
        def with_pieces(pieces: Column) -> Column:
            ends = running_sum(F.transform(matches, lambda m, i: (F.length(F.get(pieces, i)) + F.length(m)).cast("long")))
            values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
            found = let(ends, lambda e: let(values, lambda v: F.transform(matches, lambda m, i: F.when(F.length(F.get(v, i)) >= least, F.struct((F.get(e, i) - F.length(m)).cast("long").alias("start"), F.lit(at).alias("kind_at"), F.lit(kind).alias("kind"), F.get(e, i).cast("long").alias("end"))))))
            return F.array_compact(found).cast(_SPAN)

        # between the matches: the same expression splits where it matches
        return F.when(F.size(matches) == 0, F.array().cast(_SPAN)).otherwise(let(F.split(text, pattern, -1), with_pieces))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_spans(docs: DataFrame, name: str = "spans") -> DataFrame:
    """``docs`` with column ``name``: all matches by start, then by the order of RULES."""
    shards = count_groups(docs.count(), SHARD_ROWS)
    index = materialize(postings(numbered(docs.select("doc_id", "text"), shards, "shard", "row")), "postings")
    shard, row, rules = (fresh(docs, x) for x in ("__shard", "__row", "__rules"))
    found = candidates(index).select(F.col("shard").alias(shard), F.col("row").alias(row), F.col("rules").alias(rules))
    met = numbered(docs, shards, shard, row).join(by_merge(found), [shard, row], "left")
    text, none = F.coalesce(F.col("text"), F.lit("")), F.array().cast(_SPAN)
    of_rule = []
    for i, (kind, pattern, _) in enumerate(RULES):
        asked = F.lit(True) if QUERIES[kind] is None else F.coalesce(F.col(rules).bitwiseAND(F.lit(1 << i)) != 0, F.lit(False))
        of_rule.append(F.when(asked & F.rlike(text, F.lit(pattern)), _spans(text, i)).otherwise(none))
    return met.withColumn(name, F.array_sort(F.concat(*of_rule))).drop(shard, row, rules)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex,
    base_sha256, spans (text) and found (the spans as structs)."""
    out = with_spans(docs.select("doc_id", "text"), "found").select("doc_id", "found")
    base = F.filter("found", lambda s: s["kind_at"] < BASE)
    kinds = F.transform("found", lambda s: s["kind_at"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{RULES[i][0]}") for i in range(BASE)]
    return out.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"), "found")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each stretch of secrets replaced by MARK, n_chars to match where
    there is such a column; documents without secrets are unchanged."""

    def cleaned(spans: Column) -> Column:
        text = F.col("text")
        # a span starts a stretch if all before it end at or before its start
        reach = F.transform(spans, lambda s, i: F.coalesce(F.array_max(F.transform(F.slice(spans, F.lit(1), i), lambda x: x["end"])), F.lit(-1).cast("long")))
        edges = let(reach, lambda r: F.array_compact(F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(r, i), F.struct(F.greatest(F.get(r, i), F.lit(0)).alias("before"), s["start"].alias("start"))))))
        kept = let(edges, lambda e: F.transform(e, lambda x: F.concat(F.substring(text, (x["before"] + 1).cast("int"), (x["start"] - x["before"]).cast("int")), F.lit(MARK))))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(kept, ""), F.substring(text, (last + 1).cast("int"), F.length(text)))

    name = fresh(docs, "__spans")
    found = with_spans(docs, name)
    clean = F.size(name) == 0
    out = found.withColumn("text", F.when(clean, F.col("text")).otherwise(let(F.col(name), cleaned)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(clean, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
