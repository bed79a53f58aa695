"""Quality rules combined by weak supervision.

Each rule votes clean, votes junk or abstains. What the votes are worth is not set by
hand: expectation-maximisation over all documents that pass the base rule estimates
for each rule how often it votes right on clean and on junk documents, together with
the share of clean ones, and a document is kept if the posterior probability that it
is clean is one half or more (``base_failed`` documents never are).

Native: the features, votes and posterior are DataFrame expressions; no Python runs
on executors. EM needs only how often each pattern of votes occurs, at most 3^rules
rows (``MAX_PATTERNS``) whatever the input, which is what the driver gets.

Scale: one pass without a shuffle of text; windows of a document are compared inside
its row, by hashes and only if some hash repeats by a sort.

Defined results: null or blank text has no words, fails the base rule and goes; null
doc_id is an id like any other; repeated rows are judged each, alike; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, materialize, with_row_key
from .native import let, total

SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
MARKS = r"[^\p{L}\x20\x09-\x0D]"  # neither letters nor spaces
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of words
#: EM ends when no posterior moves by more than this, or after so many rounds.
STILL, EM_ROUNDS = 1e-9, 1000

#: Votes (right, wrong) that a rule is taken to have cast on clean and on junk documents
#: before any is seen: a few, whatever the size of the input, so that data outweigh them.
ON_CLEAN, ON_JUNK = (9, 1), (1, 1)

#: (rule, measure, clean if, junk if); neither: it abstains. Measures of one thing are
#: one rule, as EM takes rules to err independently.
RULES = (
    ("word_length", "word_chars / n_words", "word_chars >= 3 * n_words and word_chars <= 10 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    ("symbols", "n_symbols / n_words", "20 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    ("marks", "n_marks / word_chars", "8 * n_marks <= word_chars", "5 * n_marks > word_chars"),
    ("repetition", "repeated lines, few different words", "10 * n_dup_lines <= n_lines and 5 * n_distinct >= n_words", "2 * n_dup_lines > n_lines or 12 * n_distinct < n_words"),
    ("capitals", "n_capitals / word_chars", "5 * n_capitals <= word_chars", "2 * n_capitals > word_chars"),
)
MAX_PATTERNS = 3 ** len(RULES)


def _repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that the text holds twice or more."""

    def marked(pairs: Column) -> Column:
        # pairs (hash, place) sorted: a window repeats if a neighbour has its hash
        near = F.transform(pairs, lambda x, i: F.when((F.get(pairs, i - 1)["h"] == x["h"]) | (F.get(pairs, i + 1)["h"] == x["h"]), x["at"]))
        return let(F.array_sort(F.array_compact(near)), lambda at: total(F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))).cast("long"))))

    def found(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        exact = let(F.sort_array(pairs), marked)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(exact)

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, found))


def _of_words(words: Column) -> Column:
    return F.struct(
        F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _repeated_words(words).alias("n_repeat_words"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
    )


def features(docs: DataFrame) -> DataFrame:
    """doc_id, row_key and the measures of each row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = with_row_key(docs.select("doc_id", "text"), "row_key").select(
        "doc_id", "row_key", let(words, _of_words).alias("w"), of_lines.alias("l"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"), F.regexp_count(text, F.lit(MARKS)).cast("long").alias("n_marks"),
    )
    return out.select("doc_id", "row_key", "w.*", "l.*", "n_symbols", "n_capitals", "n_marks")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def votes() -> list[Column]:
    """1 clean, -1 junk, 0 abstains; junk goes first if both hold."""
    return [F.when(F.expr(junk), -1).when(F.expr(clean), 1).otherwise(0).alias(f"vote_{name}") for name, _, clean, junk in RULES]


def _accuracy(votes: list[tuple[float, int]], right: int, before: tuple[int, int]) -> float:
    """Share of right votes among (documents, vote), abstentions aside."""
    cast = sum(n for n, v in votes if v)
    return (sum(n for n, v in votes if v == right) + before[0]) / (cast + sum(before))


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[tuple[float, float]]]:
    """EM over (votes, documents): log odds of clean before any vote, and for each
    rule the log odds that its vote for clean and its vote for junk add.

    A rule's accuracies on clean and on junk documents are two numbers, as a rule
    against one kind of junk is right on nearly all clean documents and misses
    other junk. Starts from: the more votes for junk, the less likely clean.
    """
    rules = range(len(RULES))
    if not patterns:
        return 0.0, [(0.0, 0.0) for _ in rules]
    post = [(0.95, 0.3, 0.05)[min(2, sum(v < 0 for v in votes))] for votes, _ in patterns]
    prior, weights = 0.0, [(0.0, 0.0) for _ in rules]
    for _ in range(EM_ROUNDS):
        last = post
        all_clean = sum(p * n for p, (_, n) in zip(post, patterns))
        everything = sum(n for _, n in patterns)
        prior = math.log((all_clean + 1) / (everything - all_clean + 1))
        weights = []
        for j in rules:
            on_clean = _accuracy([(p * n, v[j]) for p, (v, n) in zip(post, patterns)], 1, ON_CLEAN)
            on_junk = _accuracy([((1 - p) * n, v[j]) for p, (v, n) in zip(post, patterns)], -1, ON_JUNK)
            weights.append((math.log(on_clean / (1 - on_junk)), math.log((1 - on_clean) / on_junk)))
        odds = [prior + sum(weights[j][0] if v[j] > 0 else weights[j][1] if v[j] < 0 else 0.0 for j in rules) for v, _ in patterns]
        post = [1 / (1 + math.exp(-max(-50.0, min(50.0, x)))) for x in odds]
        if max(abs(a - b) for a, b in zip(post, last)) < STILL:
            break
    return prior, weights


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, the measures, base_failed, p_clean (posterior) and kept."""
    measured = materialize(features(docs).select("*", base_failed().alias("base_failed"), *votes()), "quality")
    names = [f"vote_{r[0]}" for r in RULES]
    rows = measured.where("not base_failed").groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most MAX_PATTERNS
    prior, weights = fit(sorted((tuple(r[n] for n in names), r["n"]) for r in rows))
    odds = F.lit(prior)
    for name, (clean, junk) in zip(names, weights):
        odds = odds + F.when(F.col(name) > 0, clean).when(F.col(name) < 0, junk).otherwise(0.0)
    return measured.withColumn("p_clean", 1 / (1 + F.exp(-odds))).withColumn("kept", ~F.col("base_failed") & (odds >= 0)).drop(*names)


def drop_junk(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return keep_rows(docs, judge(docs).select("row_key", "kept"))
