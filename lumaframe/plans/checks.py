"""Acceptance rules: one wide row of facts per file becomes one row per rule.

Applicability has three values: an expected flavor evaluates its rules, another skips
them, and without an expectation a rule is evaluated if the file has what it is about.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gain import DISPLAYS, gain_weight
from ..functions.headroom import stops_from_tags

#: Fixed values: (criterion, name) and tolerances of the rules.
NAMES = {
    0: "some gain-map signaling present", 1: "base image is the primary item", 2: "gain map single-channel 8-bit", 3: "auxiliary URN and auxl to base",
    4: "tmap item, dimg order, brand, payload length", 5: "max_log2 equals alt_headroom", 6: "base_headroom is zero", 7: "metadata is valid",
    8: "tag 48 is not negative", 9: "headroom copies agree", 10: "every display gets its stops", 17: "tmap and base in one altr group",
}
PRIMARY_TYPES = ("hvc1", "hev1", "av01", "grid", "iden")
TOLERANCE, BASE_TOLERANCE, VERIFY_BASE_TOLERANCE = 1e-3, 1e-9, 1e-6

#: What the rules read; a frame of facts has these columns.
FACTS = (
    "path string, primary long, primary_type string, primary_hidden boolean, gain long, gain_bits array<int>, apple_aux long, auxl_to array<long>, tmap long, tmap_dimg array<long>, "
    "tmap_brand boolean, payload_len int, payload_want int, iso_ok boolean, min_log2 double, max_log2 double, gamma double, base_headroom double, alt_headroom double, "
    "xmp_headroom double, tag33 double, tag48 double, altr_ok boolean"
)


def delivery_error(base: Column, alt: Column, max_log2: Column) -> tuple[Column, Column]:
    """Largest shortfall or excess over the displays, and the first display that has it."""
    want = F.greatest(max_log2, F.lit(0.0))
    each = [F.abs(want * gain_weight(base, alt, F.lit(d)) - F.least(F.lit(d), want)) for d in DISPLAYS]
    worst = F.greatest(*each)
    at = F.lit(None).cast("double")
    for d, e in reversed(list(zip(DISPLAYS, each))):
        at = F.when(e == worst, d).otherwise(at)
    return worst, at


def copies_spread(copies: list[Column]) -> tuple[Column, Column]:
    """How many copies there are, and the largest difference of any two: over all pairs
    that is the greatest less the least, so no pairs are formed."""
    present = F.array_compact(F.array(*copies))
    return F.size(present), F.array_max(present) - F.array_min(present)


def rule_statuses(facts: DataFrame, expect: str | None = None) -> DataFrame:
    """path, criterion, name, status (pass, fail, skip) for every rule and file."""
    f = F.col

    def verdict(ok: Column) -> Column:
        return F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail")

    def asked(has: Column, flavor: str) -> Column:
        return has if expect is None else F.lit(expect in (flavor, "both"))

    has_apple, has_iso = f("apple_aux").isNotNull(), f("tmap").isNotNull()
    valid = F.lit(True)
    for c in ("min_log2", "max_log2", "gamma"):
        valid = valid & ~F.isnan(c) & (F.abs(f(c)) < float("inf"))
    valid = valid & (f("max_log2") >= f("min_log2")) & (f("gamma") > 0)
    worst, _ = delivery_error(f("base_headroom"), f("alt_headroom"), f("max_log2"))
    n, spread = copies_spread([F.when(f("iso_ok"), F.pow(F.lit(2.0), f("alt_headroom"))), f("xmp_headroom"), F.when(f("tag33").isNotNull(), F.pow(F.lit(2.0), stops_from_tags(f("tag33"), F.coalesce("tag48", F.lit(0.0)))))])
    tag48 = F.coalesce("tag48", F.lit(0.0))

    def of_iso(ok: Column) -> Column:
        return F.when(f("iso_ok"), verdict(ok)).when(has_iso, "fail").otherwise("skip")

    rules = {
        1: verdict(f("primary").isNotNull() & ~f("primary_hidden") & f("primary_type").isin(*PRIMARY_TYPES)),
        2: verdict(f("gain_bits") == F.array(F.lit(8))),
        3: F.when(asked(has_apple, "apple"), verdict(has_apple & F.array_contains("auxl_to", f("primary")))).otherwise("skip"),
        4: F.when(asked(has_iso, "iso"), verdict((f("tmap_dimg") == F.array("primary", "gain")) & f("tmap_brand") & (f("payload_len") == f("payload_want")))).otherwise("skip"),
        5: of_iso(F.abs(f("alt_headroom") - F.greatest(f("max_log2"), F.lit(0.0))) <= TOLERANCE),
        6: of_iso(F.abs(f("base_headroom")) <= BASE_TOLERANCE),
        7: of_iso(valid),
        8: F.when(f("tag33").isNull(), F.when(tag48 == 0, "skip").otherwise("fail")).otherwise(verdict((tag48 >= 0) & (f("tag33") >= 0))),
        9: F.when(n < 2, "skip").otherwise(verdict(spread <= TOLERANCE)),
        10: of_iso(worst <= TOLERANCE),
        17: F.when(has_iso, verdict(f("altr_ok"))).otherwise("skip"),
    }
    if expect is None:
        rules = {0: verdict(has_apple | has_iso)} | rules
    rows = F.array(*(F.struct(F.lit(c).alias("criterion"), F.lit(NAMES[c]).alias("name"), s.alias("status")) for c, s in rules.items()))
    return facts.select("path", F.explode(rows).alias("c")).select("path", "c.criterion", "c.name", "c.status")


def verdicts(checks: DataFrame) -> DataFrame:
    """Per file: how many rules passed, failed and were skipped, and whether none failed."""
    counts = {s: F.count_if(F.col("status") == s).alias(n) for s, n in (("pass", "passed"), ("fail", "failed"), ("skip", "skipped"))}
    return checks.groupBy("path").agg(*counts.values(), F.every(F.col("status") != "fail").alias("ok"))
