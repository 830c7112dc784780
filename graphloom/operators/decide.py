"""Decisions of sites as one CASE chain over array columns.

A site has candidates and evidence about them: flow_candidates (reached by value flow),
field_only (known by a field's name alone), test_only, truncated, receiver_exact, via,
declared_target, declared_library, library_runs (null: no library call).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANDIDATE_CAP = 20


def options() -> Column:
    """Candidates that may be decided: all but the test-only ones."""
    return F.array_except("candidates", "test_only")


def strong() -> Column:
    """Options that value flow reaches by more than a field's name."""
    return F.array_except(F.array_intersect(options(), F.col("flow_candidates")), F.col("field_only"))


def receiver_exact() -> Column:
    return (F.col("category") != "dispatch") & F.col("receiver_exact") & (F.size("field_only") == 0) & (F.size(options()) > 0)


def dispatch_by_receiver() -> Column:
    """Targets that a dispatch's receiver evidence decides, or null."""
    one = F.get("flow_candidates", F.lit(0))
    exact = F.when((F.size("flow_candidates") == 1) & F.array_contains(options(), one), F.array(one))
    reached = F.when(~F.col("truncated") & (F.size(strong()) > 0), strong())
    return F.when(F.col("category") == "dispatch", F.when(F.col("receiver_exact"), exact).otherwise(reached))


def unique_flow_target() -> Column:
    """The one strong option of a call without target that has several, or null."""
    fits = (F.col("category") == "no_target") & (F.size(options()) >= 2) & ~F.col("truncated") & (F.size(strong()) == 1)
    return F.when(fits, F.get(strong(), F.lit(0)))


def one_protocol(class_of: Callable[[Column], Column]) -> Column:
    """All options are members of one class."""
    owners = F.transform(options(), class_of)
    return (F.size(options()) > 0) & (F.size(F.array_distinct(owners)) == 1) & F.get(owners, F.lit(0)).isNotNull()


#: Reasons that decide a site, and which targets they give.
DECIDED = {"library_runs": "options", "receiver_proven": "flow_candidates", "receiver_types": "strong", "receiver_contexts": "options", "unique_flow": "strong", "one_candidate": "options", "one_protocol": "options"}


def decide(sites: DataFrame, class_of: Callable[[Column], Column]) -> DataFrame:
    """One decision per site: site_id, status (decided, unknown), targets, reason."""
    s = sites.withColumn("options", options())
    s = s.withColumns({"strong": F.array_except(F.array_intersect("options", "flow_candidates"), F.col("field_only")), "owners": F.array_distinct(F.transform("options", class_of))})
    n, strong_n = F.size("options"), F.size("strong")
    dispatch = F.col("category") == "dispatch"
    only = F.get("options", F.lit(0))
    library = (n > 0) & (F.col("category") == "callback") & F.col("library_runs").isNotNull()
    proven = F.col("receiver_exact") & (F.size("flow_candidates") == 1) & F.array_contains("options", F.get("flow_candidates", F.lit(0)))
    reason = (
        F.when(library, F.when(F.col("library_runs"), "library_runs").otherwise("library_unknown"))
        .when(dispatch & proven, "receiver_proven")
        .when(dispatch & ~F.col("receiver_exact") & ~F.col("truncated") & (strong_n > 0), "receiver_types")
        .when(~dispatch & F.col("receiver_exact") & (F.size("field_only") == 0) & (n > 0), "receiver_contexts")
        .when((F.col("category") == "no_target") & (n >= 2) & ~F.col("truncated") & (strong_n == 1), "unique_flow")
        .when(dispatch & F.col("declared_target").isNull() & F.col("declared_library").isNotNull() & (n > 0), "library_dispatch")
        .when((n == 1) & F.array_contains("field_only", only), "field_name_only")
        .when(n == 1, "one_candidate")
        .when((n == 0) & (F.size("candidates") > 0), "test_only")
        .when((n > 1) & (F.col("category") == "implicit") & (F.size("owners") == 1) & F.get("owners", F.lit(0)).isNotNull() & ~F.arrays_overlap("options", "field_only"), "one_protocol")
        .otherwise("not_unique")
    )
    s = s.select("site_id", "options", "strong", "flow_candidates", reason.alias("reason"))
    targets = F.expr("cast(array() as array<string>)")
    for column in ("options", "strong", "flow_candidates"):
        targets = F.when(F.col("reason").isin([r for r, c in DECIDED.items() if c == column]), F.col(column)).otherwise(targets)
    return s.select("site_id", F.when(F.col("reason").isin(list(DECIDED)), "decided").otherwise("unknown").alias("status"), targets.alias("targets"), "reason")


def finish_candidates(ids: Column) -> Column:
    """struct(candidates, truncated): sorted, distinct, at most CANDIDATE_CAP."""
    every = F.array_sort(F.array_distinct(ids))
    return F.struct(F.slice(every, 1, CANDIDATE_CAP).alias("candidates"), (F.size(every) > CANDIDATE_CAP).alias("truncated"))


def merge_subset(existing: Column, new: Column, candidates: Column) -> Column:
    """Candidates that either list holds, in the candidates' order."""
    return F.filter(candidates, lambda c: F.array_contains(existing, c) | F.array_contains(new, c))


def undecided(sites: DataFrame, decisions: DataFrame) -> DataFrame:
    """Sites that have options and no decision, and whose parent site, if any, is decided."""
    known = decisions.select("site_id", "status")
    parent = known.select(F.col("site_id").alias("via"), F.col("status").alias("via_status"))
    joined = sites.join(known, "site_id", "left").join(parent, "via", "left")
    open_ = (F.size(options()) > 0) & (F.coalesce("status", F.lit("unknown")) != "decided")
    return joined.where(open_ & (F.col("via").isNull() | (F.col("via_status") == "decided"))).select("site_id")


def dispatch_like() -> Column:
    return F.col("category").isin("dispatch", "flow_call", "override")
