"""Sites: places whose target is open, with their candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.decide import CANDIDATE_CAP


def _capped(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, candidates (by uid, at most CANDIDATE_CAP), truncated, from one row per candidate."""
    order = Window.partitionBy(*key).orderBy("uid")
    numbered = rows.select(*key, "uid").distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= CANDIDATE_CAP + 1)
    out = numbered.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("_n") <= CANDIDATE_CAP, F.col("uid")))).alias("candidates"), (F.max("_n") > CANDIDATE_CAP).alias("truncated"))
    return out


def dispatch(edges: DataFrame, implementations: DataFrame) -> DataFrame:
    """Edges (edge_id, from_uid, to_uid) into a declaration that has implementations
    (stub, uid), as sites with these as candidates."""
    each = _capped(implementations.select("stub", "uid"), ["stub"])
    return edges.select("edge_id", "from_uid", "to_uid").distinct().join(each, F.col("to_uid") == F.col("stub")).drop("stub")


def no_target(calls: DataFrame, callables: DataFrame) -> DataFrame:
    """Calls without target (call_id, member, language, args, bare) with the callables of
    that name (uid, name, language, required, most, method) that fit: the same language,
    a bare call names no method, and the arguments fit the parameters."""
    fits = (F.col("args") >= F.col("required")) & F.coalesce(F.col("args") <= F.col("most"), F.lit(True))
    # Callables alike fit the same calls, so the first of them are enough, and calls alike
    # have the same candidates.
    shape = ["member", "language", "required", "most", "method"]
    order = Window.partitionBy(*shape).orderBy("uid")
    first = callables.withColumnRenamed("name", "member").select(*shape, "uid").distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= CANDIDATE_CAP + 1).drop("_n")
    ask = ["member", "language", "args", "bare"]
    named = calls.select(*ask).distinct().join(first, ["member", "language"]).where(fits & ~(F.col("bare") & F.col("method")))
    found = _capped(named, ask).withColumnsRenamed({c: f"_{c}" for c in ask})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ask]
    each = calls.select("call_id", *ask).distinct().join(found, same).groupBy("call_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("candidates")))).alias("all"), F.bool_or("truncated").alias("truncated"))
    return each.select("call_id", F.slice("all", 1, CANDIDATE_CAP).alias("candidates"), (F.col("truncated") | (F.size("all") > CANDIDATE_CAP)).alias("truncated"))


def compose(sites: DataFrame, implementations: DataFrame, depth: int = 2) -> DataFrame:
    """site_id, uid, depth: candidates, and the implementations of candidates that are
    themselves declarations, up to a depth."""
    level = sites.select("site_id", F.explode("candidates").alias("uid")).withColumn("depth", F.lit(0))
    found = level
    step = implementations.select(F.col("stub").alias("uid"), F.col("uid").alias("next"))
    for d in range(1, depth + 1):
        level = level.join(step, "uid").select("site_id", F.col("next").alias("uid"), F.lit(d).alias("depth")).distinct()
        found = found.unionByName(level)
    return found.groupBy("site_id", "uid").agg(F.min("depth").alias("depth"))


def mark_tests(sites: DataFrame, test_symbols: DataFrame) -> DataFrame:
    """site_id, test_only: candidates that are test code, for owners that are not."""
    tests = test_symbols.select(F.col("uid").alias("owner_uid"))
    product = sites.join(tests, "owner_uid", "left_anti").select("site_id", F.explode("candidates").alias("uid"))
    return product.join(test_symbols.select("uid"), "uid", "left_semi").groupBy("site_id").agg(F.array_sort(F.collect_set("uid")).alias("test_only"))
