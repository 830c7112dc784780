"""Facts about libraries: precision of derived ones, unique look-ups, cache eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: precision from which derived facts of a language count.
GATE = 0.9


def precision(labels: DataFrame) -> DataFrame:
    """language, precision, passed of labelled facts (language, verdict: correct, wrong, undecided)."""
    decided = F.count_if(F.col("verdict") != "undecided")
    rate = F.when(decided > 0, F.count_if(F.col("verdict") == "correct") / decided).otherwise(0.0)
    return labels.groupBy("language").agg(rate.alias("precision")).withColumn("passed", F.col("precision") >= GATE)


def unique_index(declarations: DataFrame) -> DataFrame:
    """(module, name, arity) keys that exactly one declaration has, with its uid."""
    return declarations.groupBy("module", "name", "arity").agg(F.count("*").alias("_n"), F.min("uid").alias("uid")).where("_n = 1").drop("_n")


def behaviours(requests: DataFrame, derived: DataFrame, declared: DataFrame, table: DataFrame) -> DataFrame:
    """request_id, effect, source: the first of derived, declared and table effects of a symbol."""
    out = requests
    for name, facts in (("derived", derived), ("declared", declared), ("table", table)):
        out = out.join(facts.select("symbol", F.col("effect").alias(name)), "symbol", "left")
    effect = F.coalesce("derived", "declared", "table")
    source = F.when(F.col("derived").isNotNull(), "derived").when(F.col("declared").isNotNull(), "declared").when(F.col("table").isNotNull(), "table")
    return out.select("request_id", effect.alias("effect"), source.alias("source"))


def recount(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count_if(F.col("source") == "derived").alias("n_derived"), F.count_if(F.col("source") == "declared").alias("n_declared"), F.count_if(F.col("source") == "table").alias("n_table"), F.count("*").alias("n"))


def evict(entries: DataFrame, keep_bytes: int) -> DataFrame:
    """Entries (shard, key, used, size) that go so that each shard's newest stay within its bytes."""
    newest = Window.partitionBy("shard").orderBy(F.desc("used"), "key").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("_sum", F.sum("size").over(newest)).where(F.col("_sum") > keep_bytes).drop("_sum")
