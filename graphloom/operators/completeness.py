"""What a list of uses leaves open: states of occurrences, and a summary of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Evidence flags in the order in which they settle an occurrence, and the state they give.
ORDER = [
    ("is_row", "found"), ("is_declaration", "declaration"), ("linked_elsewhere", "elsewhere"), ("is_local", "elsewhere"),
    ("other_language", "elsewhere"), ("nearer_binding", "elsewhere"), ("arity_excluded", "elsewhere"), ("is_candidate", "unresolved"),
]


def state() -> Column:
    """struct(state, reason) of an occurrence: the first flag that holds decides."""
    out = F.struct(F.lit("unresolved").alias("state"), F.lit("name_only").alias("reason"))
    for flag, name in reversed(ORDER):
        out = F.when(F.coalesce(F.col(flag), F.lit(False)), F.struct(F.lit(name).alias("state"), F.lit(flag).alias("reason"))).otherwise(out)
    return out


def classify(occurrences: DataFrame) -> DataFrame:
    return occurrences.withColumn("_s", state()).select(*occurrences.columns, "_s.state", "_s.reason")


def summarize(classified: DataFrame, bounded: bool = False) -> DataFrame:
    """status (complete, partial, unknown) and the counts behind it."""
    open_ = F.count_if(F.col("state") == "unresolved")
    status = F.when(F.lit(bounded), "unknown").when(F.col("n_open") > 0, "partial").otherwise("complete")
    return classified.agg(F.count("*").alias("n"), open_.alias("n_open")).withColumn("status", status)


def rank_unresolved(classified: DataFrame) -> DataFrame:
    """Open occurrences with a rank: same module, then imports of the target, then name only."""
    group = F.when(F.col("same_module"), 0).when(F.col("imports_target"), 1).otherwise(2)
    rows = classified.where("state = 'unresolved'").withColumn("grp", group)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("grp", "path", "line", "occ_id")))


def resolution_health(calls: DataFrame) -> DataFrame:
    """Per language: resolved, unresolved, and the rate (three decimals; null without calls)."""
    out = calls.groupBy("language").agg(F.count_if("resolved").alias("n_resolved"), F.count_if(~F.col("resolved")).alias("n_unresolved"))
    total = F.col("n_resolved") + F.col("n_unresolved")
    return out.withColumn("rate", F.when(total > 0, F.round(F.col("n_resolved") / total, 3)))
