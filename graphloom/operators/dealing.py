"""Joins whose hot keys are dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one side that a unit of work holds of a key.
UNIT = 2_000


def deal(a: DataFrame, b: DataFrame, key: str, unit: int = UNIT, unit_b: int | None = None) -> DataFrame:
    """``a`` joined with ``b`` on ``key``. A key's rows are dealt into units of about ``unit``
    rows on each side (``unit_b`` on that of ``b``), by a hash of the whole row, and every unit
    of one side meets every unit of the other: no pair is lost or made twice, and no key is
    one task's work."""
    size = lambda df, name, rows: df.groupBy(key).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    units = size(a, "_na", unit).join(size(b, "_nb", unit_b or unit), key)
    own = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = a.join(units, key).withColumn("_ua", own(a, "_na")).withColumn("_ub", other("_nb")).drop("_na", "_nb")
    right = b.join(units, key).withColumn("_ub", own(b, "_nb")).withColumn("_ua", other("_na")).drop("_na", "_nb")
    return meet(left, right, [key, "_ua", "_ub"]).drop("_ua", "_ub")


def meet(left: DataFrame, right: DataFrame, at: list[str], least: int = 1) -> DataFrame:
    """Units of both sides joined on ``at``, by ``least`` tasks or more."""
    # A fixed number of partitions: their few rows make many, so they are not to be merged.
    parts = max(least, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return left.repartition(parts, *at).join(right.repartition(parts, *at).hint("shuffle_hash"), at)
