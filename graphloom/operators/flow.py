"""Value flow as a semi-naive fixpoint.

``facts``: slot, value. ``moves``: source, target (what the source slot may hold, the
target slot may hold). ``loads`` / ``stores``: slot, field, target / source: reading and
writing fields of the objects that a slot may hold. Each round joins only what is new;
a slot with more than ``cap`` values is widened: it takes no further ones and is flagged.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.lineage import cut

# Bounds of rounds and values of a slot.
MAX_ROUNDS, MAX_VALUES = 30, 64


def solve(facts: DataFrame, moves: DataFrame, loads: DataFrame | None = None, stores: DataFrame | None = None, rounds: int = MAX_ROUNDS, cap: int = MAX_VALUES) -> tuple[DataFrame, bool]:
    """(slot, value, round, saturated) of all slots, and whether the round bound was hit."""
    spark = facts.sparkSession
    none = lambda schema: spark.createDataFrame([], schema)
    loads = loads if loads is not None else none("slot string, field string, target string")
    stores = stores if stores is not None else none("slot string, field string, source string")
    field_slot = lambda obj, field: F.concat(F.lit("@"), obj, F.lit("."), field)
    new = cut(facts.select("slot", "value").distinct())
    known = new.withColumn("round", F.lit(0))
    edges = cut(moves.select("source", "target").distinct())
    for n in range(1, rounds + 1):
        # Objects that reached a slot open edges between it and their fields.
        reads = new.join(loads, "slot").select(field_slot("value", "field").alias("source"), "target")
        writes = new.join(stores, "slot").select("source", field_slot("value", "field").alias("target"))
        opened = cut(reads.unionByName(writes).distinct().join(edges, ["source", "target"], "left_anti"))
        along = new.join(edges, new["slot"] == edges["source"]).select(F.col("target").alias("slot"), "value")
        fresh = known.join(opened, known["slot"] == opened["source"]).select(F.col("target").alias("slot"), "value")
        found = along.unionByName(fresh).distinct().join(known.select("slot", "value"), ["slot", "value"], "left_anti")
        room = known.groupBy("slot").agg(F.count("*").alias("have"))
        order = Window.partitionBy("slot").orderBy("value")
        kept = found.join(room, "slot", "left").withColumn("_n", F.row_number().over(order)).where(F.col("_n") + F.coalesce("have", F.lit(0)) <= cap)
        new = cut(kept.select("slot", "value"))
        edges = cut(edges.unionByName(opened))
        if new.isEmpty() and opened.isEmpty():
            break
        known = cut(known.unionByName(new.withColumn("round", F.lit(n))))
    else:
        return _flag(known, cap), True
    return _flag(known, cap), False


def _flag(known: DataFrame, cap: int) -> DataFrame:
    return known.withColumn("saturated", F.count("*").over(Window.partitionBy("slot")) >= cap)


def call_targets(flow: DataFrame, calls: DataFrame) -> DataFrame:
    """site_id, target: functions that a called slot may hold. ``calls``: site_id, slot."""
    return calls.join(flow, "slot").select("site_id", F.col("value").alias("target")).distinct()


def consumed(uses: DataFrame, forwards: DataFrame, rounds: int | None = None) -> DataFrame:
    """Parameters that are used (called, iterated), also through parameters they are
    forwarded to, however far or by ``rounds`` steps: param, distance. ``uses``: param;
    ``forwards``: param, to_param."""
    level = cut(uses.select("param").distinct().withColumn("distance", F.lit(0)))
    known = level
    for n in count(1) if rounds is None else range(1, rounds + 1):
        found = forwards.join(level.select(F.col("param").alias("to_param")), "to_param").select("param").distinct()
        level = cut(found.join(known.select("param"), "param", "left_anti").withColumn("distance", F.lit(n)))
        if level.isEmpty():
            break
        known = cut(known.unionByName(level))
    return known
