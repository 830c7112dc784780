"""The user-visible reports, composed of the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import relations as L
from graphloom.operators import search as R


def symbols(table: DataFrame, query: str | None, fields: list[str], limit: int = 20, offset: int = 0) -> DataFrame:
    """uid, mode, total of a discovery page: exact names, else names that hold the query,
    else ranked by BM25; without a query all by uid. The total is counted before paging."""
    if query is None:
        found, mode = table.select("uid"), "all"
    else:
        found, mode = table.where(F.col("name") == query).select("uid"), "exact"
        if found.isEmpty():
            found, mode = table.where(F.contains(F.lower("name"), F.lower(F.lit(query)))).select("uid"), "name"
        if found.isEmpty():
            ranked = R.bm25(table, query, fields, limit=1_000_000)
            page = ranked.orderBy(F.desc("score"), "uid").offset(offset).limit(limit)
            return page.select("uid", F.lit("broad").alias("mode"), F.lit(ranked.count()).alias("total"))
    total = found.count()
    return found.orderBy("uid").offset(offset).limit(limit).select("uid", F.lit(mode).alias("mode"), F.lit(total).alias("total"))


def show(table: DataFrame, edges: DataFrame, references: DataFrame, include: int = G.INFERRED) -> DataFrame:
    """Per selector: its symbol (or how many it could be), with its callers and calls.
    Selectors of the same symbol are shown once."""
    found = L.select(references, table)
    once = found.withColumn("_n", F.row_number().over(Window.partitionBy(F.coalesce("uid", "ref")).orderBy("ref"))).where("_n = 1")
    callers, calls = G.callers(edges, include), G.calls(edges, include, ["to_uid"])
    out = once.join(callers, "uid", "left").join(calls, "uid", "left")
    known = F.col("uid").isNotNull()
    return out.select("ref", "uid", "n", F.when(known, F.coalesce("callers", F.lit(0))).alias("callers"), F.when(known, F.coalesce("calls", F.lit(0))).alias("calls"))


def context(edges: DataFrame, uid: str, include: int = G.INFERRED, deep: bool = False) -> DataFrame:
    """Neighbourhood of a symbol: role (caller, call, below), other, edge_id. Callers and
    calls are one row per site; below are the callees of callees (all with ``deep``)."""
    view = G.in_view(edges, include)
    callers = view.where(F.col("to_uid") == uid).select(F.lit("caller").alias("role"), F.col("from_uid").alias("other"), "edge_id")
    calls = view.where(F.col("from_uid") == uid).select(F.lit("call").alias("role"), F.col("to_uid").alias("other"), "edge_id")
    below = G.reach(edges, [uid], include=include, max_depth=G.MAX_DEPTH if deep else 2).nodes.where("distance >= 2")
    return callers.unionByName(calls).unionByName(below.select(F.lit("below").alias("role"), F.col("uid").alias("other"), F.lit(None).cast("long").alias("edge_id")))


def uses(edges: DataFrame, uid: str, family: DataFrame) -> DataFrame:
    """Rows of uses of a symbol and its family: other, kind, tier, edge_id; proven and
    inferred ones only, never possible links."""
    members = family.select(F.col("uid").alias("to_uid"))
    rows = edges.where(F.col("tier") <= G.INFERRED).where(F.col("kind") != "possible_link").join(F.broadcast(members), "to_uid", "left_semi")
    return rows.select(F.col("from_uid").alias("other"), L.use_kind(F.col("kind")).alias("use"), "tier", "edge_id")


def dependencies(edges: DataFrame, uid: str, include: int = G.INFERRED, max_depth: int = G.MAX_DEPTH) -> DataFrame:
    """uid, distance and the best edge that reaches each dependency."""
    found = G.reach(edges, [uid], include=include, max_depth=max_depth)
    best = G.reaching_edges(edges, found, include)
    return found.nodes.where("distance > 0").join(best, "uid").select("uid", "distance", "from_uid", "edge_id", "tier")


def path(edges: DataFrame, source: str, target: str, include: int = G.INFERRED, max_depth: int = G.MAX_DEPTH) -> DataFrame:
    """Hops of the shortest path with the path's weakest tier."""
    hops = G.shortest_path(edges, source, target, include, max_depth)
    return hops.withColumn("weakest", F.max("tier").over(Window.partitionBy(F.lit(0)))) if not hops.isEmpty() else hops.withColumn("weakest", F.lit(0))


def evidence(edges: DataFrame, uid: str) -> DataFrame:
    """All links of a symbol in both directions, over all tiers."""
    out = edges.where(F.col("from_uid") == uid).select(F.lit("out").alias("side"), F.col("to_uid").alias("other"), "kind", "tier", "edge_id")
    into = edges.where(F.col("to_uid") == uid).select(F.lit("in").alias("side"), F.col("from_uid").alias("other"), "kind", "tier", "edge_id")
    return out.unionByName(into).orderBy("tier", "edge_id", "other", "kind")


def status(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Counts of an index by section: tier, kind, language."""
    tiers = edges.groupBy(F.col("tier").cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit("tier").alias("section"), "key", "n")
    kinds = edges.groupBy(F.col("kind").alias("key")).agg(F.count("*").alias("n")).select(F.lit("kind").alias("section"), "key", "n")
    languages = files.groupBy(F.col("language").alias("key")).agg(F.count("*").alias("n")).select(F.lit("language").alias("section"), "key", "n")
    return tiers.unionByName(kinds).unionByName(languages)


def tests_of(mentions: DataFrame, distances: DataFrame, limit: int = 50) -> DataFrame:
    """test, distance, name: the most direct mention of a target's names in each test.
    ``mentions``: test, name; ``distances``: name, distance (0 the target, 1 callers)."""
    best = mentions.join(distances, "name").groupBy("test").agg(F.min(F.struct("distance", "name")).alias("b"))
    return best.select("test", F.col("b.distance").alias("distance"), F.col("b.name").alias("name")).orderBy("distance", "test").limit(limit)
