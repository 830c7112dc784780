"""The code graph: tier views, materialized edges, bounded traversal, families.

Edges: edge_id, from_uid, to_uid, kind, tier (0 proven, 1 inferred, 2 possible), and any
other columns. Traversals run level by level; a level is one join of the frontier with
the edges. The work bound of ``reach`` (edges looked at) bounds every frontier, so there a
frontier may be broadcast and numbered in one task; without that bound it is neither.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.lineage import cut

PROVEN, INFERRED, POSSIBLE = 0, 1, 2
# Edge kinds by group.
EXECUTION = ["calls", "constructor", "invoked_callback", "property_get", "awaits", "iterates", "stub_implementation"]
DEFERRED = ["creates_generator", "creates_coroutine"]
INFERRED_KINDS = ["inferred_dispatch", "inferred_call", "inferred_callback", "inferred_implicit"]
POSSIBLE_KINDS = ["possible_link"]
REFERENCE = ["references", "passes_callback", "writes", "imports", "reexports"]
FAMILY = ["overrides", "implements"]
BRIDGE = ["bridge"]
# Default bounds.
MAX_DEPTH, MAX_WORK, MAX_PATHS, MAX_FAMILY = 64, 100_000, 100, 64
INFERRED_OF = {"dispatch": "inferred_dispatch", "callback": "inferred_callback", "implicit": "inferred_implicit"}


def kinds_for(include: int) -> list[str]:
    """Edge kinds that a view at a tier follows."""
    kinds = EXECUTION + BRIDGE
    if include >= INFERRED:
        kinds = kinds + DEFERRED + INFERRED_KINDS
    if include >= POSSIBLE:
        kinds = kinds + POSSIBLE_KINDS
    return kinds


def in_view(edges: DataFrame, include: int, bridges: bool = True) -> DataFrame:
    kinds = [k for k in kinds_for(include) if bridges or k not in BRIDGE]
    return edges.where((F.col("tier") <= include) & F.col("kind").isin(kinds))


def proven_by_receiver() -> Column:
    """A dispatch site whose receiver type is proven and whose one flow candidate is the decision."""
    one = F.size("flow_candidates") == 1
    return F.coalesce((F.col("category") == "dispatch") & F.col("receiver_exact") & F.col("via").isNull() & (F.col("status") == "decided") & one & (F.col("targets") == F.col("flow_candidates")) & F.array_contains("candidates", F.get("flow_candidates", F.lit(0))), F.lit(False))


def materialize(sites: DataFrame, decisions: DataFrame) -> DataFrame:
    """Edges of decided and undecided sites: from_uid, to_uid, kind, tier, site_id.

    Decided targets (within the candidates) become inferred edges, other candidates
    possible links; a receiver rule gives proven edges and nothing else; field writes
    never become possible.
    """
    s = sites.join(decisions.select("site_id", "status", "targets"), "site_id", "left")
    by_rule = proven_by_receiver()
    chosen = F.when(F.col("status") == "decided", F.array_intersect("targets", "candidates")).otherwise(F.expr("cast(array() as array<string>)"))
    kind = F.lit("inferred_call")
    for category, name in INFERRED_OF.items():
        kind = F.when(F.col("category") == category, name).otherwise(kind)
    write = F.coalesce(F.col("operation") == "field_write", F.lit(False))
    rule_kind = F.when(F.col("activation").isin(EXECUTION), F.col("activation")).otherwise("calls")
    s = s.select("site_id", "owner_uid", by_rule.alias("by_rule"), "targets", "candidates", chosen.alias("chosen"), F.when(write, "inferred_write").otherwise(kind).alias("kind"), write.alias("write"), rule_kind.alias("rule_kind"))
    proven = s.where("by_rule").select("site_id", "owner_uid", F.explode(F.array_distinct("targets")).alias("to_uid"), F.col("rule_kind").alias("kind"), F.lit(PROVEN).alias("tier"))
    inferred = s.where("not by_rule").select("site_id", "owner_uid", F.explode(F.array_distinct("chosen")).alias("to_uid"), "kind", F.lit(INFERRED).alias("tier"))
    possible = s.where("not by_rule and not write").select("site_id", "owner_uid", F.explode(F.array_except("candidates", "chosen")).alias("to_uid"), F.lit("possible_link").alias("kind"), F.lit(POSSIBLE).alias("tier"))
    return proven.unionByName(inferred).unionByName(possible).select(F.col("owner_uid").alias("from_uid"), "to_uid", "kind", "tier", "site_id")


def tier_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("tier").agg(F.count("*").alias("n_edges"))


def site_edge_counts(sites: DataFrame, decisions: DataFrame) -> DataFrame:
    """Inferred and possible edges per category, from array sizes alone."""
    s = sites.join(decisions.select("site_id", "status", "targets"), "site_id", "left")
    chosen = F.when(F.col("status") == "decided", F.array_intersect("targets", "candidates")).otherwise(F.expr("cast(array() as array<string>)"))
    s = s.withColumn("chosen", chosen)
    return s.groupBy("category").agg(F.sum(F.size("chosen")).alias("inferred"), F.sum(F.size(F.array_except("candidates", "chosen"))).alias("possible"))


def callers(edges: DataFrame, include: int) -> DataFrame:
    """Distinct callers of each node, itself left out."""
    view = in_view(edges, include).where("from_uid <> to_uid")
    return view.groupBy(F.col("to_uid").alias("uid")).agg(F.count_distinct("from_uid").alias("callers"))


def calls(edges: DataFrame, include: int, site: list[str]) -> DataFrame:
    """Distinct outgoing sites of each node; ``site`` are the columns that tell sites apart."""
    return in_view(edges, include).groupBy(F.col("from_uid").alias("uid")).agg(F.count_distinct(*site).alias("calls"))


def hubs(edges: DataFrame, include: int, limit: int = 10) -> DataFrame:
    return callers(edges, include).orderBy(F.desc("callers"), "uid").limit(limit)


def sort_edges(edges: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One edge per key, the first by ``order``."""
    first = Window.partitionBy(*key).orderBy(*order)
    return edges.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


@dataclass
class Reach:
    """Nodes (uid, distance, position) in discovery order, traversed edges, and what stopped it."""

    nodes: DataFrame
    edges: DataFrame
    work: int
    depth_hit: bool
    work_hit: bool


def _numbered(rows: DataFrame, by: str, first: int, name: str) -> DataFrame:
    """Rows numbered from ``first`` in the order of ``by``: sorted in ranges over all tasks,
    then each range moved by the sizes of those before it."""
    place = cut(rows.orderBy(by).withColumn("_place", F.monotonically_increasing_id()))
    task = F.shiftright("_place", 33)
    starts = []
    for r in place.groupBy(task.alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect():
        starts.append((r["task"], first))
        first += r["n"]
    found = place.sparkSession.createDataFrame(starts, "_task long, _first long")
    at = F.col("_first") + F.col("_place").bitwiseAND((1 << 33) - 1)
    return place.withColumn("_task", task).join(F.broadcast(found), "_task").withColumn(name, at).drop("_task", "_first", "_place")


def reach(edges: DataFrame, starts: list[str], reverse: bool = False, include: int = INFERRED, max_depth: int = MAX_DEPTH, max_work: int | None = MAX_WORK, bridges: bool = True) -> Reach:
    """Breadth-first reach from several starts.

    Distances and discovery order follow a queue: nodes of a level in order, their
    edges by edge_id. ``depth_hit`` only if an unseen node lies beyond the depth;
    ``work_hit`` if an edge was left unread. ``max_work`` None: every edge is read, and
    levels are joined and numbered as their sizes ask for.
    """
    spark = edges.sparkSession
    view = in_view(edges, include, bridges)
    here, there = ("to_uid", "from_uid") if reverse else ("from_uid", "to_uid")
    steps = view.select(F.col("edge_id"), F.col(here).alias("uid"), F.col(there).alias("other"))
    first = list(dict.fromkeys(starts))
    seen = spark.createDataFrame([(u, 0, i) for i, u in enumerate(first)], "uid string, distance int, position long")
    frontier, used, work, depth, count = seen, None, 0, 0, len(first)
    depth_hit = work_hit = False
    small = F.broadcast if max_work is not None else lambda df: df
    while True:
        around = small(frontier.select("uid", "position")).join(steps, "uid")
        level = cut(around if max_work is None else around.orderBy("position", "edge_id").limit(max_work - work + 1))
        n = level.count()
        if max_work is not None and work + n > max_work:
            work_hit, n = True, max_work - work
            level = level.orderBy("position", "edge_id").limit(n)
        unseen = level.join(small(seen.select(F.col("uid").alias("other"))), "other", "left_anti")
        work += n
        if depth >= max_depth:
            depth_hit = not unseen.isEmpty()
            break
        used = level.select("edge_id") if used is None else used.unionByName(level.select("edge_id"))
        if not n:
            break
        found = unseen.groupBy("other").agg(F.min(F.struct("position", "edge_id")).alias("by"))
        if max_work is None:
            placed = _numbered(found, "by", count, "position")
        else:
            placed = found.withColumn("position", (F.row_number().over(Window.orderBy("by")) - 1 + count).cast("long"))
        frontier = cut(placed.select(F.col("other").alias("uid"), F.lit(depth + 1).alias("distance"), "position"))
        new = frontier.count()
        seen = cut(seen.unionByName(frontier))
        count, depth = count + new, depth + 1
        if not new or work_hit:
            break
    edges_used = used.distinct() if used is not None else edges.where("false").select("edge_id")
    return Reach(seen, edges_used, work, depth_hit, work_hit)


def find_path(edges: DataFrame, source: str, target: str, include: int = INFERRED, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, bool]:
    """Hops (hop, from_uid, to_uid, edge_id, kind, tier) of the shortest path, and whether
    the depth ended the search while nodes were left to go on from. Ties go to the
    earlier node and edge. Empty if there is no path, or for a path to itself.

    Levels and the nodes seen are joined as their sizes ask for, not broadcast by force.
    """
    spark = edges.sparkSession
    view = in_view(edges, include)
    none = view.where("false").select(F.lit(0).alias("hop"), "from_uid", "to_uid", "edge_id", "kind", "tier")
    if source == target:
        return none, False
    frontier = spark.createDataFrame([(source, 0)], "uid string, position long")
    seen, parents = frontier.select("uid"), []
    for depth in range(max_depth):
        near = view.join(frontier, F.col("uid") == F.col("from_uid")).join(seen.select(F.col("uid").alias("to_uid")), "to_uid", "left_anti")
        best = near.groupBy("to_uid").agg(F.min(F.struct("position", "edge_id", "from_uid", "kind", "tier")).alias("by"))
        # Numbers rise with the order of a distributed sort; they need not be dense.
        level = cut(best.orderBy("by.position", "by.edge_id").select(F.col("to_uid").alias("uid"), F.col("by.from_uid").alias("from_uid"), F.col("by.edge_id").alias("edge_id"), F.col("by.kind").alias("kind"), F.col("by.tier").alias("tier"), F.monotonically_increasing_id().alias("position")))
        parents.append(level)
        if not level.where(F.col("uid") == target).isEmpty():
            hops, at = [], target
            for d in range(depth, -1, -1):
                row = parents[d].where(F.col("uid") == at).first()
                hops.append((d, row["from_uid"], at, row["edge_id"], row["kind"], row["tier"]))
                at = row["from_uid"]
            return spark.createDataFrame(hops[::-1], "hop int, from_uid string, to_uid string, edge_id long, kind string, tier int"), False
        if level.isEmpty():
            return none, False
        frontier = level.select("uid", "position")
        seen = seen.unionByName(level.select("uid"))
    beyond = view.join(frontier, F.col("uid") == F.col("from_uid"), "left_semi").join(seen.select(F.col("uid").alias("to_uid")), "to_uid", "left_anti")
    return none, not beyond.isEmpty()


def shortest_path(edges: DataFrame, source: str, target: str, include: int = INFERRED, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The hops of ``find_path``."""
    return find_path(edges, source, target, include, max_depth)[0]


class Paths(NamedTuple):
    """Paths (path_no, nodes) and the bounds that ended the search early."""

    paths: DataFrame
    depth_hit: bool
    work_hit: bool
    paths_hit: bool


def find_paths(edges: DataFrame, source: str, target: str, include: int = INFERRED, max_depth: int = MAX_DEPTH, max_paths: int = MAX_PATHS, max_work: int = MAX_WORK) -> Paths:
    """Simple paths, shortest first, then by their edges in order.

    Parallel edges count once, as the first of them. ``max_work`` bounds the
    extensions of paths over all levels; where it cuts a level, the extensions that come
    first by their edges stay. ``depth_hit``: a path at the depth could go on;
    ``work_hit``: an extension was left out; ``paths_hit``: a further path was found, or
    one was still open when there were enough.
    """
    spark = edges.sparkSession
    view = in_view(edges, include).groupBy("from_uid", "to_uid").agg(F.min("edge_id").alias("edge_id"))
    alive = spark.createDataFrame([([source], [])], "nodes array<string>, via array<long>")
    done = [alive.where(F.lit(source == target))]
    found, work = int(source == target), 0
    depth_hit = work_hit = open_ = False
    for depth in range(max_depth + 1 if source != target else 0):
        grown = alive.withColumn("from_uid", F.element_at("nodes", -1)).join(view, "from_uid").where(~F.array_contains("nodes", F.col("to_uid")))
        if depth == max_depth:
            depth_hit = not grown.isEmpty()
            break
        made = grown.select(F.concat("nodes", F.array("to_uid")).alias("nodes"), F.concat("via", F.array("edge_id")).alias("via"))
        level = cut(made.orderBy("via").limit(max_work - work + 1))
        n = level.count()
        if work + n > max_work:
            work_hit, n = True, max_work - work
            level = cut(level.orderBy("via").limit(n))
        work += n
        ends = F.element_at("nodes", -1) == target
        done.append(level.where(ends))
        found += done[-1].count()
        alive = level.where(~ends)
        open_ = not alive.isEmpty()
        if work_hit or found >= max_paths or not open_:
            break
    paths = done[0]
    for more in done[1:]:
        paths = paths.unionByName(more)
    ranked = paths.orderBy(F.size("nodes"), "via").limit(max_paths)
    numbered = ranked.select((F.row_number().over(Window.orderBy(F.size("nodes"), "via"))).alias("path_no"), "nodes")
    return Paths(numbered, depth_hit, work_hit, found > max_paths or (found == max_paths and open_))


def all_paths(edges: DataFrame, source: str, target: str, include: int = INFERRED, max_depth: int = MAX_DEPTH, max_paths: int = MAX_PATHS) -> DataFrame:
    """The paths of ``find_paths``."""
    return find_paths(edges, source, target, include, max_depth, max_paths).paths


def weakest_tier(hops: DataFrame) -> DataFrame:
    return hops.agg(F.coalesce(F.max("tier"), F.lit(0)).alias("tier"))


def reaching_edges(edges: DataFrame, found: Reach, include: int) -> DataFrame:
    """Best edge into each reached node: by tier, order of the node it comes from, edge."""
    near = found.nodes.select(F.col("uid").alias("from_uid"), "position", F.col("distance").alias("d_from"))
    into = found.nodes.select(F.col("uid").alias("to_uid"), F.col("distance").alias("d_to"))
    steps = in_view(edges, include).select("from_uid", "to_uid", "edge_id", "tier").join(near, "from_uid").join(into, "to_uid").where("d_from + 1 = d_to")
    return steps.groupBy("to_uid").agg(F.min(F.struct("tier", "position", "edge_id", "from_uid")).alias("b")).select(F.col("to_uid").alias("uid"), F.col("b.from_uid").alias("from_uid"), F.col("b.edge_id").alias("edge_id"), F.col("b.tier").alias("tier"))


def entry_points(edges: DataFrame, include: int) -> DataFrame:
    """Nodes that call others and that nobody calls."""
    view = in_view(edges, include).where("from_uid <> to_uid")
    return view.select(F.col("from_uid").alias("uid")).distinct().join(view.select(F.col("to_uid").alias("uid")), "uid", "left_anti")


def family_closure(edges: DataFrame, start: str, limit: int = MAX_FAMILY, kinds: list[str] = FAMILY) -> tuple[DataFrame, bool]:
    """Members (uid, position) linked by family edges in either direction, breadth first
    by uid, and whether the limit cut them."""
    spark = edges.sparkSession
    links = edges.where(F.col("kind").isin(kinds)).select("from_uid", "to_uid")
    both = links.unionByName(links.select(F.col("to_uid").alias("from_uid"), F.col("from_uid").alias("to_uid"))).distinct()
    members, frontier = [start], [start]
    while frontier and len(members) <= limit:
        at = spark.createDataFrame([(u, i) for i, u in enumerate(frontier)], "from_uid string, position int")
        known = spark.createDataFrame([(u,) for u in members], "to_uid string")
        near = both.join(F.broadcast(at), "from_uid").join(F.broadcast(known), "to_uid", "left_anti")
        rows = near.groupBy("to_uid").agg(F.min("position").alias("position")).orderBy("position", "to_uid").limit(limit + 1).collect()
        frontier = [r["to_uid"] for r in rows]
        members += frontier
    kept = members[: max(limit, 1)]
    return spark.createDataFrame([(u, i) for i, u in enumerate(kept)], "uid string, position int"), len(members) > len(kept)


def undecided_between(edges: DataFrame, sites: DataFrame, source: str, target: str, include: int = INFERRED, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Sites that may close a gap: the owner is reached from the source and an option reaches the target."""
    ahead = reach(edges, [source], False, include, max_depth).nodes.select(F.col("uid").alias("owner_uid"))
    back = reach(edges, [target], True, include, max_depth).nodes.select(F.col("uid").alias("option"))
    options = sites.withColumn("option", F.explode(F.array_except("candidates", "test_only")))
    return options.join(ahead, "owner_uid", "left_semi").join(back, "option", "left_semi").select("site_id").distinct()


def impact(edges: DataFrame, targets: list[str], include: int = INFERRED, max_depth: int = MAX_DEPTH, cap: int = 200, max_work: int | None = MAX_WORK) -> DataFrame:
    """Transitive callers by (distance, uid), direct ones left out, and their total."""
    found = reach(edges, targets, True, include, max_depth, max_work).nodes
    direct = in_view(edges, include).where(F.col("to_uid").isin(targets)).select(F.col("from_uid").alias("uid"))
    rest = found.where("distance >= 2").join(direct, "uid", "left_anti")
    total = rest.count()
    return rest.orderBy("distance", "uid").limit(cap).select("uid", "distance", F.lit(total).alias("total"))
