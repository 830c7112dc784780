"""Queries of the graph, decision and set operators (families D, F, G, I, J, O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import decide as D
from graphloom.operators import graph as G
from graphloom.operators.lineage import cut
from graphloom.plans import adapters as A
from graphloom.plans.registry import query

E1 = f"WITH RECURSIVE {A.EDGES_SQL}, {A.view_sql(1)}"
SCHEMA_VIEW = "SELECT edge_id, from_uid, to_uid, kind, tier FROM view"


@query("D1_kinds_for", "SELECT * FROM (VALUES " + ", ".join(f"({t}, '{k}')" for t in (0, 1, 2) for k in G.kinds_for(t)) + ") v(tier, kind)")
def _d1(t):
    return t.spark.createDataFrame([(tier, k) for tier in (0, 1, 2) for k in G.kinds_for(tier)], "tier int, kind string")


@query("D2_in_view", f"WITH {A.EDGES_SQL}, {A.view_sql(1)} {SCHEMA_VIEW}")
def _d2(t):
    return G.in_view(A.edges(t), G.INFERRED)


@query("D3_set_bridges", f"WITH {A.EDGES_SQL}, {A.view_sql(2)} {SCHEMA_VIEW} WHERE kind <> 'bridge'")
def _d3(t):
    return G.in_view(A.edges(t), G.POSSIBLE, bridges=False)


@query("F1_counts", f"WITH {A.EDGES_SQL} SELECT tier, count(*) AS n_edges FROM edges GROUP BY tier")
def _f1(t):
    return G.tier_counts(A.edges(t))


@query("F3_callers", f"WITH {A.EDGES_SQL}, {A.view_sql(1)} SELECT to_uid AS uid, count(DISTINCT from_uid) AS callers FROM view WHERE from_uid <> to_uid GROUP BY to_uid")
def _f3(t):
    return G.callers(A.edges(t), G.INFERRED)


@query("F4_calls", f"WITH {A.EDGES_SQL}, {A.view_sql(1)} SELECT from_uid AS uid, count(DISTINCT to_uid) AS calls FROM view GROUP BY from_uid")
def _f4(t):
    return G.calls(A.edges(t), G.INFERRED, ["to_uid"])


@query("F8_overview_hubs", f"WITH {A.EDGES_SQL}, {A.view_sql(1)} SELECT to_uid AS uid, count(DISTINCT from_uid) AS callers FROM view WHERE from_uid <> to_uid GROUP BY to_uid ORDER BY callers DESC, uid LIMIT 10")
def _f8(t):
    return G.hubs(A.edges(t), G.INFERRED)


@query("G2_first_edges", f"WITH {A.EDGES_SQL}, {A.view_sql(1)} SELECT to_uid, from_uid, edge_id, kind, tier FROM (SELECT *, row_number() OVER (PARTITION BY to_uid ORDER BY tier, edge_id) AS n FROM view) WHERE n = 1")
def _g2(t):
    return G.sort_edges(G.in_view(A.edges(t), G.INFERRED), ["to_uid"], ["tier", "edge_id"]).select("to_uid", "from_uid", "edge_id", "kind", "tier")


@query("G7_sort_edges", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1")
def _g7(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return G.sort_edges(rows, ["l_orderkey", "l_partkey"], ["l_linenumber", "l_suppkey", "l_extendedprice"])


_STARTS = [f"order:{k}" for k in range(0, 15000, 500)]
_starts_sql = ", ".join(f"('{s}')" for s in _STARTS)


@query("J2_reach_many", f"{E1}, r(uid, d) AS (SELECT s, 0 FROM (VALUES {_starts_sql}) x(s) UNION SELECT to_uid, d + 1 FROM r JOIN view ON from_uid = uid WHERE d < 4) SELECT uid, min(d) AS distance FROM r GROUP BY uid")
def _j2(t):
    return G.reach(A.edges(t), _STARTS, max_depth=4).nodes.select("uid", "distance")


@query("J3_reach_reverse", f"{E1}, r(uid, d) AS (SELECT 'region:2', 0 UNION SELECT from_uid, d + 1 FROM r JOIN view ON to_uid = uid WHERE d < 3) SELECT uid, min(d) AS distance FROM r GROUP BY uid")
def _j3(t):
    return G.reach(A.edges(t), ["region:2"], reverse=True, max_depth=3, max_work=None).nodes.select("uid", "distance")


@query("J4_shortest_path", f"{E1}, r(uid, d, p) AS (SELECT 'order:2', 0, ['order:2'] UNION ALL SELECT to_uid, d + 1, list_append(p, to_uid) FROM r JOIN view ON from_uid = uid WHERE d < 6 AND NOT list_contains(p, to_uid)), b AS (SELECT p FROM r WHERE starts_with(uid, 'region:') ORDER BY d, uid LIMIT 1) SELECT CAST(i - 1 AS INT) AS hop, p[i] AS from_uid, p[i + 1] AS to_uid FROM (SELECT p, unnest(range(1, len(p))) AS i FROM b)")
def _j4(t):
    edges = A.edges(t)
    first = G.reach(edges, ["order:2"], max_depth=6).nodes.where("uid like 'region:%'").orderBy("distance", "uid").first()
    return G.shortest_path(edges, "order:2", first["uid"] if first else "none", max_depth=6).select("hop", "from_uid", "to_uid")


@query("J5_all_paths", f"WITH RECURSIVE {A.EDGES_SQL}, {A.view_sql(2)}, r(uid, p) AS (SELECT 'customer:0', ['customer:0'] UNION ALL SELECT to_uid, list_append(p, to_uid) FROM r JOIN (SELECT DISTINCT from_uid, to_uid FROM view) ON from_uid = uid WHERE len(p) <= 8 AND uid <> 'nation:8' AND NOT list_contains(p, to_uid)) SELECT array_to_string(p, '>') AS nodes FROM r WHERE uid = 'nation:8'")
def _j5(t):
    return G.all_paths(A.edges(t), "customer:0", "nation:8", G.POSSIBLE, max_depth=8).select(F.array_join("nodes", ">").alias("nodes"))


@query("J6_family_closure", f"WITH RECURSIVE {A.EDGES_SQL}, f AS (SELECT from_uid AS a, to_uid AS b FROM edges WHERE kind IN ('overrides', 'implements') UNION SELECT to_uid, from_uid FROM edges WHERE kind IN ('overrides', 'implements')), r(uid) AS (SELECT 'nation:3' UNION SELECT b FROM r JOIN f ON a = uid) SELECT uid FROM r")
def _j6(t):
    return G.family_closure(A.edges(t), "nation:3", limit=10_000)[0].select("uid")


@query("J8_entry_points", f"WITH {A.EDGES_SQL}, {A.view_sql(1)} SELECT DISTINCT from_uid AS uid FROM view WHERE from_uid <> to_uid AND from_uid NOT IN (SELECT to_uid FROM view WHERE from_uid <> to_uid)")
def _j8(t):
    return G.entry_points(A.edges(t), G.INFERRED)


@query("H9_impact", f"{E1}, r(uid, d) AS (SELECT 'nation:4', 0 UNION SELECT from_uid, d + 1 FROM r JOIN view ON to_uid = uid WHERE d < 5), m AS (SELECT uid, min(d) AS distance FROM r GROUP BY uid), k AS (SELECT * FROM m WHERE distance >= 2 AND uid NOT IN (SELECT from_uid FROM view WHERE to_uid = 'nation:4')) SELECT uid, distance, (SELECT count(*) FROM k) AS total FROM k ORDER BY distance, uid LIMIT 200")
def _h9(t):
    return G.impact(A.edges(t), ["nation:4"], max_depth=5, max_work=None)


@query("G1_reaching_edges", f"{E1}, r(uid, d) AS (SELECT 'region:1', 0 UNION SELECT from_uid, d + 1 FROM r JOIN view ON to_uid = uid WHERE d < 2), m AS (SELECT uid, min(d) AS d FROM r GROUP BY uid) SELECT a.uid, min(v.tier) AS tier FROM m a JOIN view v ON v.from_uid = a.uid JOIN m b ON b.uid = v.to_uid AND b.d + 1 = a.d GROUP BY a.uid")
def _g1(t):
    flipped = A.edges(t).select("edge_id", F.col("to_uid").alias("from_uid"), F.col("from_uid").alias("to_uid"), "kind", "tier")
    found = G.reach(flipped, ["region:1"], max_depth=2, max_work=None)
    return G.reaching_edges(flipped, found, G.INFERRED).select("uid", "tier")


@query("C13_weakest_tier", f"WITH {A.EDGES_SQL}, {A.view_sql(2)} SELECT coalesce(max(tier), 0) AS tier FROM view WHERE starts_with(from_uid, 'nation:')")
def _c13(t):
    return G.weakest_tier(G.in_view(A.edges(t), G.POSSIBLE).where("from_uid like 'nation:%'"))


@query("C12_tiers_used", f"WITH {A.EDGES_SQL}, {A.view_sql(2)} SELECT to_uid AS uid, array_to_string(list_sort(list_distinct(list(tier))), ',') AS tiers FROM view GROUP BY to_uid")
def _c12(t):
    used = G.in_view(A.edges(t), G.POSSIBLE).groupBy(F.col("to_uid").alias("uid")).agg(F.array_sort(F.collect_set("tier")).alias("tiers"))
    return used.select("uid", F.array_join(F.transform("tiers", lambda x: x.cast("string")), ",").alias("tiers"))


# decisions
OPTS = "list_filter(candidates, lambda c: NOT list_contains(test_only, c))"
_strong = "list_filter(o, lambda c: list_contains(flow_candidates, c) AND NOT list_contains(field_only, c))"
_class = "CAST(string_split(c, ':')[2] AS INT) % 2"
DECIDED = f"""{A.SITES_SQL}, s1 AS (SELECT *, {OPTS} AS o FROM sites), s2 AS (SELECT *, {_strong} AS st, list_distinct(list_transform(o, lambda c: {_class})) AS cl FROM s1),
d AS (SELECT *, CASE
  WHEN len(o) > 0 AND category = 'callback' AND library_runs IS NOT NULL THEN CASE WHEN library_runs THEN 'library_runs' ELSE 'library_unknown' END
  WHEN category = 'dispatch' AND receiver_exact AND len(flow_candidates) = 1 AND list_contains(o, flow_candidates[1]) THEN 'receiver_proven'
  WHEN category = 'dispatch' AND NOT receiver_exact AND NOT truncated AND len(st) > 0 THEN 'receiver_types'
  WHEN category <> 'dispatch' AND receiver_exact AND len(field_only) = 0 AND len(o) > 0 THEN 'receiver_contexts'
  WHEN category = 'no_target' AND len(o) >= 2 AND NOT truncated AND len(st) = 1 THEN 'unique_flow'
  WHEN category = 'dispatch' AND declared_target IS NULL AND declared_library IS NOT NULL AND len(o) > 0 THEN 'library_dispatch'
  WHEN len(o) = 1 AND list_contains(field_only, o[1]) THEN 'field_name_only' WHEN len(o) = 1 THEN 'one_candidate'
  WHEN len(o) = 0 AND len(candidates) > 0 THEN 'test_only'
  WHEN len(o) > 1 AND category = 'implicit' AND len(cl) = 1 AND NOT list_has_any(o, field_only) THEN 'one_protocol' ELSE 'not_unique' END AS reason FROM s2),
decisions AS MATERIALIZED (SELECT *, CASE WHEN reason IN ('library_runs', 'receiver_proven', 'receiver_types', 'receiver_contexts', 'unique_flow', 'one_candidate', 'one_protocol') THEN 'decided' ELSE 'unknown' END AS status,
  CASE WHEN reason IN ('library_runs', 'receiver_contexts', 'one_candidate', 'one_protocol') THEN o WHEN reason = 'receiver_proven' THEN flow_candidates WHEN reason IN ('receiver_types', 'unique_flow') THEN st ELSE [] END AS targets FROM d)"""


def _class_of(c):
    return F.split(c, ":")[1].cast("int") % 2


def _decided(t):
    """Sites and their decisions, as the stored tables they are."""
    sites = cut(A.sites(t))
    return sites, cut(D.decide(sites, _class_of))


@query("O15_decide", f"WITH {DECIDED} SELECT site_id, status, array_to_string(list_sort(targets), ',') AS targets, reason FROM decisions")
def _o15(t):
    return _decided(t)[1].withColumn("targets", F.array_join(F.array_sort("targets"), ","))


@query("O16_decide_site_arms", f"WITH {DECIDED} SELECT category, reason, count(*) AS n FROM decisions GROUP BY category, reason")
def _o16(t):
    sites, decisions = _decided(t)
    return decisions.join(sites.select("site_id", "category"), "site_id").groupBy("category", "reason").agg(F.count("*").alias("n"))


@query("O17_dispatch_by_receiver", f"WITH {DECIDED} SELECT site_id, array_to_string(list_sort(targets), ',') AS targets FROM decisions WHERE reason IN ('receiver_proven', 'receiver_types')")
def _o17(t):
    found = cut(A.sites(t)).select("site_id", D.dispatch_by_receiver().alias("targets")).where("targets is not null")
    return found.select("site_id", F.array_join(F.array_sort("targets"), ",").alias("targets"))


@query("O18_receiver_exact", f"WITH {A.SITES_SQL} SELECT site_id, category <> 'dispatch' AND receiver_exact AND len(field_only) = 0 AND len({OPTS}) > 0 AS exact FROM sites")
def _o18(t):
    return cut(A.sites(t)).select("site_id", D.receiver_exact().alias("exact"))


@query("O19_one_protocol", f"WITH {A.SITES_SQL} SELECT site_id, len(list_distinct(list_transform({OPTS}, lambda c: {_class}))) = 1 AS one FROM sites")
def _o19(t):
    return cut(A.sites(t)).select("site_id", D.one_protocol(_class_of).alias("one"))


@query("G11_unique_flow_target", f"WITH {A.SITES_SQL}, s1 AS (SELECT *, {OPTS} AS o FROM sites) SELECT site_id, ({_strong})[1] AS target FROM s1 WHERE category = 'no_target' AND len(o) >= 2 AND NOT truncated AND len({_strong}) = 1")
def _g11(t):
    return cut(A.sites(t)).select("site_id", D.unique_flow_target().alias("target")).where("target is not null")


@query("D4_proven_by_receiver_rule", f"WITH {DECIDED} SELECT site_id FROM decisions WHERE category = 'dispatch' AND receiver_exact AND via IS NULL AND status = 'decided' AND len(flow_candidates) = 1 AND targets = flow_candidates AND list_contains(candidates, flow_candidates[1])")
def _d4(t):
    sites, decisions = _decided(t)
    return sites.join(decisions, "site_id").where(G.proven_by_receiver()).select("site_id")


@query("D8_undecided", f"WITH {DECIDED} SELECT a.site_id FROM decisions a LEFT JOIN decisions p ON p.site_id = a.via WHERE len(a.o) > 0 AND a.status <> 'decided' AND (a.via IS NULL OR p.status = 'decided')")
def _d8(t):
    return D.undecided(*_decided(t))


@query("D9_dispatch_like", f"WITH {A.SITES_SQL} SELECT site_id FROM sites WHERE category IN ('dispatch', 'flow_call', 'override')")
def _d9(t):
    return A.sites(t).where(D.dispatch_like()).select("site_id")


@query("D10_options", f"WITH {A.SITES_SQL} SELECT site_id, array_to_string({OPTS}, ',') AS options FROM sites")
def _d10(t):
    return A.sites(t).select("site_id", F.array_join(D.options(), ",").alias("options"))


MATERIALIZED = f"""{DECIDED}, r AS (SELECT *, category = 'dispatch' AND receiver_exact AND via IS NULL AND status = 'decided' AND len(flow_candidates) = 1 AND targets = flow_candidates AND list_contains(candidates, flow_candidates[1]) AS by_rule,
  CASE WHEN operation = 'field_write' THEN 'inferred_write' WHEN category IN ('dispatch', 'callback', 'implicit') THEN 'inferred_' || category ELSE 'inferred_call' END AS ik FROM decisions),
made AS (SELECT owner_uid AS from_uid, unnest(targets) AS to_uid, CASE WHEN activation IN ('calls', 'awaits') THEN activation ELSE 'calls' END AS kind, 0 AS tier, site_id FROM r WHERE by_rule
  UNION ALL SELECT owner_uid, unnest(list_distinct(targets)), ik, 1, site_id FROM r WHERE NOT by_rule AND status = 'decided'
  UNION ALL SELECT owner_uid, unnest(list_filter(candidates, lambda c: NOT list_contains(CASE WHEN status = 'decided' THEN targets ELSE [] END, c))), 'possible_link', 2, site_id FROM r WHERE NOT by_rule AND operation <> 'field_write')"""


@query("I1_materialize_site", f"WITH {MATERIALIZED} SELECT * FROM made")
def _i1(t):
    return G.materialize(*_decided(t))


@query("J1_graph_edges", f"WITH {A.EDGES_SQL}, {MATERIALIZED} SELECT kind, tier, count(*) AS n FROM (SELECT from_uid, to_uid, kind, tier FROM edges UNION ALL SELECT from_uid, to_uid, kind, tier FROM made) GROUP BY kind, tier")
def _j1(t):
    every = A.edges(t).select("from_uid", "to_uid", "kind", "tier").unionByName(G.materialize(*_decided(t)).select("from_uid", "to_uid", "kind", "tier"))
    return every.groupBy("kind", "tier").agg(F.count("*").alias("n"))


@query("F2_edge_counts", f"WITH {DECIDED} SELECT category, sum(CASE WHEN status = 'decided' THEN len(targets) ELSE 0 END) AS inferred, sum(len(candidates) - CASE WHEN status = 'decided' THEN len(targets) ELSE 0 END) AS possible FROM decisions GROUP BY category")
def _f2(t):
    return G.site_edge_counts(*_decided(t))


@query("H7_finish_candidates", "SELECT l_partkey, array_to_string(c[1:20], ',') AS candidates, len(c) > 20 AS truncated FROM (SELECT l_partkey, list_sort(list_distinct(list('s' || l_suppkey))) AS c FROM lineitem GROUP BY l_partkey)")
def _h7(t):
    made = t.lineitem.groupBy("l_partkey").agg(D.finish_candidates(F.collect_list(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))).alias("c"))
    return made.select("l_partkey", F.array_join("c.candidates", ",").alias("candidates"), "c.truncated")


@query("I7_merge_subset", f"WITH {A.SITES_SQL} SELECT site_id, array_to_string(list_filter(candidates, lambda c: list_contains(flow_candidates, c) OR list_contains(test_only, c)), ',') AS merged FROM sites")
def _i7(t):
    return A.sites(t).select("site_id", F.array_join(D.merge_subset(F.col("flow_candidates"), F.col("test_only"), F.col("candidates")), ",").alias("merged"))


@query("I3_undecided_between", f"""WITH RECURSIVE {A.EDGES_SQL}, {A.view_sql(1)}, {A.SITES_SQL}, a(uid, d) AS (SELECT * FROM (VALUES ('order:2', 0)) UNION SELECT to_uid, d + 1 FROM a JOIN view ON from_uid = uid WHERE d < 3)
SELECT DISTINCT site_id FROM sites WHERE owner_uid IN (SELECT uid FROM a) AND list_contains({OPTS}, (SELECT candidates[1] FROM sites WHERE owner_uid = 'order:2'))""")
def _i3(t):
    sites = cut(A.sites(t))
    target = sites.where("owner_uid = 'order:2'").first()["candidates"][0]
    return G.undecided_between(A.edges(t), sites, "order:2", target, max_depth=3)
