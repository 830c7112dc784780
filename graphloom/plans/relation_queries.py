"""Queries of relations, hierarchies and report aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import paths as P
from graphloom.operators import hierarchy as Y
from graphloom.operators import relations as L
from graphloom.plans import adapters as A
from graphloom.plans.registry import query, scalar


def _case(x: str, table: dict[str, str], other: str = "") -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + (f" ELSE '{other}'" if other else "") + " END"


_EDGE_KIND = "element_at(array(" + ",".join(f"'{k}'" for k in [*L.USE_OF_EDGE, "calls"]) + f"), 1 + CAST(o_orderkey % {len(L.USE_OF_EDGE) + 1} AS INT))"
_REF_KIND = "element_at(array(" + ",".join(f"'{k}'" for k in L.USE_OF_REFERENCE) + f"), 1 + CAST(o_orderkey % {len(L.USE_OF_REFERENCE)} AS INT))"


def _choice(name: str, expression: str, function, sql: str) -> None:
    duck = expression.replace("element_at(array(", "([").replace("), 1 +", "])[1 +").replace(" AS INT))", " AS INT)]")
    query(name, f"SELECT o_orderkey, input, {sql.replace('{x}', 'input')} AS output FROM (SELECT o_orderkey, {duck} AS input FROM orders)")(
        lambda t: t.orders.select("o_orderkey", F.expr(expression).alias("input")).withColumn("output", function(F.col("input")))
    )


_choice("C8_use_kind", _EDGE_KIND, L.use_kind, _case("{x}", L.USE_OF_EDGE, "call"))
_choice("C9_ref_use_kind", _REF_KIND, L.ref_use_kind, _case("{x}", L.USE_OF_REFERENCE))
_choice("S14_use_edge_kind", _REF_KIND, L.use_edge_kind, _case("{x}", L.EDGE_OF_REFERENCE))
scalar("D5_is_synthetic", "part", "p_partkey", "CASE p_partkey % 3 WHEN 0 THEN '<module>' ELSE p_name END", L.is_synthetic, "starts_with({x}, '<')")
scalar("D6_is_blind", "orders", "o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN 'no_semantic_target' WHEN 1 THEN 'unresolved_signature' WHEN 2 THEN 'inactive_code' ELSE 'external_or_ambiguous' END", L.is_blind, "{x} IN ('no_semantic_target', 'unresolved_signature')")
scalar("G5_role_rank", "orders", "o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN 'case_candidate' WHEN 1 THEN 'helper_candidate' WHEN 2 THEN 'block_candidate' ELSE 'container' END", L.role_rank, "CASE WHEN {x} IN ('case_candidate', 'block_candidate') THEN 0 WHEN {x} = 'helper_candidate' THEN 2 ELSE 1 END")
_NAME = "CASE p_partkey % 8 WHEN 0 THEN '.env.local' WHEN 1 THEN 'ID_RSA' WHEN 2 THEN 'a.PEM' WHEN 3 THEN 'package.json' WHEN 4 THEN 'requirements-dev.txt' WHEN 5 THEN 'Node_Modules' WHEN 6 THEN '.git' ELSE concat(p_type, '.py') END"
scalar("B2_is_excluded_dir", "part", "p_partkey", _NAME, L.is_excluded_dir, "starts_with({x}, '.') OR lower({x}) = 'node_modules'")
scalar("B3_is_sensitive_name", "part", "p_partkey", _NAME, L.is_sensitive_name, "starts_with(lower({x}), '.env') OR lower({x}) = 'id_rsa' OR ends_with(lower({x}), '.pem')")
scalar("B4_is_config_name", "part", "p_partkey", _NAME, L.is_config_name, "{x} IN ('package.json', 'requirements-dev.txt')")


@query("C7_edge_kind", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'bridge:http' ELSE 'calls' END AS kind FROM orders")
def _c7(t):
    return t.orders.select("o_orderkey", L.shown_kind(F.lit("calls"), F.when(F.col("o_orderkey") % 3 == 0, "http")).alias("kind"))


_ACT = "CASE o_orderkey % 3 WHEN 0 THEN 'await' WHEN 1 THEN 'iterate' ELSE 'plain' END"
_EXE = "CASE o_custkey % 3 WHEN 0 THEN 'ordinary' WHEN 1 THEN 'coroutine' ELSE 'generator' END"
_KIND = f"CASE WHEN {_EXE} = 'ordinary' THEN 'calls' WHEN {_ACT} = 'await' THEN 'awaits' WHEN {_ACT} = 'iterate' THEN 'iterates' WHEN {_EXE} = 'coroutine' THEN 'creates_coroutine' ELSE 'creates_generator' END"


@query("S13_activation_kind", f"SELECT o_orderkey, {_KIND} AS kind FROM orders")
def _s13(t):
    return t.orders.select("o_orderkey", L.activation_kind(F.expr(_ACT), F.expr(_EXE)).alias("kind"))


@query("S12_edge_kind", f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN {_KIND} WHEN o_orderkey % 5 = 0 THEN 'property_get' ELSE 'references' END AS kind FROM orders")
def _s12(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", L.edge_kind(k % 2 == 0, F.expr(_ACT), F.expr(_EXE), F.when(k % 5 == 0, 7).otherwise(6)).alias("kind"))


_FITS = "a >= greatest(r - {s}, 0) AND coalesce(a <= m - {s}, true)"


@query(
    "D15_arity_accepts",
    "WITH c AS (SELECT o_orderkey, o_orderkey % 4 AS r, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 4 + 1 END AS m, o_custkey % 6 AS a, ['exact', 'may_bind', 'binds', 'at_least', 'undecided'][1 + o_orderkey % 5] AS rule, o_custkey % 2 = 0 AS rc, o_custkey % 3 = 0 AS bf, true AS hf FROM orders) "
    f"SELECT o_orderkey, CASE rule WHEN 'exact' THEN {_FITS.format(s=0)} WHEN 'may_bind' THEN CASE WHEN NOT rc THEN {_FITS.format(s=0)} WHEN bf THEN {_FITS.format(s=1)} ELSE ({_FITS.format(s=1)}) OR ({_FITS.format(s=0)}) END WHEN 'binds' THEN CASE WHEN NOT rc THEN {_FITS.format(s=0)} WHEN bf THEN {_FITS.format(s=1)} END WHEN 'at_least' THEN a >= r END AS accepts FROM c",
)
def _d15(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rule = F.get(F.array(*map(F.lit, ("exact", "may_bind", "binds", "at_least", "undecided"))), (k % 5).cast("int"))
    return t.orders.select("o_orderkey", L.arity_accepts(k % 4, F.when(k % 7 != 0, k % 4 + 1), c % 6, rule, c % 2 == 0, c % 3 == 0, F.lit(True)).alias("accepts"))


@query("E1_link_file", "SELECT DISTINCT l_orderkey, l_suppkey AS target FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0)")
def _e1(t):
    semantic = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("target")).distinct()
    return L.link(semantic, t.supplier.where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("uid"))).select("l_orderkey", "target")


@query("E1_dangling", "SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey % 7 = 0)")
def _e1d(t):
    semantic = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("target")).distinct()
    return L.dangling(semantic, t.supplier.where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("uid"))).agg(F.count("*").alias("n"))


_DEFS = "p AS (SELECT p_partkey AS uid, p_name, p_brand, p_size FROM part), u AS (SELECT p_name, p_brand, min(uid) AS d FROM p WHERE p_size > 25 GROUP BY ALL HAVING count(*) = 1), c AS (SELECT uid AS prototype, d AS definition FROM p JOIN u USING (p_name, p_brand) WHERE p_size <= 25)"


def _canonical(t):
    parts = t.part.select(F.col("p_partkey").alias("uid"), "p_name", "p_brand", "p_size")
    return L.unique_definitions(parts.where("p_size <= 25"), parts.where("p_size > 25"), ["p_name", "p_brand"])


@query("E13_c_prototype_definitions", f"WITH {_DEFS} SELECT * FROM c")
def _e13(t):
    return _canonical(t)


@query("E14_canonical_c_targets", f"WITH {_DEFS} SELECT l_orderkey, coalesce(definition, l_partkey) AS to_uid, count(*) AS n FROM lineitem LEFT JOIN c ON prototype = l_partkey GROUP BY ALL")
def _e14(t):
    edges = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("to_uid"))
    return L.canonical_targets(edges, _canonical(t)).groupBy("l_orderkey", "to_uid").agg(F.count("*").alias("n"))


_SYMS = "s AS (SELECT 'c' || c_custkey AS uid, 'f' || c_nationkey AS path, c_mktsegment || (c_custkey % 400) AS name, 'm' || (c_custkey % 50) || '.' || c_mktsegment || (c_custkey % 400) AS qualified FROM customer), r AS (SELECT DISTINCT ref FROM (SELECT uid AS ref FROM s WHERE uid LIKE '%7' UNION ALL SELECT path || ':' || name FROM s UNION ALL SELECT name FROM s UNION ALL SELECT qualified FROM s UNION ALL SELECT 'none')), k AS (SELECT uid, uid AS ref, 0 AS way FROM s UNION SELECT uid, path || ':' || name, 1 FROM s UNION SELECT uid, name, 2 FROM s UNION SELECT uid, qualified, 3 FROM s UNION SELECT uid, string_split(qualified, '.')[2], 3 FROM s), w AS (SELECT ref, way, list_sort(list_distinct(list(uid))) AS u FROM r JOIN k USING (ref) GROUP BY ref, way), b AS (SELECT ref, arg_min(u, way) AS u FROM w GROUP BY ref)"


@query("E9_resolve", f"WITH {_SYMS} SELECT ref, CASE WHEN len(u) = 1 THEN u[1] END AS uid, CAST(coalesce(len(u), 0) AS INT) AS n, array_to_string(coalesce(u[1:20], []), ',') AS candidates FROM r LEFT JOIN b USING (ref)")
def _e9(t):
    name = F.concat("c_mktsegment", (F.col("c_custkey") % 400).cast("string"))
    s = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("uid"), F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("path"), name.alias("name"), F.concat(F.lit("m"), (F.col("c_custkey") % 50).cast("string"), F.lit("."), name).alias("qualified"))
    refs = s.where("uid like '%7'").select("uid").union(s.select(F.concat("path", F.lit(":"), "name"))).union(s.select("name")).union(s.select("qualified")).union(t.spark.createDataFrame([("none",)], "x string")).distinct().toDF("ref")
    return L.select(refs, s).withColumn("candidates", F.array_join("candidates", ","))


@query("S9_unique_target", "SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 1")
def _s9(t):
    return L.unique_target(t.lineitem, "l_orderkey", "l_suppkey")


@query("S10_definition_call", "WITH a AS (SELECT o_custkey AS call_id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 12 END AS target, o_orderkey % 3 = 0 AS e FROM orders), g AS (SELECT call_id, count(DISTINCT target) AS n, min(target) AS target, bool_and(e) AS e FROM a GROUP BY call_id) SELECT call_id, CASE WHEN n = 1 THEN 'edge' WHEN n > 1 THEN 'ambiguous' WHEN e THEN 'none' ELSE 'external' END AS outcome, CASE WHEN n = 1 THEN target END AS target FROM g")
def _s10(t):
    k = F.col("o_orderkey")
    return L.definition_call(t.orders.select(F.col("o_custkey").alias("call_id"), F.when(k % 4 == 0, k % 12).alias("target"), (k % 3 == 0).alias("empty")))


@query("G3_collect_rows", "SELECT path, start, uid, tier FROM (SELECT l_orderkey AS path, l_linenumber AS start, l_partkey AS uid, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS tier, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_partkey) AS n FROM lineitem) WHERE n = 1")
def _g3(t):
    tier = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return L.best_rows(t.lineitem.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("start"), F.col("l_partkey").alias("uid"), tier.alias("tier")))


@query("E41_family_candidate_edges", f"WITH {A.SITES_SQL}, f AS (SELECT 'part:' || p_partkey AS uid FROM part WHERE p_size > 20), x AS (SELECT site_id, len(candidates) AS n, unnest(candidates) AS c, CAST(split_part(site_id, ':', 2) AS BIGINT) AS place FROM sites) SELECT site_id FROM x WHERE place % 3 <> 0 GROUP BY site_id HAVING count(*) FILTER (c IN (SELECT uid FROM f)) = any_value(n)")
def _e41(t):
    sites = A.sites(t).select("site_id", "candidates", F.split("site_id", ":")[1].cast("long").alias("place"))
    family = t.part.where("p_size > 20").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("uid"))
    return L.family_candidates(sites, family, sites.where("place % 3 = 0").select("place"))


@query("D23_pending_languages", "SELECT lang AS language FROM documents GROUP BY lang HAVING bool_and(source = 'src0' OR n_chars > 3)")
def _d23(t):
    return L.pending_languages(t.documents.select(F.col("lang").alias("language"), (~((F.col("source") == "src0") | (F.col("n_chars") > 3))).alias("product")))


@query("F16_support_rows", "SELECT lang AS language, count(*) AS n_files, max(n_chars % 4) AS level FROM documents GROUP BY lang")
def _f16(t):
    return L.support(t.documents.select(F.col("lang").alias("language"), (F.col("n_chars") % 4).alias("level")))


@query("F13_merge_bounds", "SELECT bool_or(o_orderkey % 9 = 8) AS depth_hit, bool_or(o_orderkey < 0) AS work_hit, sum(o_custkey) AS work FROM orders")
def _f13(t):
    return L.merge_bounds(t.orders.select((F.col("o_orderkey") % 9 == 8).alias("depth_hit"), (F.col("o_orderkey") < 0).alias("work_hit"), F.col("o_custkey").alias("work")))


@query("F14_use_phrases", "SELECT kind, n, example FROM (SELECT p_type AS kind, count(*) AS n, arg_min(p_name, p_partkey) AS example, min(p_partkey) AS f FROM part GROUP BY p_type) ORDER BY f, kind LIMIT 8")
def _f14(t):
    return L.use_phrases(t.part.select(F.col("p_type").alias("kind"), F.col("p_name").alias("code"), F.col("p_partkey").alias("pos")))


@query("F11_rate_of", "SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus <> 'P') > 0 THEN count(*) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus <> 'P') END AS rate FROM orders GROUP BY o_custkey")
def _f11(t):
    a, b = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") == "O")
    return t.orders.groupBy("o_custkey").agg(F.when(a + b > 0, a / (a + b)).alias("rate"))


@query("F5_row_counts", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS uses, count(*) FILTER (o_orderstatus = 'O') AS overrides, count(*) FILTER (o_orderstatus = 'P') AS declarations FROM orders GROUP BY o_custkey")
def _f5(t):
    s = F.col("o_orderstatus")
    return t.orders.groupBy("o_custkey").agg(F.count_if(s == "F").alias("uses"), F.count_if(s == "O").alias("overrides"), F.count_if(s == "P").alias("declarations"))


@query("G6_uids_of", "SELECT o_orderkey, 'c' || o_custkey || ':' || o_orderstatus || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS uid FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS k FROM orders)")
def _g6(t):
    from pyspark.sql import Window

    from graphloom.functions.hashing import symbol_uid

    k = F.row_number().over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderkey"))
    return t.orders.withColumn("k", k).select("o_orderkey", symbol_uid(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.col("o_orderstatus"), F.col("k")).alias("uid"))


@query("E35_path_match", "SELECT page_id, CASE WHEN len(a) = 2 AND (a[1] IN ('en', '{}')) THEN 1 END AS wild FROM (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1), '/'), lambda s: s <> '') AS a FROM pages)")
def _e35(t):
    segs = P.segments(F.regexp_extract("url", "^[a-z]+://[^/]*([^?#]*)", 1))
    return t.pages.withColumn("a", segs).select("page_id", P.path_match(F.col("a"), F.lit(False), F.array(F.lit("en"), F.lit("{}")), F.lit(False)).alias("wild"))


# hierarchy: parts as classes with two bases each, a directed acyclic graph
def _bases(t):
    k = F.col("p_partkey")
    one = t.part.where("p_partkey >= 2").select(k.alias("class"), F.lit(0).alias("pos"), F.floor(k / 2).alias("base"))
    return one.unionByName(t.part.where("p_partkey >= 9 and p_partkey % 3 = 0").select(k.alias("class"), F.lit(1).alias("pos"), F.floor(k / 3).alias("base")))


_BASES = "b AS (SELECT p_partkey AS c, p_partkey // 2 AS base FROM part WHERE p_partkey >= 2 UNION ALL SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey >= 9 AND p_partkey % 3 = 0)"


@query("J12_mro_ancestors", f"WITH RECURSIVE {_BASES}, r(cls, ancestor, d) AS (SELECT c, base, 1 FROM b UNION SELECT cls, base, d + 1 FROM r JOIN b ON c = ancestor) SELECT cls, ancestor, min(d) AS distance FROM r GROUP BY cls, ancestor")
def _j12(t):
    return Y.ancestors(_bases(t))


@query("J11_family", f"WITH RECURSIVE {_BASES}, r(uid) AS (SELECT CAST(5 AS BIGINT) UNION SELECT c FROM r JOIN b ON base = uid) SELECT uid FROM r")
def _j11(t):
    return Y.family(_bases(t), 5)


@query("J13_c3")
def _j13(t):
    return Y.resolution_order(_bases(t))


@query("E18_family_edges")
def _e18(t):
    methods = t.part.select(F.col("p_partkey").alias("class"), F.col("p_type").alias("name"), F.concat("p_type", F.lit(":"), F.col("p_partkey").cast("string")).alias("uid"))
    return Y.overrides(Y.resolution_order(_bases(t)), methods)
