"""Queries of occurrence, import, mount and test joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import incremental as I
from graphloom.operators import links as K
from graphloom.operators import relations as L
from graphloom.operators import search as R
from graphloom.plans import adapters as A
from graphloom.plans.registry import query, scalar
from graphloom.plans.scalars import _PATH


@query("C1_card", "SELECT doc_id, source AS name, left(string_split(text, chr(10))[1], 160) AS head, len(string_split(text, chr(10))) AS lines FROM documents")
def _c1(t):
    card = K.card(F.col("source"), F.col("text"), F.size(F.split("text", "\n")))
    return t.documents.select("doc_id", card.alias("c")).select("doc_id", "c.name", "c.head", "c.lines")


@query("C3_edge_row", "SELECT o_orderkey AS edge_id, CASE o_orderkey % 3 WHEN 0 THEN 'decided' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'bridge:http' ELSE 'calls' END AS shown FROM orders")
def _c3(t):
    k = F.col("o_orderkey")
    edges = t.orders.select(k.alias("edge_id"), k.alias("site_id"), k.alias("bridge_id"), F.lit("calls").alias("kind"))
    decisions = t.orders.where("o_orderkey % 3 = 0").select(k.alias("site_id"), F.lit("decided").alias("status"))
    bridges = t.orders.where("o_orderkey % 4 = 0").select(k.alias("bridge_id"), F.lit("http").alias("kind"))
    return K.edge_rows(edges, decisions, bridges).select("edge_id", "status", "shown")


@query("C14_carries", "SELECT o_orderkey, 'v1=' || CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END || CASE WHEN o_orderkey % 3 = 0 THEN ',v2=c' WHEN o_orderkey % 2 = 0 THEN ',v2=b' ELSE ',v2=c' END AS carried FROM orders")
def _c14(t):
    k = F.col("o_orderkey")
    args = F.array(F.struct(F.lit("v1").alias("value"), F.lit(None).cast("string").alias("keyword")), F.struct(F.lit("v2").alias("value"), F.when(k % 3 == 0, "c").alias("keyword")))
    pairs = L.carries(args, F.array(*map(F.lit, "abc")), F.when(k % 2 == 0, 0).otherwise(1))
    return t.orders.select("o_orderkey", F.array_join(F.transform(pairs, lambda p: F.concat(p["argument"], F.lit("="), p["parameter"])), ",").alias("carried"))


@query("E7_name_scan", "WITH e AS (SELECT l_orderkey AS path, l_linenumber AS en, min(l_quantity) AS st FROM lineitem GROUP BY 1, 2) SELECT o_orderkey, coalesce(st <= 25, false) AS linked FROM orders LEFT JOIN e ON path = o_orderkey AND en = 3")
def _e7(t):
    found = t.orders.select("o_orderkey", F.col("o_orderkey").alias("path"), F.lit(25.0).alias("start"), F.lit(3).alias("end"))
    evidence = t.lineitem.select(F.col("l_orderkey").alias("path"), F.col("l_quantity").alias("start"), F.col("l_linenumber").alias("end"))
    return K.with_evidence(found, evidence).select("o_orderkey", "linked")


@query("E8_collect", "WITH n AS (SELECT p_name AS name FROM part WHERE p_size > 40) SELECT p_partkey AS path, 'call' AS source FROM part WHERE p_name IN (SELECT name FROM n) UNION ALL SELECT p_partkey, 'import' FROM part WHERE p_name IN (SELECT name FROM n) AND p_size < 10")
def _e8(t):
    rows = t.part.select(F.col("p_partkey").alias("path"), F.col("p_size").alias("start"), F.col("p_name").alias("name"))
    names = rows.where("start > 40").select("name").distinct()
    return K.occurrences(names, call=rows, **{"import": rows.where("start < 10")}).select("path", "source")


@query("E12_semantic_requery", "SELECT DISTINCT o_orderkey AS path FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) OR o_orderpriority = '1-URGENT'")
def _e12(t):
    k = F.col("o_orderkey").alias("path")
    changed = t.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("path"))
    names = t.spark.createDataFrame([("1-URGENT",)], "name string")
    return I.requery(t.orders.select(k, F.col("o_custkey").alias("target")), t.orders.select(k, F.col("o_orderpriority").alias("name")), changed, names)


@query("E20_import_path_edges", "WITH d AS (SELECT p_type, p_name, min(p_partkey) AS uid FROM part WHERE p_size > 35 GROUP BY 1, 2 HAVING count(*) = 1) SELECT p.p_partkey AS import_id, uid AS to_uid FROM part p JOIN d USING (p_type, p_name) WHERE p.p_partkey % 4 <> 0")
def _e20(t):
    rows = t.part.select(F.col("p_partkey").alias("import_id"), F.col("p_type").alias("module"), F.col("p_name").alias("name"))
    declared = t.part.where("p_size > 35").select(F.col("p_type").alias("module"), F.col("p_name").alias("name"), F.col("p_partkey").alias("uid"))
    return K.unique_imports(rows, declared, rows.where("import_id % 4 = 0"))


@query("E21_resolve", "SELECT s_suppkey AS import_id, CASE WHEN s_nationkey % 2 = 0 THEN 'src/m' || s_nationkey || '.py' ELSE 'm' || s_nationkey || '.py' END AS path FROM supplier")
def _e21(t):
    n = F.col("n_nationkey").cast("string")
    files = t.nation.select(F.concat(F.lit("m"), n, F.lit(".py")).alias("path"), F.concat(F.lit("m"), n).alias("module"))
    files = files.unionByName(t.nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("src/m"), n, F.lit(".py")).alias("path"), F.concat(F.lit("src.m"), n).alias("module")))
    return K.resolve_import(t.supplier.select(F.col("s_suppkey").alias("import_id"), F.concat(F.lit("pkg.src.m"), F.col("s_nationkey").cast("string")).alias("target")), files)


@query("E37_script_file", "SELECT s_suppkey AS token_id, CASE s_suppkey % 3 WHEN 0 THEN 'tools/n' || s_nationkey || '.py' WHEN 1 THEN 'tools/n' || s_nationkey || '.py' ELSE 'bin/u' || s_nationkey || '.sh' END AS path FROM supplier")
def _e37(t):
    n, k = F.col("n_nationkey").cast("string"), F.col("s_suppkey")
    files = t.nation.select(F.concat(F.lit("tools/n"), n, F.lit(".py")).alias("path")).union(t.nation.select(F.concat(F.lit("bin/u"), n, F.lit(".sh")))).union(t.nation.select(F.concat(F.lit("old/n"), n, F.lit(".py"))))
    s = F.col("s_nationkey").cast("string")
    token = F.when(k % 3 == 0, F.concat(F.lit("tools/n"), s, F.lit(".py"))).when(k % 3 == 1, F.concat(F.lit("../tools/n"), s, F.lit(".py"))).otherwise(F.concat(F.lit("u"), s, F.lit(".sh")))
    return K.script_file(t.supplier.select(k.alias("token_id"), token.alias("token"), F.lit("src").alias("folder")), files)


@query("E40_option_tests", "SELECT DISTINCT c_nationkey AS guard_id, 'q' || (o_orderkey % 5) AS test FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 100 >= 20 AND o_orderkey % 100 < 60")
def _e40(t):
    guards = t.customer.select(F.col("c_nationkey").alias("guard_id"), F.col("c_custkey").alias("name"))
    writes = t.orders.select((F.col("o_orderkey") % 5).alias("path"), (F.col("o_orderkey") % 100).alias("point"), F.col("o_custkey").alias("name"))
    tests = t.spark.range(5).select(F.col("id").alias("path"), F.lit(20).alias("start"), F.lit(60).alias("end"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("test"))
    return K.option_tests(guards, writes, tests)


@query("J16_mount_prefixes", "WITH RECURSIVE m AS (SELECT 'nation' || n_nationkey AS child, 'region' || n_regionkey AS parent, '/n' || n_nationkey AS prefix FROM nation UNION ALL SELECT 'supplier' || s_suppkey, 'nation' || s_nationkey, 's' || s_suppkey || '/' FROM supplier), r(router, prefix, d) AS (SELECT DISTINCT parent, '', 0 FROM m WHERE parent NOT IN (SELECT child FROM m) UNION ALL SELECT child, rtrim(r.prefix, '/') || '/' || ltrim(m.prefix, '/'), d + 1 FROM r JOIN m ON m.parent = r.router WHERE d < 8) SELECT DISTINCT router, prefix FROM r")
def _j16(t):
    uid = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    mounts = t.nation.select(uid("nation", "n_nationkey").alias("child"), uid("region", "n_regionkey").alias("parent"), uid("/n", "n_nationkey").alias("prefix"))
    mounts = mounts.unionByName(t.supplier.select(uid("supplier", "s_suppkey").alias("child"), uid("nation", "s_nationkey").alias("parent"), F.concat(uid("s", "s_suppkey"), F.lit("/")).alias("prefix")))
    return K.mount_prefixes(mounts)


@query("J10_mention_names", f"WITH RECURSIVE {A.EDGES_SQL}, {A.view_sql(1)}, r(uid, d) AS (SELECT 'nation:4', 0 UNION SELECT from_uid, d + 1 FROM r JOIN view ON to_uid = uid WHERE d < 4) SELECT uid AS name, CASE WHEN min(d) = 0 THEN 0 ELSE 1 END AS distance FROM r GROUP BY uid")
def _j10(t):
    found = G.reach(A.edges(t), ["nation:4"], reverse=True, max_depth=4, max_work=None).nodes
    return found.select(F.col("uid").alias("name"), F.when(F.col("distance") == 0, 0).otherwise(1).alias("distance"))


@query("H6_nearest_named", "SELECT p_partkey AS uid, CASE WHEN 25 < p_size THEN p_size - 25 WHEN 25 > p_size + 3 THEN 25 - p_size - 3 ELSE 0 END AS distance FROM part WHERE p_type = 'PROMO' ORDER BY distance, p_size, uid LIMIT 5")
def _h6(t):
    symbols = t.part.select(F.col("p_partkey").alias("uid"), F.col("p_type").alias("path"), F.col("p_size").alias("start_line"), (F.col("p_size") + 3).alias("end_line"))
    return R.nearest_named(symbols, "PROMO", 25).select("uid", "distance")


@query("D11_owner_chain", "WITH RECURSIVE r(uid, ancestor) AS (SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0 UNION ALL SELECT uid, ancestor // 3 FROM r WHERE ancestor > 0) SELECT uid, ancestor FROM r")
def _d11(t):
    return K.owner_chain(t.part.select(F.col("p_partkey").alias("uid"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 3)).alias("parent_uid")))


scalar("D13_is_test_path", "part", "p_partkey", "CASE p_partkey % 6 WHEN 0 THEN concat('src/test_', p_type, '.py') WHEN 1 THEN concat('tests/', p_type, '.rs') WHEN 2 THEN concat('a/', p_type, '.spec.tsx') WHEN 3 THEN concat('a/', p_type, 'Test.java') WHEN 4 THEN 'contest/x.py' ELSE 'a/latest.go' END", K.is_test_path, "NOT ({x} IN ('contest/x.py', 'a/latest.go'))")
scalar("F9_area", "part", "p_partkey", _PATH, lambda x: L.area(x, F.lit(1), F.lit(100)), "'src/' || split_part({x}, '/', 2)")


@query("D7_proven_external", "SELECT o_orderkey, o_orderkey % 2 = 0 AND o_custkey % 3 = 0 AS external FROM orders")
def _d7(t):
    kind = F.when(F.col("o_orderkey") % 2 == 0, "external_or_ambiguous").otherwise("inactive_code")
    return t.orders.select("o_orderkey", L.proven_external(kind, F.expr("filter(array(1), x -> o_custkey % 3 <> 0)")).alias("external"))


@query("S15_constructor_bridge", "SELECT o_orderkey AS call_id, CASE WHEN o_custkey % 2 = 0 THEN 'C' || o_custkey || '.init' ELSE 'C' || o_custkey END AS target FROM orders")
def _s15(t):
    name = lambda key: F.concat(F.lit("C"), F.col(key).cast("string"))
    made = t.customer.where("c_custkey % 2 = 0").select(name("c_custkey").alias("class"), F.concat(name("c_custkey"), F.lit(".init")).alias("constructor"))
    return K.constructor_bridge(t.orders.select(F.col("o_orderkey").alias("call_id"), name("o_custkey").alias("class")), made)


@query("I5_undecided_call_keys", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def _i5(t):
    return t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber").distinct()


@query("I6_calls_completeness", "SELECT l_orderkey, count(*) AS n_open FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem EXCEPT SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A') GROUP BY l_orderkey")
def _i6(t):
    calls = t.lineitem.select("l_orderkey", "l_linenumber").distinct()
    covered = t.lineitem.where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber")
    return calls.join(covered, ["l_orderkey", "l_linenumber"], "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n_open"))
