"""Queries of site generation and of library facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import library as B
from graphloom.operators import sites as S
from graphloom.plans.registry import query

_IMPL = "i AS (SELECT 's' || s_nationkey AS stub, 'p' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS uid FROM supplier)"


def _implementations(t):
    return t.supplier.select(F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("stub"), F.concat(F.lit("p"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("uid"))


@query("O2_dispatch", f"WITH {_IMPL} SELECT c_custkey AS edge_id, array_to_string(list_sort(list(uid))[1:20], ',') AS candidates, count(*) > 20 AS truncated FROM customer JOIN i ON stub = 's' || c_nationkey GROUP BY c_custkey")
def _o2(t):
    edges = t.customer.select(F.col("c_custkey").alias("edge_id"), F.col("c_name").alias("from_uid"), F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("to_uid"))
    return S.dispatch(edges, _implementations(t)).select("edge_id", F.array_join("candidates", ",").alias("candidates"), "truncated")


@query("O5_no_target", "WITH d AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS uid, p_name AS name, p_type AS language, p_size % 3 AS r, CASE WHEN p_size % 7 > 0 THEN p_size % 3 + 1 END AS m, p_size % 2 = 0 AS meth FROM part), c AS (SELECT p_partkey AS call_id, p_name AS name, p_type AS language, p_size % 4 AS a, p_partkey % 2 = 0 AS bare FROM part) SELECT call_id, array_to_string(list_sort(list(uid))[1:20], ',') AS candidates, count(*) > 20 AS truncated FROM c JOIN d USING (name, language) WHERE a >= r AND coalesce(a <= m, true) AND NOT (bare AND meth) GROUP BY call_id")
def _o5(t):
    k, n = F.col("p_partkey"), F.col("p_size")
    calls = t.part.select(k.alias("call_id"), F.col("p_name").alias("member"), F.col("p_type").alias("language"), (n % 4).alias("args"), (k % 2 == 0).alias("bare"))
    callables = t.part.select(F.lpad(k.cast("string"), 7, "0").alias("uid"), F.col("p_name").alias("name"), F.col("p_type").alias("language"), (n % 3).alias("required"), F.when(n % 7 > 0, n % 3 + 1).alias("most"), (n % 2 == 0).alias("method"))
    return S.no_target(calls, callables).select("call_id", F.array_join("candidates", ",").alias("candidates"), "truncated")


def _sites(t):
    own = F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.concat(F.lit("x"), (F.col("c_custkey") % 3).cast("string")))
    return t.customer.select(F.col("c_custkey").alias("site_id"), F.concat(F.lit("x"), (F.col("c_custkey") % 5).cast("string")).alias("owner_uid"), own.alias("candidates"))


@query("O7_compose", "WITH s AS (SELECT c_custkey AS site_id, unnest(['n' || c_nationkey, 'x' || (c_custkey % 3)]) AS uid FROM customer), im AS (SELECT 'n' || n_nationkey AS stub, 'r' || n_regionkey AS uid FROM nation UNION SELECT 'r' || r_regionkey, 'x' || r_regionkey FROM region), e AS (SELECT site_id, uid, 0 AS d FROM s UNION ALL SELECT site_id, im.uid, 1 FROM s JOIN im ON stub = s.uid UNION ALL SELECT site_id, b.uid, 2 FROM s JOIN im a ON a.stub = s.uid JOIN im b ON b.stub = a.uid) SELECT site_id, uid, min(d) AS depth FROM e GROUP BY 1, 2")
def _o7(t):
    uid = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    step = t.nation.select(uid("n", "n_nationkey").alias("stub"), uid("r", "n_regionkey").alias("uid")).union(t.region.select(uid("r", "r_regionkey"), uid("x", "r_regionkey")))
    return S.compose(_sites(t), step)


@query("O8_mark_tests", "SELECT c_custkey AS site_id, 'x' || (c_custkey % 3) AS test_only FROM customer WHERE c_custkey % 5 NOT IN (0, 1) AND c_custkey % 3 IN (0, 1)")
def _o8(t):
    tests = t.spark.createDataFrame([("x0",), ("x1",)], "uid string")
    return S.mark_tests(_sites(t), tests).withColumn("test_only", F.array_join("test_only", ","))


@query("R26_precision", "SELECT lang AS language, CASE WHEN count(*) FILTER (n_chars % 4 > 0) > 0 THEN count(*) FILTER (n_chars % 4 > 1) / count(*) FILTER (n_chars % 4 > 0) ELSE 0.0 END AS precision, coalesce(count(*) FILTER (n_chars % 4 > 1) / nullif(count(*) FILTER (n_chars % 4 > 0), 0), 0.0) >= 0.9 AS passed FROM documents GROUP BY lang")
def _r26(t):
    k = F.col("n_chars") % 4
    return B.precision(t.documents.select(F.col("lang").alias("language"), F.when(k > 1, "correct").when(k > 0, "wrong").otherwise("undecided").alias("verdict")))


@query("R28_lookup", "SELECT p_type AS module, p_name AS name, p_size AS arity, min(p_partkey) AS uid FROM part GROUP BY 1, 2, 3 HAVING count(*) = 1")
def _r28(t):
    return B.unique_index(t.part.select(F.col("p_type").alias("module"), F.col("p_name").alias("name"), F.col("p_size").alias("arity"), F.col("p_partkey").alias("uid")))


@query("R7_behaviours", "SELECT o_orderkey AS request_id, CASE WHEN o_custkey % 2 = 0 THEN 'd' WHEN o_custkey % 3 = 0 THEN 't' WHEN o_custkey % 5 = 0 THEN 'n' END AS effect, CASE WHEN o_custkey % 2 = 0 THEN 'derived' WHEN o_custkey % 3 = 0 THEN 'declared' WHEN o_custkey % 5 = 0 THEN 'table' END AS source FROM orders")
def _r7(t):
    facts = lambda n, effect: t.customer.where(f"c_custkey % {n} = 0").select(F.col("c_custkey").alias("symbol"), F.lit(effect).alias("effect"))
    return B.behaviours(t.orders.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("symbol")), facts(2, "d"), facts(3, "t"), facts(5, "n"))


@query("F12_recount", "SELECT count(*) FILTER (o_orderstatus = 'F') AS n_derived, count(*) FILTER (o_orderstatus = 'O') AS n_declared, count(*) FILTER (o_orderstatus = 'P') AS n_table, count(*) AS n FROM orders")
def _f12(t):
    s = F.col("o_orderstatus")
    return B.recount(t.orders.select(F.when(s == "F", "derived").when(s == "O", "declared").otherwise("table").alias("source")))


@query("R33_prune", "SELECT shard, key FROM (SELECT o_custkey AS shard, o_orderkey AS key, sum(o_orderkey % 50) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS s FROM orders) WHERE s > 100")
def _r33(t):
    entries = t.orders.select(F.col("o_custkey").alias("shard"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("used"), (F.col("o_orderkey") % 50).alias("size"))
    return B.evict(entries, 100).select("shard", "key")
