"""The driver's tables as a code graph: DataFrames, and the same in SQL for the oracles.

Nodes are rows of the star schema (order:1, customer:7); foreign keys are edges whose
kind and tier follow a fixed rule; edge ids number the union in a total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.registry import Tables


def edges(t: Tables) -> DataFrame:
    """edge_id, from_uid, to_uid, kind, tier."""
    uid = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    tier = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    kind = F.when(F.col("o_orderstatus") == "F", "calls").when(F.col("o_orderstatus") == "O", "inferred_call").otherwise("possible_link")
    orders = t.orders.select((F.col("o_orderkey") * 4).alias("edge_id"), uid("order", "o_orderkey").alias("from_uid"), uid("customer", "o_custkey").alias("to_uid"), kind.alias("kind"), tier.alias("tier"))
    customers = t.customer.select((F.col("c_custkey") * 4 + 1).alias("edge_id"), uid("customer", "c_custkey").alias("from_uid"), uid("nation", "c_nationkey").alias("to_uid"), F.when(F.col("c_custkey") % 5 == 0, "creates_coroutine").otherwise("constructor").alias("kind"), F.lit(0).alias("tier"))
    suppliers = t.supplier.select((F.col("s_suppkey") * 4 + 2).alias("edge_id"), uid("supplier", "s_suppkey").alias("from_uid"), uid("nation", "s_nationkey").alias("to_uid"), F.when(F.col("s_suppkey") % 3 == 0, "overrides").when(F.col("s_suppkey") % 3 == 1, "implements").otherwise("references").alias("kind"), F.lit(0).alias("tier"))
    nations = t.nation.select((F.col("n_nationkey").cast("long") * 4 + 3).alias("edge_id"), uid("nation", "n_nationkey").alias("from_uid"), uid("region", "n_regionkey").alias("to_uid"), F.lit("bridge").alias("kind"), (F.col("n_nationkey") % 3).alias("tier"))
    back = t.region.select((F.col("r_regionkey").cast("long") * 4 + 4_000_000_003).alias("edge_id"), uid("region", "r_regionkey").alias("from_uid"), F.concat(F.lit("nation:"), (F.col("r_regionkey") * 2).cast("string")).alias("to_uid"), F.lit("calls").alias("kind"), F.lit(0).alias("tier"))
    return orders.unionByName(customers).unionByName(suppliers).unionByName(nations).unionByName(back)


EDGES_SQL = """edges AS (
  SELECT o_orderkey * 4 AS edge_id, 'order:' || o_orderkey AS from_uid, 'customer:' || o_custkey AS to_uid, CASE o_orderstatus WHEN 'F' THEN 'calls' WHEN 'O' THEN 'inferred_call' ELSE 'possible_link' END AS kind, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS tier FROM orders
  UNION ALL SELECT c_custkey * 4 + 1, 'customer:' || c_custkey, 'nation:' || c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN 'creates_coroutine' ELSE 'constructor' END, 0 FROM customer
  UNION ALL SELECT s_suppkey * 4 + 2, 'supplier:' || s_suppkey, 'nation:' || s_nationkey, CASE s_suppkey % 3 WHEN 0 THEN 'overrides' WHEN 1 THEN 'implements' ELSE 'references' END, 0 FROM supplier
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 4 + 3, 'nation:' || n_nationkey, 'region:' || n_regionkey, 'bridge', n_nationkey % 3 FROM nation
  UNION ALL SELECT CAST(r_regionkey AS BIGINT) * 4 + 4000000003, 'region:' || r_regionkey, 'nation:' || r_regionkey * 2, 'calls', 0 FROM region)"""


def view_sql(include: int) -> str:
    """The edges of a view, as CTE ``view``."""
    from graphloom.operators.graph import kinds_for

    kinds = ", ".join(f"'{k}'" for k in kinds_for(include))
    return f"view AS (SELECT * FROM edges WHERE tier <= {include} AND kind IN ({kinds}))"


def sites(t: Tables) -> DataFrame:
    """Sites from orders: candidates are the order's parts, and every other column follows from the key."""
    parts = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")))).alias("candidates"))
    k = F.col("l_orderkey")
    pick = lambda n, xs: F.get(F.array(*(F.lit(x) for x in xs)), (k % n).cast("int"))
    none = F.expr("cast(array() as array<string>)")
    return parts.select(
        F.concat(F.lit("site:"), k.cast("string")).alias("site_id"),
        F.concat(F.lit("order:"), k.cast("string")).alias("owner_uid"),
        pick(5, ["dispatch", "callback", "implicit", "no_target", "flow_call"]).alias("category"),
        pick(7, ["call", "field_write", "call", "call", "iterate", "call", "call"]).alias("operation"),
        pick(3, ["calls", "awaits", "references"]).alias("activation"),
        F.when(k % 11 == 0, F.lit("site:0")).alias("via"),
        "candidates",
        F.when(k % 2 == 0, F.slice("candidates", 1, 1)).when(k % 3 == 0, F.slice("candidates", 1, 2)).otherwise(none).alias("flow_candidates"),
        F.when(k % 13 == 0, F.slice("candidates", 1, 1)).otherwise(none).alias("field_only"),
        F.when(k % 6 == 0, F.slice("candidates", 2, 10)).when(k % 17 == 0, F.col("candidates")).otherwise(none).alias("test_only"),
        (k % 19 == 0).alias("truncated"),
        (k % 4 == 0).alias("receiver_exact"),
        F.when(k % 8 == 0, F.lit("decl")).alias("declared_target"),
        F.when(k % 9 == 0, F.lit("lib")).alias("declared_library"),
        F.when(k % 10 == 1, k % 20 == 1).alias("library_runs"),
    )


SITES_SQL = """sites AS (SELECT 'site:' || k AS site_id, 'order:' || k AS owner_uid, ['dispatch', 'callback', 'implicit', 'no_target', 'flow_call'][1 + k % 5] AS category,
  ['call', 'field_write', 'call', 'call', 'iterate', 'call', 'call'][1 + k % 7] AS operation, ['calls', 'awaits', 'references'][1 + k % 3] AS activation, CASE WHEN k % 11 = 0 THEN 'site:0' END AS via, c AS candidates,
  CASE WHEN k % 2 = 0 THEN c[1:1] WHEN k % 3 = 0 THEN c[1:2] ELSE [] END AS flow_candidates, CASE WHEN k % 13 = 0 THEN c[1:1] ELSE [] END AS field_only, CASE WHEN k % 6 = 0 THEN c[2:11] WHEN k % 17 = 0 THEN c ELSE [] END AS test_only,
  k % 19 = 0 AS truncated, k % 4 = 0 AS receiver_exact, CASE WHEN k % 8 = 0 THEN 'decl' END AS declared_target, CASE WHEN k % 9 = 0 THEN 'lib' END AS declared_library, CASE WHEN k % 10 = 1 THEN k % 20 = 1 END AS library_runs
  FROM (SELECT l_orderkey AS k, list_sort(list_distinct(list('part:' || l_partkey))) AS c FROM lineitem GROUP BY l_orderkey))"""
