"""Queries of the readers, Python facts and streaming rules over texts made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.plans.registry import query
from graphloom.sources import formats, inventory, python_facts
from graphloom.streaming import changes


def _read(name: str, given: str, reader: str, shown, sql: str) -> None:
    @query(name, sql)
    def _build(t):
        rows = t.part.select("p_partkey", formats.parsed(F.expr(given), reader).alias("j"))
        return rows.select("p_partkey", *shown())


_j = F.get_json_object  # called when a query is built
_read("B17_strip_jsonc", """concat('{"a": ', p_size, ', // c', chr(10), '"b": [1, 2,], /* x */ }')""", "jsonc", lambda: [_j("j", "$.a").alias("a"), _j("j", "$.b[1]").alias("b")], "SELECT p_partkey, CAST(p_size AS VARCHAR) AS a, '2' AS b FROM part")
_read("B18_toml_value", """concat('[package]', chr(10), 'name = "', p_type, '"', chr(10), 'size = ', p_size)""", "toml", lambda: [_j("j", "$.package.name").alias("name"), _j("j", "$.package.size").alias("size")], "SELECT p_partkey, p_type AS name, CAST(p_size AS VARCHAR) AS size FROM part")
_read("B19_sections", """concat('[s]', chr(10), 'key = ', p_name, chr(10), '[t]', chr(10), 'x: ', p_size)""", "ini", lambda: [_j("j", "$.s.key").alias("key"), _j("j", "$.t.x").alias("x")], "SELECT p_partkey, p_name AS key, CAST(p_size AS VARCHAR) AS x FROM part")
_read("B21_parse_yaml", """concat('a: ', p_size, chr(10), 'b:', chr(10), '  - ', p_type, chr(10), '  - k: true', chr(10))""", "yaml", lambda: [_j("j", "$.a").alias("a"), _j("j", "$.b[0]").alias("b"), _j("j", "$.b[1].k").alias("k")], "SELECT p_partkey, CAST(p_size AS VARCHAR) AS a, p_type AS b, 'true' AS k FROM part")
_read("B22_parse_proto", """concat('package p; service ', p_type, ' { rpc Get', p_size, ' (Req) returns (Res); }')""", "proto", lambda: [_j("j", "$[0].service").alias("service"), _j("j", "$[0].rpc").alias("rpc")], "SELECT p_partkey, p_type AS service, 'Get' || p_size AS rpc FROM part")
_read("B23_parse_graphql_schema", """concat('type Query { f', p_size, '(x: Int): Int g: Int } type Other { h: Int }')""", "graphql", lambda: [_j("j", "$[0].field").alias("field"), F.size(F.from_json("j", "array<string>")).alias("n")], "SELECT p_partkey, 'f' || p_size AS field, 2 AS n FROM part")
_read("B24_openapi_operations", """concat('{"basePath": "/v1", "paths": {"/', lower(p_type), '/{id}": {"get": {"operationId": "op', p_size, '"}}}}')""", "openapi", lambda: [_j("j", "$[0].path").alias("path"), _j("j", "$[0].id").alias("id")], "SELECT p_partkey, '/v1/' || lower(p_type) || '/{id}' AS path, 'op' || p_size AS id FROM part")


@query("B20_parse_xml", "SELECT p_partkey, p_type AS name, CAST(p_size AS VARCHAR) AS size FROM part")
def _b20(t):
    xml = F.expr("concat('<p><name>', p_type, '</name><size unit=\"cm\">', p_size, '</size></p>')")
    return t.part.select("p_partkey", xml.alias("x")).select("p_partkey", F.xpath_string("x", F.lit("p/name")).alias("name"), F.xpath_string("x", F.lit("p/size")).alias("size"))


@query("B1_scan", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'sensitive' WHEN 1 THEN 'excluded' WHEN 2 THEN 'colon' ELSE NULL END AS reason FROM documents")
def _b1(t):
    k = F.col("doc_id")
    path = F.when(k % 5 == 0, "a/id_rsa").when(k % 5 == 1, "dist/x.py").when(k % 5 == 2, "a:b.py").otherwise("src/x.py")
    files = t.documents.select("doc_id", path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.encode("text", "UTF-8").alias("content"))
    return files.select("doc_id", inventory.refusal().alias("reason"))


@query("B31_emit", "SELECT r_regionkey, '{\"schema\":1,\"name\":\"' || r_name || '\"}' AS json FROM region")
def _b31(t):
    return t.region.select("r_regionkey", F.to_json(F.struct(F.lit(1).alias("schema"), F.col("r_name").alias("name"))).alias("json"))


_PY = """concat('import ', lower(p_type), chr(10), 'class C', p_size, '(Base):', chr(10), '    def m', p_size, '(self, x):', chr(10), '        return helper(x, ', p_size, ')', chr(10))"""


@query("N2_extract_file", "SELECT p_partkey AS path, kind, qualified, n FROM part, LATERAL (VALUES ('import', lower(p_type), 0), ('class', 'C' || p_size, 1), ('function', 'C' || p_size || '.m' || p_size, 2), ('call', 'C' || p_size || '.m' || p_size || '.helper', 2)) v(kind, qualified, n)")
def _n2(t):
    rows = python_facts.extract(t.part.select(F.col("p_partkey").cast("string").alias("path"), F.expr(_PY).alias("text")))
    return rows.where("kind in ('import', 'class', 'function', 'call')").select(F.col("path").cast("long").alias("path"), "kind", "qualified", "n")


@query("N6_call_site", "SELECT p_partkey AS path, 'helper' AS name, 'C' || p_size || '.m' || p_size AS owner, 4 AS line, 2 AS n FROM part")
def _n6(t):
    rows = python_facts.extract(t.part.select(F.col("p_partkey").cast("string").alias("path"), F.expr(_PY).alias("text")))
    return rows.where("kind = 'call'").select(F.col("path").cast("long").alias("path"), "name", "owner", "line", "n")


@query("N7_reference", "SELECT name, count(*) AS n FROM (SELECT unnest(['Base', 'helper', 'x']) AS name FROM part) GROUP BY name")
def _n7(t):
    rows = python_facts.extract(t.part.select(F.col("p_partkey").cast("string").alias("path"), F.expr(_PY).alias("text")))
    return rows.where("kind = 'reference'").groupBy("name").agg(F.count("*").alias("n"))


@query("Q2_step", "SELECT DISTINCT user_id AS path FROM events ORDER BY path LIMIT 512")
def _q2(t):
    stale = t.events.select(F.col("user_id").alias("path")).distinct()
    return changes.next_batch(stale.where("false"), stale)


@query("Q10_merge", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, event_id) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (ORDER BY ts, event_id) AS b FROM g) SELECT min(event_id) AS first_id, count(*) AS n_events, count(DISTINCT user_id) AS n_paths FROM s GROUP BY b")
def _q10(t):
    events = t.events.select(F.lit("root").alias("root"), "ts", F.col("user_id").alias("path"), "event_id")
    sets = changes.debounce(events, quiet="5 minutes")
    ids = events.groupBy(F.col("ts").alias("first")).agg(F.min("event_id").alias("first_id"))
    return sets.join(ids, "first").select("first_id", "n_events", F.size("paths").cast("long").alias("n_paths"))
