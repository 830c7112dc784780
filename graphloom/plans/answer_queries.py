"""Queries of points, scopes and answers, and of projections of links, sites and bridges."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import answers as N
from graphloom.operators import families as M
from graphloom.operators import hierarchy as Y
from graphloom.operators import links as K
from graphloom.operators import relations as L
from graphloom.operators import spans as X
from graphloom.plans import adapters as A
from graphloom.plans.registry import query
from graphloom.plans.relation_queries import _BASES, _bases

_path = lambda key: F.concat(F.lit("f"), (F.col(key) % 997).cast("string"))


def _calls(t):
    start = (F.col("l_partkey") % 500).cast("int")
    once = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    return once.select(_path("l_orderkey").alias("path"), start.alias("start"), (start + F.col("l_linenumber") * 3 + 1).cast("int").alias("end"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("o"), F.col("l_suppkey").cast("string"))).alias("owner"))


_CALLS = "c AS (SELECT 'f' || l_orderkey % 997 AS path, l_partkey % 500 AS st, l_partkey % 500 + l_linenumber * 3 + 1 AS en, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_suppkey % 4 <> 0 THEN 'o' || l_suppkey END AS owner FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL))"


def _points(t):
    return t.orders.select("o_orderkey", _path("o_orderkey").alias("path"), (F.col("o_custkey") % 500).cast("int").alias("point"))


_POINTS = "p AS (SELECT o_orderkey, 'f' || o_orderkey % 997 AS path, o_custkey % 500 AS point FROM orders)"
_BEST = f"WITH {_CALLS}, {_POINTS}, b AS (SELECT o_orderkey, id, owner, row_number() OVER (PARTITION BY o_orderkey ORDER BY en - st, id) AS k FROM p JOIN c ON c.path = p.path AND st <= point AND point < en)"


@query("E5_call_at", f"{_BEST} SELECT o_orderkey, id AS call_id FROM p LEFT JOIN (SELECT * FROM b WHERE k = 1) USING (o_orderkey)")
def _e5(t):
    return N.call_at(_points(t), _calls(t).withColumnRenamed("id", "call_id")).select("o_orderkey", "call_id")


@query("S1_innermost_call", f"{_BEST} SELECT o_orderkey, id AS call_id FROM b WHERE k = 1 AND o_orderkey % 2 = 0")
def _s1(t):
    return N.call_at(_points(t).where("o_orderkey % 2 = 0"), _calls(t).withColumnRenamed("id", "call_id")).where("call_id is not null").select("o_orderkey", "call_id")


@query(
    "S2_owner_at",
    f"{_BEST}, r AS (SELECT 'f' || o_orderkey % 997 AS path, o_custkey * 7 % 500 AS st, o_custkey * 7 % 500 + o_orderkey % 30 AS en, o_orderkey AS id, 'r' || o_orderkey AS owner FROM orders), "
    "q AS (SELECT o_orderkey, r.owner, row_number() OVER (PARTITION BY o_orderkey ORDER BY r.en - r.st, r.id) AS k FROM p JOIN r ON r.path = p.path AND ((r.st <= point AND point < r.en) OR r.st = point)) "
    "SELECT p.o_orderkey, CASE WHEN b.o_orderkey IS NOT NULL THEN b.owner ELSE q.owner END AS owner FROM p LEFT JOIN b ON b.o_orderkey = p.o_orderkey AND b.k = 1 LEFT JOIN q ON q.o_orderkey = p.o_orderkey AND q.k = 1",
)
def _s2(t):
    start = (F.col("o_custkey") * 7 % 500).cast("int")
    references = t.orders.select(_path("o_orderkey").alias("path"), start.alias("start"), (start + F.col("o_orderkey") % 30).cast("int").alias("end"), F.col("o_orderkey").alias("id"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("owner"))
    return N.owner_at(_points(t), _calls(t), references).select("o_orderkey", "owner")


@query(
    "E4_innermost_scope_at",
    f"WITH {_CALLS}, s AS (SELECT path, st AS first, st + (en - st) * 4 AS last, (en - st) * 80 + id % 7 AS bytes, 's' || id AS uid FROM c), r AS (SELECT o_orderkey, 'f' || o_orderkey % 997 AS path, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey % 500 END AS line FROM orders), "
    "b AS (SELECT o_orderkey, uid, row_number() OVER (PARTITION BY o_orderkey ORDER BY bytes, uid) AS k FROM r JOIN s ON s.path = r.path AND first <= line AND line <= last) SELECT r.path || ':' || coalesce(CAST(line AS VARCHAR), 'x') AS reference, uid FROM r LEFT JOIN b ON b.o_orderkey = r.o_orderkey AND k = 1",
)
def _e4(t):
    scopes = _calls(t).select("path", F.col("start").alias("first"), (F.col("start") + (F.col("end") - F.col("start")) * 4).alias("last"), ((F.col("end") - F.col("start")) * 80 + F.col("id") % 7).alias("bytes"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("uid"))
    line = F.when(F.col("o_orderkey") % 9 != 0, (F.col("o_custkey") % 500).cast("string")).otherwise("x")
    return N.scope_at(t.orders.select(F.concat(_path("o_orderkey"), F.lit(":"), line).alias("reference")), scopes)


@query(
    "H8_pick",
    "WITH m AS (SELECT DISTINCT o_custkey, 'o' || o_orderkey AS uid FROM orders WHERE o_orderkey % 3 = 0), g AS (SELECT o_custkey, count(*) AS n, list_sort(list(uid)) AS l FROM m GROUP BY o_custkey) "
    "SELECT c_custkey, CASE WHEN n = 1 THEN 'found' WHEN n IS NULL THEN 'not_found' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN l[1] END AS uid, CASE WHEN n > 1 THEN array_to_string(l[1:20], ' ') END AS candidates FROM customer LEFT JOIN g ON o_custkey = c_custkey",
)
def _h8(t):
    matches = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("reference"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("uid"))
    return N.pick(t.customer.select(F.col("c_custkey").alias("reference")), matches).select(F.col("reference").alias("c_custkey"), "status", "uid", F.array_join("candidates", " ").alias("candidates"))


@query(
    "G9_reaching_first",
    "SELECT l_orderkey, edge_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY late, pos, edge_id) AS place FROM (SELECT l_orderkey, l_partkey % 40 AS edge_id, min(l_linenumber % 2) AS late, coalesce(min(l_linenumber) FILTER (l_linenumber % 2 = 0), 0) AS pos FROM lineitem GROUP BY ALL)",
)
def _g9(t):
    edges = t.lineitem.select("l_orderkey", (F.col("l_partkey") % 40).alias("edge_id"), F.col("l_linenumber").cast("int").alias("pos"))
    return N.reaching_first(edges.where("pos % 2 = 0"), edges, "l_orderkey")


@query(
    "G12_match_calls",
    f"WITH {_CALLS}, s AS (SELECT o_orderkey, 'f' || o_orderkey % 997 AS path, o_custkey % 500 + 1 AS en, o_orderkey % 3 AS answer FROM orders), eq AS (SELECT c.id, answer FROM s JOIN c ON c.path = s.path AND c.en = s.en), "
    "rest AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.path = s.path AND c.en = s.en)), inn AS (SELECT id, answer, row_number() OVER (PARTITION BY o_orderkey ORDER BY c.en - st, CAST(id AS VARCHAR)) AS k FROM rest JOIN c ON c.path = rest.path AND st <= rest.en - 1 AND rest.en - 1 < c.en) "
    "SELECT id AS call_id, max(answer) AS answer FROM (SELECT id, answer FROM eq UNION ALL SELECT id, answer FROM inn WHERE k = 1) GROUP BY id",
)
def _g12(t):
    answers = t.orders.select(_path("o_orderkey").alias("path"), (F.col("o_custkey") % 500 + 1).cast("int").alias("end"), (F.col("o_orderkey") % 3).alias("answer"))
    return X.match_calls(_calls(t).select("path", F.col("id").cast("string").alias("call_id"), "start", "end"), answers).select(F.col("call_id").cast("long").alias("call_id"), "answer")


# tests, arity, languages, places
@query(
    "D12_test_role",
    "SELECT 'order:' || o_orderkey AS uid, CASE WHEN o_orderkey % 7 = 0 THEN 'test_code' WHEN o_custkey % 6 = 0 THEN 'helper_candidate' WHEN o_orderkey % 4 <> 1 AND o_orderkey % 5 < 2 THEN 'case_candidate' WHEN o_orderkey % 4 = 1 THEN 'container' ELSE 'helper_candidate' END AS role FROM orders WHERE o_orderkey % 3 <> 0",
)
def _d12(t):
    k = F.col("o_orderkey")
    orders = t.orders.select(F.concat(F.lit("order:"), k.cast("string")).alias("uid"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("parent_uid"), F.when(k % 5 == 0, "test").when(k % 5 == 1, "test_x").otherwise("help").alias("name"), F.when(k % 7 == 0, "go").otherwise("python").alias("language"), (k % 4 != 1).alias("callable"), (k % 4 == 1).alias("type"), (k % 3 != 0).alias("is_test"))
    c = F.col("c_custkey")
    customers = t.customer.select(F.concat(F.lit("customer:"), c.cast("string")).alias("uid"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("parent_uid"), F.lit("C").alias("name"), F.lit("python").alias("language"), (c % 6 == 0).alias("callable"), (c % 6 != 0).alias("type"), F.lit(False).alias("is_test"))
    symbols = orders.unionByName(customers)
    return N.test_role(symbols, K.owner_chain(symbols.select("uid", "parent_uid")))


_FLAG = "o_orderkey % {} = 0"


@query("D16_arity_rules_out", "SELECT o_orderkey, o_custkey % 2 = 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND NOT (o_custkey % 6 >= o_orderkey % 4 AND (o_orderkey % 3 = 0 OR o_custkey % 6 <= o_orderkey % 4 + 1)) AS ruled_out FROM orders")
def _d16(t):
    k, args = F.col("o_orderkey"), F.col("o_custkey") % 6
    accepts = L.arity_accepts(k % 4, F.when(k % 3 != 0, k % 4 + 1), args, F.lit("exact"), F.lit(False), F.lit(False), F.lit(False))
    return t.orders.select("o_orderkey", N.arity_rules_out(accepts, F.col("o_custkey") % 2 == 0, k % 5 != 0, k % 7 == 0, k % 11 == 0, k % 13 == 0).alias("ruled_out"))


@query(
    "D20_arity_excludes",
    "WITH m AS (SELECT p_partkey % 50 AS family, 'n' || p_partkey % 7 AS name, p_partkey % 3 AS least, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 3 + 1 END AS most FROM part WHERE p_partkey % 11 <> 0) "
    "SELECT o_orderkey AS occurrence, EXISTS (SELECT 1 FROM m WHERE m.family = o_custkey % 50 AND m.name = 'n' || o_orderkey % 5) AND NOT EXISTS (SELECT 1 FROM m WHERE m.family = o_custkey % 50 AND m.name = 'n' || o_orderkey % 5 AND least <= o_orderkey % 4 AND (most IS NULL OR o_orderkey % 4 <= most)) AS excluded FROM orders",
)
def _d20(t):
    p, k = F.col("p_partkey"), F.col("o_orderkey")
    members = t.part.select((p % 50).alias("family"), F.concat(F.lit("n"), (p % 7).cast("string")).alias("name"), p.alias("member"), (p % 3).alias("required"), F.when(p % 4 != 0, p % 3 + 1).alias("most"), (p % 11 == 0).alias("synthetic"))
    return N.arity_excludes(t.orders.select(k.alias("occurrence"), (F.col("o_custkey") % 50).alias("family"), F.concat(F.lit("n"), (k % 5).cast("string")).alias("name"), (k % 4).alias("args")), members)


_LANGUAGES = ["c", "cpp", "python", "proto", "go"]


@query(
    "D18_other_language",
    f"WITH l AS (SELECT o_orderkey, {_LANGUAGES}[1 + o_orderkey % 5] AS x, list_filter([CASE WHEN o_custkey % 4 <> 0 THEN {_LANGUAGES}[1 + o_custkey % 5] END, CASE WHEN o_custkey % 3 <> 0 THEN {_LANGUAGES}[1 + o_custkey // 5 % 5] END], lambda f: f IS NOT NULL) AS fam FROM orders) "
    "SELECT o_orderkey, x <> 'proto' AND len(fam) > 0 AND len(list_filter(fam, lambda f: f = 'proto' OR f = x OR (f IN ('c', 'cpp') AND x IN ('c', 'cpp')))) = 0 AS other FROM l",
)
def _d18(t):
    pick = lambda n: F.get(F.array(*map(F.lit, _LANGUAGES)), n.cast("int"))
    c = F.col("o_custkey")
    family = F.array_compact(F.array(F.when(c % 4 != 0, pick(c % 5)), F.when(c % 3 != 0, pick(F.floor(c / 5) % 5))))
    return t.orders.select("o_orderkey", N.other_language(pick(F.col("o_orderkey") % 5), family, M.same_namespace).alias("other"))


_PLACE = "concat(element_at(array('', 'packaging/', 'src/pkg/brew/', 'pkg/api/', 'ci/', 'src/ci/', 'Docker/x/', 'app/', 'lib/debian/'), 1 + CAST(p_partkey % 9 AS INT)), element_at(array('Dockerfile.dev', 'install.sh', 'Release_all.py', 'a.go', 'PKGBUILD', 'reinstall.sh'), 1 + CAST(p_size % 6 AS INT)))"
_PLACE_SQL = _PLACE.replace("element_at(array(", "([").replace("), 1 +", "])[1 +").replace(" AS INT))", " AS INT)]")


@query(
    "D22_is_packaging_location",
    f"WITH x AS (SELECT p_partkey, {_PLACE_SQL} AS path FROM part), y AS (SELECT *, lower(path) AS low, string_split(lower(path), '/') AS s FROM x) "
    f"SELECT p_partkey, path, list_has_any(s[1:len(s) - 1], {[d.lower() for d in N.PACKAGING_DIRS]}) OR regexp_matches('/' || low, '/pkg/({'|'.join(N.PKG_SYSTEMS)})/') OR (len(s) > 1 AND s[1] = 'ci' AND p_partkey % 2 = 0) OR s[len(s)] = 'pkgbuild' OR starts_with(s[len(s)], 'dockerfile') OR (len(s) = 1 AND regexp_matches(s[1], '^(install|release|publish)')) AS packaging FROM y",
)
def _d22(t):
    return t.part.select("p_partkey", F.expr(_PLACE).alias("path")).select("p_partkey", "path", N.is_packaging_location(F.col("path"), F.col("p_partkey") % 2 == 0).alias("packaging"))


_CHANGED = "concat(element_at(array('', 'src/', 'node_modules/a/', '.git/', 'Build/x/', 'a/.cache/', 'lib/sub/'), 1 + CAST(p_partkey % 7 AS INT)), element_at(array('.env', 'id_rsa', 'main.py', 'key.pem', 'build', 'a.KEY', 'x.txt'), 1 + CAST(p_size % 7 AS INT)))"
_CHANGED_SQL = _CHANGED.replace("element_at(array(", "([").replace("), 1 +", "])[1 +").replace(" AS INT))", " AS INT)]")
_RELEVANT = (
    "(len(list_filter({s}[1:len({s}) - 1], lambda d: starts_with(d, '.') OR lower(d) IN ('node_modules', 'build'))) = 0 AND NOT starts_with({s}[len({s})], '.') AND lower({s}[len({s})]) <> 'id_rsa' AND NOT regexp_matches(lower({s}[len({s})]), '[.](pem|key)$'))"
)


@query("Q9_relevant_path", f"SELECT p_partkey, path, {_RELEVANT.format(s='s')} AS relevant FROM (SELECT p_partkey, path, string_split(path, '/') AS s FROM (SELECT p_partkey, {_CHANGED_SQL} AS path FROM part))")
def _q9(t):
    return t.part.select("p_partkey", F.expr(_CHANGED).alias("path")).select("p_partkey", "path", N.relevant_path(F.col("path")).alias("relevant"))


@query(
    "Q8_changes_of",
    f"WITH e AS (SELECT p_partkey AS event_id, p_partkey % 10 = 0 OR p_partkey % 13 = 0 AS lost, {_CHANGED_SQL} AS a, p_name AS b FROM part WHERE p_partkey % 4 <> 0) "
    f"SELECT event_id, lost AS overflow, CASE WHEN lost THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter([a, b], lambda x: {_RELEVANT.format(s='string_split(x, chr(47))')}))), '|') END AS paths FROM e",
)
def _q8(t):
    k = F.col("p_partkey")
    paths = F.when(k % 13 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.expr(_CHANGED), "p_name"))
    events = t.part.select(k.alias("event_id"), F.when(k % 4 == 0, "access").otherwise("modify").alias("kind"), (k % 10 == 0).alias("rescan"), paths.alias("paths"))
    return N.changes_of(events).withColumn("paths", F.array_join("paths", "|"))


@query("Q4_failed", "SELECT o_orderkey, o_orderkey * 1000 + CASE WHEN o_custkey % 3 = 0 THEN 250 ELSE 10000 END AS retry_at, o_custkey % 3 <> 0 AS reported FROM orders")
def _q4(t):
    at = N.retry(F.col("o_orderkey") * 1000, F.col("o_custkey") % 3 == 0)
    return t.orders.select("o_orderkey", at.alias("at")).select("o_orderkey", "at.retry_at", "at.reported")


@query(
    "B13_journal_wants_compaction",
    "SELECT path, coalesce(n >= 16 OR total * 4 > coalesce(base, 0), false) AS wants FROM (SELECT 'j' || l_orderkey % 2000 AS path, count(*) AS n, sum(l_partkey) AS total FROM lineitem GROUP BY 1) FULL JOIN (SELECT 'j' || c_custkey AS path, c_custkey * 100 AS base FROM customer) USING (path)",
)
def _b13(t):
    segments = t.lineitem.select(F.concat(F.lit("j"), (F.col("l_orderkey") % 2000).cast("string")).alias("path"), F.col("l_partkey").alias("bytes"))
    return N.wants_compaction(segments, t.customer.select(F.concat(F.lit("j"), F.col("c_custkey").cast("string")).alias("path"), (F.col("c_custkey") * 100).alias("bytes")))


# positions and selectors
_KINDS = ["pos", "kw", "pos_or_kw", "rest", "last", "named_by", "command", "code", "receiver", "field", "result"]


@query(
    "M14_selects",
    f"WITH s AS (SELECT o_orderkey, {_KINDS}[1 + o_orderkey % 11] AS kind, o_custkey % 3 AS a0, 'k' || o_custkey % 2 AS w, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey // 11 % 4 END AS i, CASE WHEN o_orderkey % 3 = 0 THEN 'k1' END AS kw, o_custkey % 5 AS n FROM orders) "
    "SELECT o_orderkey, coalesce(CASE WHEN kind IN ('pos', 'named_by', 'command', 'code') THEN i = a0 WHEN kind = 'kw' THEN kw = w WHEN kind = 'pos_or_kw' THEN coalesce(i = a0, false) OR coalesce(kw = w, false) WHEN kind = 'rest' THEN i >= a0 WHEN kind = 'last' THEN n > 0 AND i + 1 = n ELSE false END, false) AS selected FROM s",
)
def _m14(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.get(F.array(*map(F.lit, _KINDS)), (k % 11).cast("int"))
    return t.orders.select("o_orderkey", N.selects(kind, c % 3, F.concat(F.lit("k"), (c % 2).cast("string")), F.when(k % 5 != 0, F.floor(k / 11) % 4), F.when(k % 3 == 0, "k1"), c % 5).alias("selected"))


@query(
    "M8_byte_of_utf16",
    "WITH x AS (SELECT p_partkey, p_partkey % 40 AS ch, string_split(p_name || 'é😀' || p_type || '日', '') AS s FROM part), y AS (SELECT p_partkey, ch, unnest(range(0, len(s) + 1)) AS i, s FROM x), "
    "z AS (SELECT p_partkey, ch, coalesce(list_sum(list_transform(s[1:i], lambda c: CASE WHEN strlen(c) = 4 THEN 2 ELSE 1 END)), 0) AS u, coalesce(list_sum(list_transform(s[1:i], lambda c: strlen(c))), 0) AS b FROM y) "
    "SELECT p_partkey, CASE WHEN max(u) <= max(ch) THEN max(b) ELSE max(b) FILTER (u = ch) END AS byte FROM z GROUP BY p_partkey",
)
def _m8(t):
    line = F.concat("p_name", F.lit("é😀"), "p_type", F.lit("日"))
    return t.part.select("p_partkey", N.byte_of_utf16(line, F.col("p_partkey") % 40).alias("byte"))


@query(
    "S3_member_point",
    "WITH x AS (SELECT p_partkey, 'é.' || p_name AS callee, CASE WHEN p_partkey % 3 = 0 THEN 'other' WHEN p_partkey % 5 <> 0 THEN split_part(p_name, ' ', -1) END AS member, p_partkey % 100 AS st FROM part) "
    "SELECT p_partkey, CASE WHEN member IS NOT NULL AND ends_with(callee, member) THEN st + strlen(callee) - strlen(member) ELSE st END AS point FROM x",
)
def _s3(t):
    k = F.col("p_partkey")
    callee = F.concat(F.lit("é."), "p_name")
    member = F.when(k % 3 == 0, "other").when(k % 5 != 0, F.element_at(F.split("p_name", " "), -1))
    return t.part.select("p_partkey", N.member_point(callee, member, k % 100, k % 100 + F.octet_length(callee)).alias("point"))


_ANSWER = "CASE o_orderkey % 4 WHEN 0 THEN concat('{\"line\": ', o_custkey, ', \"character\": ', o_orderkey, '}') WHEN 1 THEN concat('{\"line\": -', o_custkey, ', \"character\": 1}') WHEN 2 THEN '{\"line\": 4294967296, \"character\": 1}' ELSE '{\"line\": \"x\"}' END"


@query("S4_position", f"SELECT o_orderkey, CASE WHEN line BETWEEN 0 AND 4294967295 AND ch BETWEEN 0 AND 4294967295 THEN line END AS line, CASE WHEN line BETWEEN 0 AND 4294967295 AND ch BETWEEN 0 AND 4294967295 THEN ch END AS character FROM (SELECT o_orderkey, TRY_CAST(json_extract(a, '$.line') AS BIGINT) AS line, TRY_CAST(json_extract(a, '$.character') AS BIGINT) AS ch FROM (SELECT o_orderkey, {_ANSWER} AS a FROM orders))")
def _s4(t):
    return t.orders.select("o_orderkey", N.position(F.expr(_ANSWER)).alias("at")).select("o_orderkey", F.col("at.line").alias("line"), F.col("at.character").alias("character"))


@query(
    "C19_signature",
    "SELECT doc_id, regexp_replace(substr(text, s + 1, least(CASE WHEN b > s THEN b WHEN nl > 0 THEN s + nl - 1 ELSE length(text) END, e) - s), '\\s+$', '') AS signature FROM (SELECT doc_id, text, 5 AS s, CASE WHEN doc_id % 3 = 0 THEN 40 ELSE 0 END AS b, 200 AS e, instr(substr(text, 6), chr(10)) AS nl FROM documents)",
)
def _c19(t):
    return t.documents.select("doc_id", N.signature(F.col("text"), F.lit(5), F.lit(200), F.when(F.col("doc_id") % 3 == 0, 40).otherwise(0)).alias("signature"))


# calls and answers
_KIND_OF = "CASE {a} % 3 WHEN 0 THEN 'await' WHEN 1 THEN 'iterate' ELSE 'plain' END"
_RUNS = "CASE {b} % 3 WHEN 0 THEN 'ordinary' WHEN 1 THEN 'coroutine' ELSE 'generator' END"


@query(
    "S11_call_edge",
    "SELECT o_orderkey, CASE WHEN ty AND o_orderkey % 7 = 0 THEN 'references' WHEN ty OR (o_orderkey % 5 = 0 AND o_custkey % 4 = 1) THEN 'constructor' WHEN x = 'ordinary' THEN 'calls' WHEN a = 'await' THEN 'awaits' WHEN a = 'iterate' THEN 'iterates' WHEN x = 'coroutine' THEN 'creates_coroutine' ELSE 'creates_generator' END AS kind FROM "
    f"(SELECT *, o_custkey % 4 = 0 AS ty, {_KIND_OF.format(a='o_orderkey')} AS a, {_RUNS.format(b='o_custkey')} AS x FROM orders)",
)
def _s11(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select("o_orderkey", N.call_edge_kind(k % 7 == 0, c % 4 == 0, k % 5 == 0, c % 4 == 1, F.expr(_KIND_OF.format(a="o_orderkey")), F.expr(_RUNS.format(b="o_custkey"))).alias("kind"))


@query("S20_narrow_by_arity", "SELECT call_id, target FROM (SELECT l_orderkey AS call_id, l_partkey AS target, l_linenumber % 3 = 0 OR l_suppkey % 3 <> 1 AS fits FROM lineitem) QUALIFY fits OR NOT bool_or(fits) OVER (PARTITION BY call_id)")
def _s20(t):
    targets = t.lineitem.select(F.col("l_orderkey").alias("call_id"), F.col("l_partkey").alias("target"), (F.col("l_linenumber") % 3 != 0).alias("callable"), F.when(F.col("l_suppkey") % 3 < 2, F.col("l_suppkey") % 3 == 0).alias("accepts"))
    return N.narrow_by_arity(targets).select("call_id", "target")


@query(
    "S24_syntax_definition",
    "WITH d AS (SELECT p_partkey, 'f' || p_partkey % 5 AS path, 'n' || (p_partkey - CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) AS name, p_partkey % 4 <> 0 AS ok, p_partkey % 100 AS st FROM part), u AS (SELECT name, min(p_partkey) AS p_partkey FROM d GROUP BY name HAVING count(*) = 1) "
    "SELECT o_orderkey AS call_id, d.p_partkey AS uid FROM orders JOIN u ON u.name = 'n' || o_custkey JOIN d USING (p_partkey) WHERE d.path = 'f' || o_orderkey % 5 AND ok AND st <= o_orderkey % 200 AND o_orderkey % 7 <> 0",
)
def _s24(t):
    p, k = F.col("p_partkey"), F.col("o_orderkey")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    declarations = t.part.select(text("f", p % 5).alias("path"), text("n", p - F.when(p % 3 == 0, 1).otherwise(0)).alias("name"), p.alias("uid"), (p % 4 != 0).alias("callable"), F.lit(True).alias("top_level"), (p % 100).alias("start"))
    calls = t.orders.select(k.alias("call_id"), text("f", k % 5).alias("path"), text("n", F.col("o_custkey")).alias("name"), F.when(k % 7 == 0, "x").alias("receiver"), F.lit(False).alias("local"), (k % 200).alias("start"))
    return N.syntax_definition(calls, declarations)


@query(
    "S25_implementable",
    "SELECT p_partkey, p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_size % 3 < 2 AND (p_size % 3 = 1 OR p_partkey % 4 = 0 OR regexp_matches(lower(d), 'abstract|(^|[^a-z0-9_])(virtual|open)([^a-z0-9_]|$)')) AS implementable FROM (SELECT *, ['@abstractmethod', 'virtual', '@opener', 'x.Open()', 'final'][1 + p_partkey % 5] AS d FROM part)",
)
def _s25(t):
    p = F.col("p_partkey")
    decorators = F.array(F.get(F.array(*map(F.lit, ("@abstractmethod", "virtual", "@opener", "x.Open()", "final"))), (p % 5).cast("int")))
    parent = F.when(F.col("p_size") % 3 == 0, "class").when(F.col("p_size") % 3 == 1, "interface").otherwise("module")
    return t.part.select("p_partkey", N.implementable(p % 5 != 0, p % 7 == 0, p % 11 == 0, parent, p % 4 == 0, decorators).alias("implementable"))


@query("S26_request_unique", "SELECT l_orderkey * 10 + l_linenumber AS id, min(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_returnflag, l_partkey) AS asked FROM lineitem")
def _s26(t):
    return N.request_unique(t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("method"), F.col("l_partkey").alias("params")))


# projections
@query("C2_at", "SELECT c_custkey, n_name AS path, c_custkey % 90 AS line, c_custkey AS start_byte, c_custkey + 7 AS end_byte FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _c2(t):
    k = F.col("c_custkey")
    rows = N.located(t.customer.select("c_custkey", F.col("c_nationkey").alias("file_id"), (k % 90).alias("line"), k.alias("start"), (k + 7).alias("end")), t.nation.select(F.col("n_nationkey").alias("file_id"), F.col("n_name").alias("path")))
    return rows.select("c_custkey", "at.path", "at.line", F.col("at.start").alias("start_byte"), F.col("at.end").alias("end_byte"))


def _sites(t):
    sites = A.sites(t).select(F.col("site_id").alias("site"), F.col("owner_uid").alias("owner"), "category", "candidates", F.substring("site_id", 6, 20).cast("long").alias("k"))
    decided = F.col("k") % 2 == 0
    decisions = sites.where("k % 3 <> 0").select("site", decided.alias("decided"), F.when(~decided, F.concat(F.lit("r"), (F.col("k") % 4).cast("string"))).alias("reason"), F.slice("candidates", 1, 1).alias("targets"))
    return sites.drop("k"), decisions


_DECIDED = f"WITH {A.SITES_SQL}, s AS (SELECT *, CAST(substr(site_id, 6) AS BIGINT) AS k FROM sites)"
_STATUS = "CASE WHEN k % 2 = 0 THEN 'decided' ELSE 'unknown' END AS status, CASE WHEN k % 2 <> 0 THEN 'r' || k % 4 END AS reason"


@query("C5_decision_info", f"{_DECIDED} SELECT site_id AS site, category, {_STATUS} FROM s WHERE k % 3 <> 0")
def _c5(t):
    return N.decision_info(*_sites(t))


@query(
    "C18_site_rows",
    f"{_DECIDED} SELECT site_id AS site, owner_uid AS owner, category, array_to_string(candidates, ' ') AS candidates, CASE WHEN k % 6 IN (2, 4) THEN 'decided' ELSE 'unknown' END AS status, CASE WHEN k % 3 = 0 THEN 'no decision recorded' WHEN k % 2 <> 0 THEN 'r' || k % 4 END AS reason, CASE WHEN k % 6 IN (2, 4) THEN candidates[1] ELSE '' END AS decided_targets FROM s WHERE k IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
)
def _c18(t):
    owners = t.orders.where("o_orderstatus = 'F'").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("owner"))
    rows = N.site_rows(*_sites(t), owners)
    return rows.withColumns({c: F.array_join(c, " ") for c in ("candidates", "decided_targets")})


@query(
    "C6_bridge_info",
    "SELECT o_orderkey AS bridge, o_orderstatus AS kind, 'customer:' || o_custkey AS from_uid, 'nation:' || o_custkey % 25 AS to_uid, c_mktsegment AS from_language, n_name AS to_language FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = o_custkey % 25",
)
def _c6(t):
    uid = lambda kind, key: F.concat(F.lit(f"{kind}:"), key.cast("string"))
    symbols = t.customer.select(uid("customer", F.col("c_custkey")).alias("uid"), F.col("c_mktsegment").alias("language")).unionByName(t.nation.select(uid("nation", F.col("n_nationkey")).alias("uid"), F.col("n_name").alias("language")))
    return N.bridge_info(t.orders.select(F.col("o_orderkey").alias("bridge"), F.col("o_orderstatus").alias("kind"), uid("customer", F.col("o_custkey")).alias("from_uid"), uid("nation", F.col("o_custkey") % 25).alias("to_uid")), symbols)


@query(
    "C11_narrow_to_member",
    "WITH e AS (SELECT o_orderkey AS id, 'f' || o_orderkey % 97 AS path, o_custkey % 500 AS st, o_custkey % 500 + 30 AS en, 'm' || o_orderkey % 10 AS name, o_orderkey % 3 = 0 AS tail FROM orders), m AS (SELECT 'f' || l_orderkey % 97 AS path, l_partkey % 500 AS st, l_partkey % 500 + 2 + l_linenumber % 2 AS en, 'm' || l_suppkey % 10 AS name FROM lineitem), "
    "b AS (SELECT id, max(m.en) AS last FROM e JOIN m ON m.path = e.path AND m.name = e.name AND e.st <= m.st AND m.en <= e.en AND m.en - m.st = 2 GROUP BY id) "
    "SELECT id, CASE WHEN last IS NOT NULL THEN last - 2 WHEN tail THEN en - 2 ELSE st END AS start, coalesce(last, en) AS \"end\" FROM e LEFT JOIN b USING (id)",
)
def _c11(t):
    k, start, at = F.col("o_orderkey"), F.col("o_custkey") % 500, F.col("l_partkey") % 500
    path = lambda key: F.concat(F.lit("f"), (F.col(key) % 97).cast("string"))
    name = F.concat(F.lit("m"), (k % 10).cast("string"))
    evidence = t.orders.select(k.alias("id"), path("o_orderkey").alias("path"), start.alias("start"), (start + 30).alias("end"), name.alias("name"), F.when(k % 3 == 0, F.concat(F.lit("x."), name)).otherwise("y()").alias("text"))
    members = t.lineitem.select(path("l_orderkey").alias("path"), at.alias("start"), (at + 2 + F.col("l_linenumber") % 2).alias("end"), F.concat(F.lit("m"), (F.col("l_suppkey") % 10).cast("string")).alias("name"))
    return N.narrow_to_member(evidence, members)


@query(
    "C16_callback_argument_span",
    "WITH e AS (SELECT o_orderkey AS edge, o_custkey AS callee, 'a' || o_orderkey % 6 AS argument FROM orders), g AS (SELECT l_orderkey AS callee, CASE WHEN l_partkey % 2 = 0 THEN 'x.' ELSE '' END || 'a' || l_suppkey % 6 AS spelled, 'a' || l_partkey % 9 AS name, l_partkey AS st FROM lineitem), "
    "f AS (SELECT edge, min(st) FILTER (spelled = argument) AS exact, count(*) FILTER (name = argument OR split_part(spelled, '.', -1) = argument) AS n, min(st) FILTER (name = argument OR split_part(spelled, '.', -1) = argument) AS one FROM e JOIN g USING (callee) GROUP BY edge) "
    "SELECT edge, coalesce(exact, CASE WHEN n = 1 THEN one END) AS start FROM f WHERE exact IS NOT NULL OR n = 1",
)
def _c16(t):
    edges = t.orders.select(F.col("o_orderkey").alias("edge"), F.col("o_custkey").alias("callee"), F.concat(F.lit("a"), (F.col("o_orderkey") % 6).cast("string")).alias("argument"))
    spelled = F.concat(F.when(F.col("l_partkey") % 2 == 0, "x.").otherwise(""), F.lit("a"), (F.col("l_suppkey") % 6).cast("string"))
    return N.callback_span(edges, t.lineitem.select(F.col("l_orderkey").alias("callee"), spelled.alias("argument"), F.concat(F.lit("a"), (F.col("l_partkey") % 9).cast("string")).alias("name"), F.col("l_partkey").alias("start")))


# hierarchies
@query(
    "R22_overrides",
    f"WITH RECURSIVE {_BASES}, r(c, up) AS (SELECT c, base FROM b UNION SELECT r.c, b.base FROM r JOIN b ON b.c = r.up) SELECT r.up AS uid, r.c AS override FROM r JOIN part a ON a.p_partkey = r.up JOIN part o ON o.p_partkey = r.c AND o.p_size % 10 = a.p_size % 10",
)
def _r22(t):
    methods = t.part.select(F.col("p_partkey").alias("class"), (F.col("p_size") % 10).alias("name"), F.col("p_partkey").alias("uid"))
    return N.overriding(Y.ancestors(_bases(t)), methods)


@query(
    "J14_depth_first",
    "WITH RECURSIVE b AS (SELECT p_partkey AS c, 0 AS pos, p_partkey // 2 AS base FROM part WHERE p_partkey >= 2 UNION ALL SELECT p_partkey, 1, p_partkey // 3 FROM part WHERE p_partkey >= 9 AND p_partkey % 3 = 0), "
    "r(cls, uid, way) AS (SELECT DISTINCT c, c, CAST([] AS INTEGER[]) FROM b UNION ALL SELECT cls, base, list_append(way, pos) FROM r JOIN b ON b.c = r.uid), f AS (SELECT cls, uid, min(way) AS way FROM r GROUP BY cls, uid) "
    "SELECT cls, uid, row_number() OVER (PARTITION BY cls ORDER BY way) - 1 AS pos FROM f",
)
def _j14(t):
    return Y.resolution_order(_bases(t), Y.depth_first).select("cls", "uid", "pos")
