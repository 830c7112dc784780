"""Queries of the scalar functions (families K, L, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import hashing as H
from graphloom.functions import paths as P
from graphloom.functions import text as T
from graphloom.plans.registry import query, scalar

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def tokens_sql(x: str) -> str:
    spaced = rf"regexp_replace(regexp_replace({x}, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')"
    return rf"list_filter(list_transform(string_split_regex({spaced}, '[^\p{{L}}\p{{N}}]+'), lambda w: lower(w)), lambda w: w <> '' AND NOT list_contains({STOP_SQL}, w))"


def fold_sql(w: str) -> str:
    stem = lambda s: f"left({w}, length({w}) - {len(s)})" + (" || 'y'" if s == "ies" else "")
    return "CASE " + " ".join(f"WHEN ends_with({w}, '{s}') AND length({w}) >= {len(s) + 4} THEN {stem(s)}" for s in T.SUFFIXES) + f" ELSE {w} END"


def terms_sql(x: str) -> str:
    return f"list_transform(list_filter({tokens_sql(x)}, lambda w: length(w) > 1), lambda w: {fold_sql('w')})"


scalar("K1_tokens", "documents", "doc_id", "text", lambda x: F.array_join(T.tokens(x), " "), f"array_to_string({tokens_sql('{x}')}, ' ')")
scalar("K2_fold", "part", "p_partkey", "concat(lower(p_type), CASE p_partkey % 7 WHEN 0 THEN 'ations' WHEN 1 THEN 'ies' WHEN 2 THEN 'ers' WHEN 3 THEN 'ed' WHEN 4 THEN 'ings' WHEN 5 THEN 's' ELSE '' END)", T.fold, fold_sql("{x}"))
scalar("K3_terms", "documents", "doc_id", "text", lambda x: F.array_join(T.terms(x), " "), f"array_to_string({terms_sql('{x}')}, ' ')")

_QUALIFIED = "concat(CASE p_partkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN '::' ELSE '' END, replace(p_brand, '#', ''), CASE p_partkey % 4 WHEN 0 THEN '::' WHEN 1 THEN '.' WHEN 2 THEN ':' ELSE '<T<A>>::' END, replace(p_name, ' ', '_'), CASE p_partkey % 5 WHEN 0 THEN '()' WHEN 1 THEN '<K, V<W>>' WHEN 2 THEN '<open' ELSE '' END)"
_cut = "{x}"
for _ in range(6):
    _cut = rf"regexp_replace({_cut}, '([\p{{L}}\p{{N}}_])<[^<>]*>', '\1', 'g')"
_trimmed = r"regexp_replace(trim({x}), '\(\)$', '')"
scalar("K4_normalize_qualified", "part", "p_partkey", _QUALIFIED, T.normalize_qualified, r"trim(regexp_replace(regexp_replace(" + _cut.replace("{x}", _trimmed) + r", '([\p{L}\p{N}_])<.*$', '\1'), '\.?:+', '.', 'g'), '.')")

_PATH = "concat('src/', lower(p_type), '/', replace(p_name, ' ', '_'), CASE p_partkey % 5 WHEN 0 THEN '/__init__.py' WHEN 1 THEN '/index.ts' WHEN 2 THEN '/mod.rs' WHEN 3 THEN '.go' ELSE '' END)"
scalar("K5_module_path", "part", "p_partkey", _PATH, T.module_path, r"replace(regexp_replace(CASE WHEN contains({x}, '.') THEN regexp_extract({x}, '^(.*)\.[^.]*$', 1) ELSE {x} END, '/(__init__|index|mod)$', ''), '/', '.')")

_CALLEE = "concat(replace(p_brand, '#', ''), CASE p_partkey % 6 WHEN 0 THEN '.' WHEN 1 THEN '::' WHEN 2 THEN '->' WHEN 3 THEN '?.' WHEN 4 THEN ' + ' ELSE '.a.' END, CASE p_partkey % 4 WHEN 0 THEN '9' ELSE '' END, split_part(p_name, ' ', 1))"
_tail = r"regexp_replace(trim({x}), '^.*(\.|::|->)', '')"
scalar("K6_member_of", "part", "p_partkey", _CALLEE, T.member_of, rf"CASE WHEN regexp_full_match({_tail}, '[_$\p{{L}}][_$\p{{L}}\p{{N}}]*') THEN {_tail} END")
scalar("K7_member_tail", "part", "p_partkey", _CALLEE, T.member_tail, "trim(list_last(string_split_regex({x}, '[.>:]')))")
_BASE = "concat(CASE p_partkey % 4 WHEN 0 THEN 'public ' WHEN 1 THEN 'ns::' WHEN 2 THEN 'pkg.mod.' ELSE '*' END, replace(p_brand, '#', ''), CASE p_partkey % 5 WHEN 0 THEN '<T>' WHEN 1 THEN '[int]' WHEN 2 THEN '(x)' WHEN 3 THEN ' = 3' ELSE ' &' END)"
_head = r"trim(regexp_extract(trim({x}), '^([^\[<({]*)', 1))"
scalar("K8_base_name", "part", "p_partkey", _BASE, T.base_name, r"CASE WHEN contains({x}, '=') THEN '' ELSE trim(list_last(string_split(list_last(string_split(list_last(string_split_regex(" + _head + r", '\s')), '::')), '.')), '*&(),:') END")
scalar("K9_is_identifier", "part", "p_partkey", "CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN concat('$', p_type) ELSE concat('9', p_type) END", T.is_identifier, r"regexp_full_match({x}, '[_$\p{L}][_$\p{L}\p{N}]*')")

_SEPS = ["::", "\\", "?.", "&.", "->", ".", ":", "$"]


@query(
    "K10_split_callee",
    "WITH c AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 8 THEN 'other text' ELSE concat(CASE WHEN p_partkey % 11 = 0 THEN '' ELSE concat('a.', p_type, ' ', ['::', '\\', '?.', '&.', '->', '.', ':', '$'][1 + p_partkey % 8]) END, p_size) END AS callee, CAST(p_size AS VARCHAR) AS member FROM part), "
    "q AS (SELECT *, rtrim(left(trim(callee), length(trim(callee)) - length(member))) AS prefix FROM c) "
    "SELECT p_partkey, callee, member, CASE WHEN NOT ends_with(callee, member) THEN 'other' WHEN prefix = '' THEN NULL WHEN ends_with(prefix, '::') OR ends_with(prefix, '\\') THEN 'path' WHEN regexp_matches(prefix, '(\\?\\.|&\\.|->|\\.|:|\\$)$') THEN 'recv' ELSE 'other' END AS form, "
    "CASE WHEN NOT ends_with(callee, member) OR prefix = '' THEN '' ELSE CASE WHEN regexp_matches(prefix, '(::|\\?\\.|&\\.|->)$') THEN trim(left(prefix, length(prefix) - 2)) WHEN regexp_matches(prefix, '[\\\\.:$]$') THEN trim(left(prefix, length(prefix) - 1)) ELSE '' END END AS qualifier FROM q",
)
def _k10(t):
    seps = F.array(*map(F.lit, _SEPS))
    callee = F.when(F.col("p_partkey") % 9 == 8, "other text").otherwise(F.concat(F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.concat(F.lit("a."), "p_type", F.lit(" "), F.get(seps, (F.col("p_partkey") % 8).cast("int")))), F.col("p_size").cast("string")))
    made = t.part.select("p_partkey", callee.alias("callee"), F.col("p_size").cast("string").alias("member"))
    out = made.withColumn("s", T.split_callee(F.col("callee"), F.col("member")))
    return out.select("p_partkey", "callee", "member", "s.form", "s.qualifier")


scalar("K11_truncate_chars", "documents", "doc_id", "text", lambda x: T.truncate_chars(x, 160), "left({x}, 160)")
scalar("K12_one_line", "documents", "doc_id", "concat('f(', chr(10), '  ', substr(text, 1, 200), ',', chr(10), ')')", T.one_line, r"regexp_replace(regexp_replace(regexp_replace(trim({x}), ',?\s*[\n\r]\s*([)\]}])', '\1', 'g'), '([(\[{])\s*[\n\r]\s*', '\1', 'g'), '\s*[\n\r]\s*', ' ', 'g')")


@query(
    "K13_negate_text",
    "WITH c AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE '' END AS condition, p_partkey % 4 = 0 AS truthy, ['python', 'bash', 'rust', 'haskell'][1 + p_size % 4] AS language FROM part) "
    "SELECT p_partkey, condition, truthy, language, CASE WHEN truthy OR condition = '' THEN condition WHEN language = 'bash' THEN '! ' || condition WHEN language IN ('python', 'haskell') THEN 'not ' || CASE WHEN contains(condition, ' ') THEN '(' || condition || ')' ELSE condition END ELSE '!' || CASE WHEN contains(condition, ' ') THEN '(' || condition || ')' ELSE condition END END AS negated FROM c",
)
def _k13(t):
    condition = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.col("p_type")).otherwise("")
    language = F.get(F.array(*map(F.lit, ("python", "bash", "rust", "haskell"))), F.col("p_size") % 4)
    made = t.part.select("p_partkey", condition.alias("condition"), (F.col("p_partkey") % 4 == 0).alias("truthy"), language.alias("language"))
    return made.withColumn("negated", T.negate_text(F.col("condition"), F.col("truthy"), F.col("language")))


_SNAKE = "concat(CASE p_partkey % 3 WHEN 0 THEN '__' WHEN 1 THEN '_' ELSE '' END, replace(p_name, ' ', CASE p_partkey % 2 WHEN 0 THEN '_' ELSE '__' END), CASE p_partkey % 5 WHEN 0 THEN '_' ELSE '' END)"
scalar("K14_camel_case", "part", "p_partkey", _SNAKE, T.camel_case, "regexp_extract({x}, '^(_*)', 1) || array_to_string(list_transform(list_filter(string_split_regex(ltrim({x}, '_'), '_+'), lambda p: p <> ''), lambda p, i: CASE WHEN i = 1 THEN p ELSE upper(p[1]) || p[2:] END), '')")
scalar("K15_lower_first", "customer", "c_custkey", "c_name", T.lower_first, "lower({x}[1]) || {x}[2:]")


def _mangled(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN regexp_matches(c, '^[a-zA-Z0-9]$') THEN c WHEN c = '_' THEN '_1' WHEN c = ';' THEN '_2' WHEN c = '[' THEN '_3' ELSE '_0' || lpad(lower(to_hex(unicode(c))), 4, '0') END), '')"


@query("K16_jni_mangle", f"SELECT p_partkey, 'Java_' || {_mangled('lower(p_type)')} || '_' || {_mangled('p_brand')} || '_' || {_mangled(chr(39) + 'é' + chr(39) + ' || p_name')} AS symbol FROM part")
def _k16(t):
    return t.part.select("p_partkey", T.jni_mangle(F.array(F.lower("p_type")), F.array("p_brand"), F.concat(F.lit("é"), "p_name")).alias("symbol"))


scalar("K17_decode_escape", "part", "p_partkey", "concat(chr(92), substr(p_name, 1 + CAST(p_partkey % 4 AS INT), CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END))", T.decode_escape, r"CASE WHEN length({x}) <> 2 OR {x}[1] <> chr(92) THEN {x} WHEN {x}[2] = 'n' THEN chr(10) WHEN {x}[2] = 't' THEN chr(9) ELSE {x}[2] END")


@query("K18_edit_distance", "SELECT a.p_partkey, a.p_name AS a, b.p_name AS b, CAST(levenshtein(a.p_name, b.p_name) AS INT) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def _k18(t):
    a, b = t.part.select("p_partkey", F.col("p_name").alias("a")), t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return a.join(b, "p_partkey").select("p_partkey", "a", "b", T.edit_distance(F.col("a"), F.col("b")).alias("distance"))


_NAMES = ["red bolt", "blue widget", "small ring", "hot gear", "old"]
_names_sql = " UNION ALL ".join(f"SELECT {i} AS n, '{x}' AS name" for i, x in enumerate(_NAMES))


@query("K19_closest", f"SELECT p_partkey, p_name, (SELECT name FROM (SELECT n, name, levenshtein(p_name, name) AS d FROM ({_names_sql})) WHERE d <= greatest(length(p_name) // 3, 2) OR starts_with(name, p_name) OR starts_with(p_name, name) ORDER BY d, n LIMIT 1) AS closest FROM part")
def _k19(t):
    return t.part.select("p_partkey", "p_name", T.closest(F.col("p_name"), _NAMES).alias("closest"))


scalar("K20_glob_matches", "part", "p_partkey", _PATH, lambda x: T.glob_matches("src/**/{index,mod}.{ts,rs}", x), r"regexp_full_match({x}, 'src/([^/]+/)*(index|mod)\.(ts|rs)')")
scalar("K21_glob_matches_within", "part", "p_partkey", _PATH, lambda x: T.glob_matches_within("*_*/__init__.p[yx]", x), r"CASE WHEN regexp_full_match({x}, '([^/]+/)*[^/]*_[^/]*/__init__\.p[yx]') THEN regexp_extract({x}, '^(.*)/[^/]*_[^/]*/__init__\.p[yx]$', 1) END")

# L: URLs, routes, paths
_ROUTE = "concat(CASE p_partkey % 5 WHEN 0 THEN 'GET ' WHEN 1 THEN 'https://h.example' ELSE '' END, CASE p_partkey % 7 WHEN 6 THEN '' ELSE '/' END, lower(p_type), CASE p_partkey % 6 WHEN 0 THEN '/{id}' WHEN 1 THEN '/:id/x' WHEN 2 THEN '/<int:n>' WHEN 3 THEN '/*' WHEN 4 THEN '/%d' ELSE '//a/' END, CASE p_partkey % 4 WHEN 0 THEN '?q=1' WHEN 1 THEN '#top' ELSE '' END)"
_PARAM = r"(regexp_matches(s, '\{.*\}|<.*>|^:.|%[sdvqxfiu]') OR s = '*')"


@query(
    "L1_normalize",
    f"WITH r AS (SELECT p_partkey, {_ROUTE} AS url FROM part), v AS (SELECT *, nullif(regexp_extract(url, '^(GET|POST) /', 1), '') AS verb, regexp_replace(url, '^(GET|POST) /', '/') AS s0 FROM r), "
    "p AS (SELECT *, CASE WHEN regexp_matches(s0, '^https?://') THEN CASE WHEN regexp_extract(s0, '^https?://[^/]*(.*)$', 1) = '' THEN '/' ELSE regexp_extract(s0, '^https?://[^/]*(.*)$', 1) END ELSE s0 END AS s1 FROM v) "
    f"SELECT p_partkey, url, CASE WHEN starts_with(s1, '/') THEN '/' || array_to_string(list_transform(list_filter(string_split(regexp_extract(s1, '^([^?#]*)', 1), '/'), lambda s: s <> ''), lambda s: CASE WHEN {_PARAM} THEN '{{}}' ELSE s END), '/') END AS path, CASE WHEN starts_with(s1, '/') THEN verb END AS verb FROM p",
)
def _l1(t):
    made = t.part.select("p_partkey", F.expr(_ROUTE).alias("url")).withColumn("n", P.normalize(F.col("url")))
    return made.select("p_partkey", "url", "n.path", "n.verb")


@query("L2_join_paths", "SELECT page_id, CASE WHEN a = '' AND b = '' THEN '/' WHEN b = '' THEN a ELSE a || '/' || b END AS joined FROM (SELECT page_id, rtrim(CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/api/' ELSE '/' END, '/') AS a, ltrim(CASE page_id % 4 WHEN 0 THEN '/' ELSE '//users/1' END, '/') AS b FROM pages)")
def _l2(t):
    k = F.col("page_id")
    return t.pages.select("page_id", P.join_paths(F.when(k % 3 == 0, "").when(k % 3 == 1, "/api/").otherwise("/"), F.when(k % 4 == 0, "/").otherwise("//users/1")).alias("joined"))


scalar("L3_verb_of", "part", "p_partkey", "CASE p_partkey % 6 WHEN 0 THEN 'http.MethodPost' WHEN 1 THEN ':get' WHEN 2 THEN '\"put\"' WHEN 3 THEN 'RequestMethod.DELETE' WHEN 4 THEN p_type ELSE 'Patch' END", P.verb_of, "CASE WHEN upper(regexp_replace(trim(list_last(string_split_regex({x}, '[.:]')), '\"'':'), '^Method', '')) IN ('GET', 'POST', 'PUT', 'DELETE', 'PATCH', 'HEAD', 'OPTIONS', 'TRACE', 'CONNECT') THEN upper(regexp_replace(trim(list_last(string_split_regex({x}, '[.:]')), '\"'':'), '^Method', '')) END")
_SEGMENT = "CASE p_partkey % 8 WHEN 0 THEN '{id}' WHEN 1 THEN ':id' WHEN 2 THEN '<n>' WHEN 3 THEN '*' WHEN 4 THEN 'a%db' WHEN 5 THEN p_type WHEN 6 THEN '{}' ELSE '100%' END"
scalar("L4_is_param", "part", "p_partkey", _SEGMENT, P.is_param, _PARAM.replace("s,", "{x},").replace("s =", "{x} ="))
scalar("L5_printf_verb", "part", "p_partkey", _SEGMENT, P.printf_verb, "regexp_matches({x}, '%[sdvqxfiu]')")
scalar("L6_seg_eq", "part", "p_partkey", _SEGMENT, lambda x: P.seg_eq(x, F.lit("promo"), True), "{x} = '{}' OR lower({x}) = 'promo'")
scalar("L7_method_ok", "part", "p_partkey", "CASE p_partkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN '*' ELSE 'PUT' END", lambda x: P.method_ok(x, F.lit("GET")), "{x} IN ('GET', '*')")
scalar("L8_id_matches", "part", "p_partkey", "CASE p_partkey % 5 WHEN 0 THEN 'getUser' WHEN 1 THEN 'get_user' WHEN 2 THEN 'x-getUser-y' WHEN 3 THEN 'getUser_1' ELSE p_name END", lambda x: P.id_matches(x, F.lit("getUser")), "{x} = 'getUser' OR starts_with({x}, 'getUser_') OR list_contains(string_split({x}, '-'), 'getUser') OR lower(regexp_replace({x}, '[^a-zA-Z0-9]', '', 'g')) = 'getuser'")
scalar("L9_segments", "pages", "page_id", "concat(regexp_replace(url, '^[a-z]+://', ''), CASE page_id % 2 WHEN 0 THEN '/{id}' ELSE '//' END)", lambda x: F.array_join(P.segments(x), "|"), "array_to_string(list_transform(list_filter(string_split({x}, '/'), lambda s: s <> ''), lambda s: CASE WHEN starts_with(s, '{') AND ends_with(s, '}') THEN '{}' ELSE s END), '|')")
scalar("L10_fs_route_key", "part", "p_partkey", "concat('src/routes/', lower(p_type), CASE p_partkey % 3 WHEN 0 THEN '/index.ts' WHEN 1 THEN '/item.page.ts' ELSE '.ts' END)", lambda x: P.fs_route_key("src/routes/**/*.ts", None, x), r"'/' || regexp_replace(regexp_replace(regexp_replace({x}, '^src/routes/', ''), '\.[^/]*$', ''), '/index$', '')")
scalar("L11_command_tokens", "part", "p_partkey", "concat('run  ', '\"', p_type, '\" ', p_name, CASE p_partkey % 2 WHEN 0 THEN ' ''x''' ELSE ' ' END)", lambda x: F.array_join(P.command_tokens(x), "|"), "array_to_string(list_filter(list_transform(string_split_regex({x}, '\\s+'), lambda w: trim(w, '\"''')), lambda w: w <> ''), '|')")
scalar("L12_looks_like_url", "pages", "page_id", "CASE page_id % 3 WHEN 0 THEN upper(url) WHEN 1 THEN substr(url, 9) ELSE '/x' END", P.looks_like_url, "regexp_matches(lower({x}), '^(/|https?://|wss?://)')")
scalar("L13_names_a_file", "part", "p_partkey", "CASE p_partkey % 6 WHEN 0 THEN '-x/y' WHEN 1 THEN 'http://a/b' WHEN 2 THEN 'a/b' WHEN 3 THEN concat(p_type, '.py') WHEN 4 THEN 'v1.22' ELSE '.rc' END", P.names_a_file, r"NOT starts_with({x}, '-') AND NOT contains({x}, '://') AND (contains({x}, '/') OR regexp_matches({x}, '^.+\.[0-9]*[a-zA-Z][a-zA-Z0-9]*$'))")
scalar("L14_join", "documents", "doc_id", "CASE doc_id % 2 WHEN 0 THEN '' ELSE source END", lambda x: P.join(x, F.lit("a.py")), "CASE WHEN {x} = '' THEN 'a.py' ELSE {x} || '/a.py' END")
scalar("L15_parent", "part", "p_partkey", "CASE p_partkey % 4 WHEN 0 THEN p_type ELSE concat('a/b/', p_type, '/c.rs') END", P.parent, "CASE WHEN contains({x}, '/') THEN regexp_replace({x}, '/[^/]*$', '') ELSE '' END")
_REL = "CASE p_partkey % 6 WHEN 0 THEN '../x/./y' WHEN 1 THEN '../../../z' WHEN 2 THEN 'a//b' WHEN 3 THEN '..' WHEN 4 THEN './c' ELSE concat('../', p_type) END"
scalar("L16_normalize_relative", "part", "p_partkey", _REL, lambda x: P.normalize_relative(F.lit("src/app"), x), "CASE {x} WHEN '../x/./y' THEN 'src/x/y' WHEN '../../../z' THEN NULL WHEN 'a//b' THEN 'src/app/a/b' WHEN '..' THEN 'src' WHEN './c' THEN 'src/app/c' ELSE 'src/' || {x}[4:] END")
scalar("L17_relative_to", "documents", "doc_id", "concat(source, '/', CAST(doc_id AS STRING))", lambda x: P.relative_to(x, F.lit("src1")), "CASE WHEN starts_with({x}, 'src1/') THEN {x}[6:] ELSE {x} END")
scalar("L18_ancestors", "part", "p_partkey", "CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN lower(p_type) ELSE concat('a/', lower(p_type), '/b') END", lambda x: F.concat_ws(",", F.size(P.ancestors(x)).cast("string"), F.array_join(P.ancestors(x), "|")), "CASE WHEN {x} = '' THEN '0,' WHEN NOT contains({x}, '/') THEN '1,' ELSE '3,' || regexp_replace({x}, '/b$', '') || '|a|' END")
scalar("L19_within", "documents", "doc_id", "concat(source, '/', CAST(doc_id AS STRING))", lambda x: P.within(x, F.lit("src1")), "{x} = 'src1' OR starts_with({x}, 'src1/')")
scalar("L20_from_path", "part", "p_partkey", "concat(lower(p_type), CASE p_partkey % 7 WHEN 0 THEN '.PY' WHEN 1 THEN '.ts' WHEN 2 THEN '.json' WHEN 3 THEN '.openapi.yaml' WHEN 4 THEN '' WHEN 5 THEN '.zzz' ELSE '.rs' END)", P.language_of_path, "CASE WHEN ends_with({x}, '.PY') THEN 'python' WHEN ends_with({x}, '.ts') THEN 'typescript' WHEN ends_with({x}, '.openapi.yaml') THEN 'openapi' WHEN ends_with({x}, '.rs') THEN 'rust' END")
scalar("L21_from_shebang", "part", "p_partkey", "CASE p_partkey % 6 WHEN 0 THEN '#!/usr/bin/env -S python3.12 -u' WHEN 1 THEN '#! /bin/sh' WHEN 2 THEN '#!/usr/bin/env A=1 node' WHEN 3 THEN 'python' WHEN 4 THEN '#!/opt/perl' ELSE '#!/bin/bash -e' END", P.language_of_shebang, "CASE p_partkey % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'bash' WHEN 2 THEN 'javascript' WHEN 5 THEN 'bash' END")
scalar("L22_cargo_package_name", "part", "p_partkey", "concat('[lib]', chr(10), 'name = \"no\"', chr(10), '[package]', chr(10), 'version = \"1\"', chr(10), CASE p_partkey % 3 WHEN 0 THEN '' ELSE concat('name = \"', p_type, '\"', chr(10)) END, '[dependencies]', chr(10), 'name = \"x\"')", P.cargo_package_name, r"""nullif(regexp_extract({x}, '\[package\][^\[]*?\nname = "([^"]*)"', 1), '')""")

# M: hashes, positions, spans
scalar("M1_content_hash", "documents", "doc_id", "text", lambda x: H.content_hash(x), "sha256({x})")


@query("M2_hash_json", "SELECT o_orderkey, sha256('{\"o_custkey\":' || o_custkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS hash FROM orders")
def _m2(t):
    return t.orders.select("o_orderkey", H.hash_json(F.col("o_custkey"), F.col("o_orderstatus")).alias("hash"))


@query("M3_site_id", "SELECT o_orderkey, left(sha256('[\"' || o_orderkey || '\",\"' || o_orderstatus || '\"]'), 20) AS site_id FROM orders")
def _m3(t):
    return t.orders.select("o_orderkey", H.site_id(F.col("o_orderkey"), F.col("o_orderstatus")).alias("site_id"))


scalar("M4_sha256_hex", "pages", "page_id", "html", lambda x: F.sha2(x, 256), "sha256({x})")


@query("M5_unix_time", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def _m5(t):
    return t.events.select("event_id", F.unix_timestamp("ts").alias("seconds"))


@query("M6_line1", "SELECT doc_id, CAST(length(p) - length(replace(p, chr(10), '')) + 1 AS INT) AS line FROM (SELECT doc_id, left(text, CAST(length(text) // 2 AS INT)) AS p FROM documents)")
def _m6(t):
    half = F.octet_length(F.left(F.col("text"), F.floor(F.length("text") / 2).cast("int")))
    return t.documents.select("doc_id", H.line_of(F.col("text"), half).alias("line"))


@query("M7_line_span", "SELECT doc_id, CAST(n AS INT) AS line, CAST(coalesce(sum(strlen(s) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start_byte FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)")
def _m7(t):
    lines = t.documents.select("doc_id", F.posexplode(H.line_starts(F.col("text"))).alias("n", "start_byte"))
    return lines.select("doc_id", (F.col("n") + 1).alias("line"), F.col("start_byte").cast("int").alias("start_byte"))


@query("M9_utf16_of_byte", "SELECT doc_id, CAST(least(length(text), 40) AS INT) AS units FROM documents")
def _m9(t):
    head = F.left(F.col("text"), F.lit(40))
    return t.documents.select("doc_id", H.utf16_of_byte(F.col("text"), F.octet_length(head)).cast("int").alias("units"))


@query("M10_contains", "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity >= 10 AND l_quantity < 30 AS inside FROM lineitem")
def _m10(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", H.contains(F.lit(10), F.lit(30), F.col("l_quantity")).alias("inside"))


@query("M11_encloses", "SELECT p_partkey, 10 <= p_size AND p_size + 5 <= 40 AS inside FROM part")
def _m11(t):
    return t.part.select("p_partkey", H.encloses(F.lit(10), F.lit(40), F.col("p_size"), F.col("p_size") + 5).alias("inside"))


@query("M12_symbol_uid", "SELECT p_partkey, lower(p_type) || '.py:' || p_name || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS uid FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_name ORDER BY p_partkey) AS k FROM part)")
def _m12(t):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("p_type", "p_name").orderBy("p_partkey"))
    return t.part.withColumn("k", k).select("p_partkey", H.symbol_uid(F.concat(F.lower("p_type"), F.lit(".py")), F.col("p_name"), F.col("k")).alias("uid"))
