"""Joins behind occurrences, imports, mounts and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import paths as P
from graphloom.operators.lineage import cut

# Bounds of router mounts.
MOUNT_DEPTH, MOUNT_PREFIXES = 8, 64


def card(name: Column, doc: Column, lines: Column) -> Column:
    """struct(name, head, lines): head is the first documentation line, 160 characters at most."""
    return F.struct(name.alias("name"), F.left(F.split(doc, "\n")[0], F.lit(160)).alias("head"), lines.alias("lines"))


def edge_rows(edges: DataFrame, decisions: DataFrame, bridges: DataFrame) -> DataFrame:
    """Edges with the status of their site's decision and the kind of their bridge."""
    out = edges.join(decisions.select("site_id", "status"), "site_id", "left").join(bridges.select("bridge_id", F.col("kind").alias("bridge_kind")), "bridge_id", "left")
    return out.withColumn("shown", F.coalesce(F.concat(F.lit("bridge:"), "bridge_kind"), "kind"))


def occurrences(names: DataFrame, **tables: DataFrame) -> DataFrame:
    """Occurrences of names: the given tables (path, start, name) in one, with where they come from."""
    parts = [df.select("path", "start", "name", F.lit(kind).alias("source")).join(names, "name", "left_semi") for kind, df in sorted(tables.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_evidence(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """Occurrences (path, start, end) with the flag of an evidence span (path, end) that ends
    where they end and starts no later."""
    spans = evidence.groupBy("path", "end").agg(F.min("start").alias("_from"))
    return found.join(spans, ["path", "end"], "left").withColumn("linked", F.coalesce(F.col("_from") <= F.col("start"), F.lit(False))).drop("_from")


def unique_imports(imports: DataFrame, declarations: DataFrame, proven: DataFrame) -> DataFrame:
    """Edges of imports (import_id, module, name) that name exactly one declaration, where
    none is proven yet."""
    one = declarations.groupBy("module", "name").agg(F.count("*").alias("_n"), F.min("uid").alias("to_uid")).where("_n = 1")
    return imports.join(one, ["module", "name"]).join(proven.select("import_id"), "import_id", "left_anti").select("import_id", "to_uid")


def resolve_import(imports: DataFrame, files: DataFrame) -> DataFrame:
    """import_id, path: files whose dotted module is the longest suffix match of the target.
    imports: import_id, target (dotted); files: path, module (dotted)."""
    parts = F.split("target", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("skip"), F.array_join(F.slice(parts, i, F.lit(1000)), ".").alias("key")))
    keys = imports.select("import_id", F.explode(suffix).alias("s")).select("import_id", "s.skip", "s.key")
    near = keys.join(files.select("path", F.col("module").alias("key")), "key")
    best = near.groupBy("import_id").agg(F.min("skip").alias("skip"))
    return near.join(best, ["import_id", "skip"]).select("import_id", "path")


def script_file(tokens: DataFrame, files: DataFrame) -> DataFrame:
    """token_id, path: the file a command's word names: exactly, from the caller's folder,
    or as the only file that ends with it; the first way that answers counts."""
    base = F.regexp_extract("path", "([^/]*)$", 1)
    t = tokens.select("token_id", "token", "folder")
    exact = t.join(files, F.col("token") == F.col("path")).select("token_id", "path", F.lit(0).alias("way"))
    beside = t.withColumn("full", P.normalize_relative(F.col("folder"), F.col("token"))).join(files, F.col("full") == F.col("path")).select("token_id", "path", F.lit(1).alias("way"))
    ends = t.withColumn("base", F.regexp_extract("token", "([^/]*)$", 1)).join(files.withColumn("base", base), "base").where(F.col("path").endswith(F.concat(F.lit("/"), "token")))
    single = ends.groupBy("token_id").agg(F.count("*").alias("_n"), F.min("path").alias("path")).where("_n = 1").select("token_id", "path", F.lit(2).alias("way"))
    every = exact.unionByName(beside).unionByName(single)
    return every.groupBy("token_id").agg(F.min_by("path", F.struct("way", "path")).alias("path"))


def mount_prefixes(mounts: DataFrame, depth: int = MOUNT_DEPTH, most: int = MOUNT_PREFIXES) -> DataFrame:
    """router, prefix: all prefixes under which a router is mounted, through chains of
    mounts (child, parent, prefix); a router that is nobody's child has the empty one."""
    roots = mounts.select(F.col("parent").alias("router")).join(mounts.select(F.col("child").alias("router")), "router", "left_anti").distinct()
    level = cut(roots.withColumn("prefix", F.lit("")))
    found = level
    for _ in range(depth):
        below = level.withColumnsRenamed({"router": "parent", "prefix": "above"}).join(mounts, "parent")
        level = cut(below.select(F.col("child").alias("router"), P.join_paths(F.col("above"), F.col("prefix")).alias("prefix")).distinct())
        if level.isEmpty():
            break
        found = found.unionByName(level)
    order = Window.partitionBy("router").orderBy(F.length("prefix"), "prefix")
    return found.distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def option_tests(guards: DataFrame, writes: DataFrame, tests: DataFrame) -> DataFrame:
    """guard_id, test: tests (path, start, end, test) inside which an option that a guard
    reads (guard_id, name) is written (path, point, name)."""
    inside = writes.join(tests, "path").where((F.col("start") <= F.col("point")) & (F.col("point") < F.col("end")))
    return guards.join(inside, "name").select("guard_id", "test").distinct()


def constructor_bridge(calls: DataFrame, constructors: DataFrame) -> DataFrame:
    """Calls of a class (call_id, class) with the class's own constructor, where it has one."""
    return calls.join(constructors, "class", "left").select("call_id", F.coalesce("constructor", "class").alias("target"))


def is_test_path(path: Column) -> Column:
    """Test file by the usual runners' conventions."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return name.rlike(r"^test_.*\.py$|_test\.(py|go)$|\.(test|spec)\.[cm]?[jt]sx?$|Tests?\.(java|cs)$") | path.rlike(r"(^|/)(tests?|__tests__|spec)/")


def owner_chain(symbols: DataFrame, limit: int = 64) -> DataFrame:
    """uid, ancestor: all enclosing declarations of each symbol (uid, parent_uid)."""
    level = symbols.where("parent_uid is not null").select("uid", F.col("parent_uid").alias("ancestor"))
    found = level
    up = symbols.where("parent_uid is not null").select(F.col("uid").alias("ancestor"), F.col("parent_uid").alias("next"))
    for _ in range(limit):
        level = cut(level.join(up, "ancestor").select("uid", F.col("next").alias("ancestor")))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found
