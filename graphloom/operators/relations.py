"""Relations between declarations, sites and answers: kinds, arity, links by unique key,
selectors, aggregates of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Use kinds of edges and references, and edge kinds of references.
USE_OF_EDGE = {"references": "read", "property_get": "read", "passes_callback": "callback", "inferred_callback": "callback", "writes": "write", "inferred_write": "write", "imports": "import", "reexports": "reexport", "overrides": "override", "implements": "implements", "bridge": "bridge", "stub_implementation": "declaration"}
USE_OF_REFERENCE = {"read": "read", "decorator": "read", "type": "read", "write": "write", "argument": "callback", "import": "import", "export": "reexport"}
EDGE_OF_REFERENCE = {"read": "references", "decorator": "references", "type": "references", "write": "writes", "import": "imports", "export": "reexports"}
BLIND = ["no_semantic_target", "unresolved_signature"]
CANDIDATE_LIST = 20


def _table(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def use_kind(kind: Column) -> Column:
    return F.coalesce(_table(USE_OF_EDGE)[kind], F.lit("call"))


def ref_use_kind(kind: Column) -> Column:
    return _table(USE_OF_REFERENCE)[kind]


def use_edge_kind(kind: Column) -> Column:
    return _table(EDGE_OF_REFERENCE)[kind]


def shown_kind(kind: Column, bridge_kind: Column) -> Column:
    return F.coalesce(F.concat(F.lit("bridge:"), bridge_kind), kind)


def activation_kind(activation: Column, execution: Column) -> Column:
    """Edge kind of a call by how its result is consumed and how the target runs."""
    return (
        F.when(execution == "ordinary", "calls")
        .when(activation == "await", "awaits")
        .when(activation == "iterate", "iterates")
        .when(execution == "coroutine", "creates_coroutine")
        .otherwise("creates_generator")
    )


def edge_kind(is_call: Column, activation: Column, execution: Column, item_kind: Column) -> Column:
    return F.when(is_call, activation_kind(activation, execution)).when(item_kind == 7, "property_get").otherwise("references")


def is_blind(kind: Column) -> Column:
    return kind.isin(BLIND)


def is_synthetic(name: Column) -> Column:
    return name.startswith("<")


def proven_external(kind: Column, candidates: Column) -> Column:
    return (kind == "external_or_ambiguous") & (F.size(candidates) == 0)


def role_rank(role: Column) -> Column:
    return F.when(role.isin("case_candidate", "block_candidate"), 0).when(role == "helper_candidate", 2).otherwise(1)


def arity_accepts(required: Column, most: Column, args: Column, rule: Column, receiver_call: Column, binds_first: Column, has_first: Column) -> Column:
    """Whether a call fits a parameter list, by the language's rule; null if undecided.

    ``required`` and ``most`` count positional parameters (``most`` null: variadic);
    ``binds_first``: the first one is the receiver. Rules: exact, may_bind, binds,
    at_least, undecided.
    """
    fits = lambda skip: (args >= F.greatest(required - skip, F.lit(0))) & F.coalesce(args <= most - skip, F.lit(True))
    may = F.when(~receiver_call | ~has_first, fits(0)).when(binds_first, fits(1)).otherwise(fits(1) | fits(0))
    return F.when(rule == "exact", fits(0)).when(rule == "may_bind", may).when(rule == "binds", F.when(~receiver_call, fits(0)).when(binds_first, fits(1))).when(rule == "at_least", args >= required)


def carries(args: Column, params: Column, offset: Column) -> Column:
    """(argument, parameter) pairs of a call: by keyword, else by position after the receiver.
    ``args``: array of struct(value, keyword)."""
    at = lambda i: F.get(params, i + offset)
    pairs = F.transform(args, lambda a, i: F.struct(a["value"].alias("argument"), F.when(a["keyword"].isNotNull(), F.when(F.array_contains(params, a["keyword"]), a["keyword"])).otherwise(at(i)).alias("parameter")))
    return F.filter(pairs, lambda p: p["parameter"].isNotNull())


def unique_target(answers: DataFrame, key: str, target: str) -> DataFrame:
    """The one distinct target of each key; keys with several are left out."""
    found = answers.groupBy(key).agg(F.count_distinct(target).alias("_n"), F.min(target).alias(target))
    return found.where("_n = 1").drop("_n")


def definition_call(answers: DataFrame) -> DataFrame:
    """Per call: edge (one target), ambiguous (several), external (answers outside the index), none.
    ``answers``: call_id, target (null: outside the index), empty (no answer)."""
    found = answers.groupBy("call_id").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target"), F.bool_and("empty").alias("empty"))
    outcome = F.when(F.col("n") == 1, "edge").when(F.col("n") > 1, "ambiguous").when(F.col("empty"), "none").otherwise("external")
    return found.select("call_id", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("target")).alias("target"))


def link(semantic: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges whose target is a known uid."""
    return semantic.join(symbols.select(F.col("uid").alias("target")), "target", "left_semi")


def dangling(semantic: DataFrame, symbols: DataFrame) -> DataFrame:
    return semantic.join(symbols.select(F.col("uid").alias("target")), "target", "left_anti")


def unique_definitions(prototypes: DataFrame, definitions: DataFrame, key: list[str]) -> DataFrame:
    """prototype, definition where exactly one definition has the key."""
    one = definitions.groupBy(*key).agg(F.count("*").alias("_n"), F.min("uid").alias("definition")).where("_n = 1").drop("_n")
    return prototypes.join(one, key).select(F.col("uid").alias("prototype"), "definition")


def canonical_targets(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """Edges with prototypes replaced by their definitions."""
    found = edges.join(canonical.withColumnRenamed("prototype", "to_uid"), "to_uid", "left")
    return found.withColumn("to_uid", F.coalesce("definition", "to_uid")).drop("definition")


def select(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """Selectors to symbols: by uid, then file:name, bare name, dotted suffix; the first way
    that answers counts, and it must name one symbol.

    references: ref; symbols: uid, path, name, qualified. Returns ref, uid (null if
    ambiguous or unknown), n, candidates (at most CANDIDATE_LIST uids).
    """
    s = symbols.select("uid", "path", "name", "qualified")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(F.split("qualified", r"\."))), lambda i: F.array_join(F.slice(F.split("qualified", r"\."), i, F.lit(1000)), "."))
    keys = [
        s.select("uid", F.col("uid").alias("ref"), F.lit(0).alias("way")),
        s.select("uid", F.concat("path", F.lit(":"), "name").alias("ref"), F.lit(1).alias("way")),
        s.select("uid", F.col("name").alias("ref"), F.lit(2).alias("way")),
        s.select("uid", F.explode(suffixes).alias("ref"), F.lit(3).alias("way")),
    ]
    every = keys[0]
    for k in keys[1:]:
        every = every.unionByName(k)
    near = references.select("ref").distinct().join(every, "ref").groupBy("ref", "way").agg(F.array_sort(F.collect_set("uid")).alias("uids"))
    best = near.groupBy("ref").agg(F.min_by("uids", "way").alias("uids"))
    n = F.coalesce(F.size("uids"), F.lit(0))
    return references.join(best, "ref", "left").select("ref", F.when(n == 1, F.get("uids", F.lit(0))).alias("uid"), n.alias("n"), F.slice(F.coalesce("uids", F.expr("cast(array() as array<string>)")), 1, CANDIDATE_LIST).alias("candidates"))


def best_rows(rows: DataFrame) -> DataFrame:
    """One row per (path, start), the strongest tier first, then the smallest uid."""
    order = Window.partitionBy("path", "start").orderBy("tier", "uid")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def family_candidates(sites: DataFrame, family: DataFrame, proven: DataFrame) -> DataFrame:
    """Sites all of whose candidates belong to the family and whose place has no proven edge."""
    members = family.select(F.col("uid").alias("candidate"))
    each = sites.select("site_id", "place", F.size("candidates").alias("n"), F.explode("candidates").alias("candidate")).join(members, "candidate", "left_semi")
    inside = each.groupBy("site_id", "place").agg(F.count("*").alias("k"), F.first("n").alias("n")).where("k = n")
    return inside.join(proven.select("place"), "place", "left_anti").select("site_id")


def pending_languages(files: DataFrame) -> DataFrame:
    """Languages that only non-product files use."""
    return files.groupBy("language").agg(F.bool_and(~F.col("product")).alias("pending")).where("pending").select("language")


def support(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("n_files"), F.max("level").alias("level"))


def merge_bounds(parts: DataFrame) -> DataFrame:
    return parts.agg(F.bool_or("depth_hit").alias("depth_hit"), F.bool_or("work_hit").alias("work_hit"), F.sum("work").alias("work"))


def use_phrases(uses: DataFrame, limit: int = 8) -> DataFrame:
    """kind, n, example of result uses, in the order in which kinds are first seen."""
    return uses.groupBy("kind").agg(F.count("*").alias("n"), F.min_by("code", "pos").alias("example"), F.min("pos").alias("first")).orderBy("first", "kind").limit(limit).select("kind", "n", "example")


def area(path: Column, in_folder: Column, total: Column) -> Column:
    """Area of a path: its first two parts, or its module where one folder holds over 60 % of all files."""
    stem = F.regexp_replace(path, r"\.[^.]*$", "")
    parts = F.split(stem, "/")
    folder = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")).otherwise(parts[0])
    return F.when(in_folder > F.greatest(F.lit(5.0), total * 0.6), stem).when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, 2), "/")).otherwise(folder)


# Names of folders and files that an inventory leaves out, treats as secret
# or reads as configuration.
EXCLUDED_DIRS = ["node_modules", "vendor", "venv", "__pycache__", "dist", "build", "target", "creds", "credentials", "site-packages", "bower_components"]
SENSITIVE_NAMES = ["auth.json", "credentials.json", "secrets.json", "secrets.yaml", "secrets.yml", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519"]
SENSITIVE_EXTENSIONS = ["pem", "key", "p12", "pfx", "jks", "keystore"]
CONFIG_NAMES = [
    "pyproject.toml", "pyrightconfig.json", "requirements.txt", "requirements.lock", "uv.lock", "poetry.lock", "package.json",
    "package-lock.json", "tsconfig.json", "yarn.lock", "pnpm-lock.yaml", "go.mod", "go.sum", "Cargo.toml", "Cargo.lock",
    "compile_commands.json", "global.json", "composer.json", "jsconfig.json", "pytest.ini", "tox.ini", "setup.cfg",
    "requirements-dev.txt", "pom.xml", "build.gradle", "build.gradle.kts", "DESCRIPTION", "jest.config.json", ".mocharc.json", ".mocharc.yml",
]
CONFIG_PATTERNS = ["tsconfig.*.json", "*.csproj"]


def is_excluded_dir(name: Column) -> Column:
    return name.startswith(".") | F.lower(name).isin(EXCLUDED_DIRS)


def is_sensitive_name(name: Column) -> Column:
    lower = F.lower(name)
    return lower.startswith(".env") | lower.isin(SENSITIVE_NAMES) | F.regexp_extract(lower, r"^.+\.([^.]+)$", 1).isin(SENSITIVE_EXTENSIONS)


def is_config_name(name: Column) -> Column:
    out = name.isin(CONFIG_NAMES)
    for pattern in CONFIG_PATTERNS:
        head, tail = pattern.split("*")
        out = out | ((F.length(name) > len(head) + len(tail)) & name.startswith(head) & name.endswith(tail))
    return out
