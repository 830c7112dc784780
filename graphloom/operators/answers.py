"""Points mapped to calls, owners and scopes; answers turned into links; projections of
links, sites and bridges; conditions under which a candidate is left out.

Columns and expressions come first, then functions of DataFrames. Every join has an
equality key; around points the spans of a file meet in bins (``spans.innermost``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import spans as X
from graphloom.operators.relations import CANDIDATE_LIST, activation_kind, is_excluded_dir, is_sensitive_name

# Fixed values.
PACKAGING_DIRS = ["packaging", "Formula", "HomebrewFormula", "debian", "rpm", "snap", "docker", "installer", "installers"]
PKG_SYSTEMS = ["brew", "homebrew", "deb", "debian", "rpm", "snap", "aur", "arch", "archlinux", "chocolatey", "choco", "scoop", "winget", "flatpak", "nix", "msi", "docker"]
ROOT_SCRIPTS = ["install", "release", "publish"]
RETRY_MS, RETRY_LOCKED_MS = 10_000, 250
COMPACT_RATIO, COMPACT_SEGMENTS = 4, 16


def is_packaging_location(path: Column, ci_scripts: Column) -> Column:
    """Packaging file by folder or role; ``ci_scripts``: the language counts a root ``ci`` folder."""
    parts = F.transform(F.split(path, "/"), F.lower)
    folders, name = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
    known = F.array(*(F.lit(d.lower()) for d in PACKAGING_DIRS))
    systems = "|".join(PKG_SYSTEMS)
    in_folder = F.arrays_overlap(folders, known) | F.concat(F.lit("/"), F.array_join(folders, "/"), F.lit("/")).rlike(f"/pkg/({systems})/")
    in_ci = (F.get(folders, F.lit(0)) == "ci") & ci_scripts
    script = (F.size(folders) == 0) & name.rlike(f"^({'|'.join(ROOT_SCRIPTS)})")
    return in_folder | F.coalesce(in_ci, F.lit(False)) | (name == "pkgbuild") | name.startswith("dockerfile") | script


def relevant_path(relative: Column) -> Column:
    """Whether a change at a path below the root can touch the inventory."""
    parts = F.split(relative, "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return ~F.exists(folders, is_excluded_dir) & ~name.startswith(".") & ~is_sensitive_name(name)


def selects(kind: Column, at: Column, word: Column, index: Column, keyword: Column, positional: Column) -> Column:
    """Whether an effect's selector names the argument at ``index`` or ``keyword``."""
    here, named = F.coalesce(index == at, F.lit(False)), F.coalesce(keyword == word, F.lit(False))
    last = F.coalesce((positional > 0) & (index + 1 == positional), F.lit(False))
    rest = F.coalesce(index >= at, F.lit(False))
    return (
        F.when(kind.isin("pos", "named_by", "command", "code"), here)
        .when(kind == "kw", named)
        .when(kind == "pos_or_kw", here | named)
        .when(kind == "rest", rest)
        .when(kind == "last", last)
        .otherwise(F.lit(False))
    )


def member_point(callee: Column, member: Column, start: Column, end: Column) -> Column:
    """Byte of the member's name: it ends the callee, else the callee's start."""
    n = F.octet_length(member)
    return F.when(callee.endswith(member) & (n <= end - start), end - n).otherwise(start)


def position(answer: Column) -> Column:
    """{"line": l, "character": c} as a struct; null unless both are unsigned 32-bit numbers."""
    field = lambda name: F.get_json_object(answer, f"$.{name}")
    number = lambda name: F.when(field(name).rlike("^[0-9]{1,10}$"), field(name).cast("long"))
    line, character = number("line"), number("character")
    return F.when((line < 2**32) & (character < 2**32), F.struct(line.alias("line"), character.alias("character")))


def byte_of_utf16(line: Column, character: Column) -> Column:
    """Byte in a line of a UTF-16 column: clamped to the line's end, null inside a surrogate pair."""
    units = lambda c: F.when(F.octet_length(c) == 4, 2).otherwise(1)
    start = F.struct(F.lit(0).alias("units"), F.lit(0).alias("bytes"), F.lit(True).alias("whole"))

    def step(a: Column, c: Column) -> Column:
        done = a["units"] >= character
        return F.struct(
            F.when(done, a["units"]).otherwise(a["units"] + units(c)).alias("units"),
            F.when(done, a["bytes"]).otherwise(a["bytes"] + F.octet_length(c)).alias("bytes"),
            (a["whole"] & (done | (a["units"] + units(c) <= character))).alias("whole"),
        )

    walked = F.aggregate(F.filter(F.split(line, ""), lambda c: c != ""), start, step)
    return F.when(walked["whole"], walked["bytes"])


def signature(source: Column, start: Column, end: Column, body: Column) -> Column:
    """Text (places are in characters from 0) up to the body, else up to the line's end; trailing space off."""
    line_end = F.instr(F.substr(source, start + 1), F.lit("\n"))
    stop = F.when(body > start, body).when(line_end > 0, start + line_end - 1).otherwise(F.length(source))
    return F.regexp_replace(F.substring(source, start + 1, F.least(stop, end) - start), r"\s+$", "")


def call_edge_kind(conversion: Column, is_type: Column, is_new: Column, is_constructor: Column, activation: Column, execution: Column) -> Column:
    """Kind of a proven call's link."""
    return F.when(conversion & is_type, "references").when(is_type | (is_new & is_constructor), "constructor").otherwise(activation_kind(activation, execution))


def implementable(callable_: Column, constructor: Column, synthetic: Column, parent_kind: Column, stub: Column, decorators: Column) -> Column:
    """Member that a subclass may implement. ``decorators``: list of texts."""
    open_ = F.exists(decorators, lambda d: F.lower(d).contains("abstract") | F.lower(d).rlike("(^|[^a-z0-9_])(virtual|open)([^a-z0-9_]|$)"))
    return callable_ & ~constructor & ~synthetic & F.coalesce(parent_kind.isin("class", "interface", "struct", "trait", "enum"), F.lit(False)) & ((parent_kind == "interface") | stub | open_)


def arity_rules_out(accepts: Column, plain_arguments: Column, callable_: Column, synthetic: Column, rewritten: Column, foreign_stub: Column) -> Column:
    """A call's positional arguments prove that it can't mean a candidate.

    ``accepts`` as of ``relations.arity_accepts``; ``rewritten``: decorators may change
    its parameters; ``foreign_stub``: a prototype of code elsewhere.
    """
    return plain_arguments & callable_ & ~synthetic & ~rewritten & ~foreign_stub & F.coalesce(~accepts, F.lit(False))


def other_language(language: Column, family: Column, interop, contracts: tuple[str, ...] = ("proto", "graphql", "openapi")) -> Column:
    """No language of a family (a list) can be named from ``language``; ``interop`` is a function of two."""
    return ~language.isin(*contracts) & (F.size(family) > 0) & F.forall(family, lambda x: ~x.isin(*contracts) & ~interop(language, x))


def retry(now_ms: Column, locked: Column) -> Column:
    """When a failed batch is tried again, and whether its error is reported."""
    return F.struct((now_ms + F.when(locked, RETRY_LOCKED_MS).otherwise(RETRY_MS)).alias("retry_at"), (~locked).alias("reported"))


def changes_of(events: DataFrame) -> DataFrame:
    """event_id, overflow, paths (sorted) of the events (event_id, kind, rescan, paths) that are no mere reads."""
    lost = (F.size("paths") == 0) | F.col("rescan")
    kept = F.array_sort(F.array_distinct(F.filter("paths", relevant_path)))
    return events.where("kind <> 'access'").select("event_id", lost.alias("overflow"), F.when(lost, F.slice("paths", 1, 0)).otherwise(kept).alias("paths"))


def wants_compaction(segments: DataFrame, bases: DataFrame) -> DataFrame:
    """path, wants: the journal (path, bytes) has many segments or a large share of its base (path, bytes)."""
    journal = segments.groupBy("path").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"))
    both = bases.select("path", F.col("bytes").alias("base")).join(journal, "path", "full")
    return both.select("path", F.coalesce((F.col("n") >= COMPACT_SEGMENTS) | (F.col("total") * COMPACT_RATIO > F.coalesce("base", F.lit(0))), F.lit(False)).alias("wants"))


def call_at(points: DataFrame, calls: DataFrame) -> DataFrame:
    """path, point, call_id: the call (path, start, end, call_id) with the smallest callee around each point."""
    spans = calls.select("path", "start", "end", F.col("call_id").alias("uid"), F.col("call_id").alias("decl"))
    return X.innermost(points, spans).withColumnRenamed("uid", "call_id")


def owner_at(points: DataFrame, calls: DataFrame, references: DataFrame) -> DataFrame:
    """path, point, owner: that of the smallest call around a point (which may have none),
    else of the smallest reference there. Both tables: path, start, end, id, owner."""

    def around(spans: DataFrame, name: str) -> DataFrame:
        found = X.innermost(points.select("path", "point").distinct(), spans.select("path", "start", "end", F.col("id").alias("uid"), F.col("id").alias("decl")))
        owners = spans.select(F.col("id").alias("uid"), F.struct("owner").alias(name))
        return found.where("uid is not null").join(owners, "uid").select("path", "point", name)

    empty = references.where("start = end").groupBy("path", F.col("start").alias("point")).agg(F.min(F.struct("id", "owner")).alias("at"))
    both = points.join(around(calls, "call"), ["path", "point"], "left").join(around(references, "reference"), ["path", "point"], "left").join(empty, ["path", "point"], "left")
    return both.select(*points.columns, F.when(F.col("call").isNotNull(), F.col("call.owner")).when(F.col("at").isNotNull(), F.col("at.owner")).otherwise(F.col("reference.owner")).alias("owner"))


def scope_at(references: DataFrame, scopes: DataFrame) -> DataFrame:
    """reference, uid: of ``<file>:<line>`` the smallest scope (path, first, last line, bytes, uid)."""
    form = r"^(.*):\s*([0-9]{1,9})\s*$"
    line = F.when(F.col("reference").rlike(form), F.regexp_extract("reference", form, 2)).cast("int")
    asked = references.select("reference", F.regexp_extract("reference", form, 1).alias("path"), line.alias("line"))
    cell = lambda c: F.floor(F.col(c) / 256)
    dealt = scopes.select("*", F.explode(F.sequence(cell("first"), cell("last"))).alias("bin"))
    near = asked.select("path", "line", cell("line").alias("bin")).distinct().join(dealt, ["path", "bin"]).where("first <= line and line <= last")
    best = near.groupBy("path", "line").agg(F.min(F.struct("bytes", "uid")).alias("by")).select("path", "line", F.col("by.uid").alias("uid"))
    return asked.join(best, ["path", "line"], "left").select("reference", "uid")


def pick(references: DataFrame, matches: DataFrame, most: int = CANDIDATE_LIST) -> DataFrame:
    """reference, status (found, not_found, ambiguous), uid, candidates (the first ``most``)."""
    each = matches.select("reference", "uid").distinct()
    first = each.withColumn("n", F.row_number().over(Window.partitionBy("reference").orderBy("uid"))).where(F.col("n") <= most)
    listed = first.groupBy("reference").agg(F.array_sort(F.collect_list("uid")).alias("listed"))
    found = references.select("reference").join(listed, "reference", "left").withColumn("n", F.coalesce(F.size("listed"), F.lit(0)))
    one = F.col("n") == 1
    return found.select("reference", F.when(one, "found").when(F.col("n") < 1, "not_found").otherwise("ambiguous").alias("status"), F.when(one, F.col("listed")[0]).alias("uid"), F.when(F.col("n") > 1, F.col("listed")).alias("candidates"))


def reaching_first(reaching: DataFrame, traversed: DataFrame, key: str) -> DataFrame:
    """key, edge_id, place: of each question the reaching edges in their order, then the other traversed ones."""
    every = reaching.select(key, "edge_id", F.lit(0).alias("late"), "pos").unionByName(traversed.select(key, "edge_id", F.lit(1).alias("late"), F.lit(0).alias("pos")))
    once = every.groupBy(key, "edge_id").agg(F.min(F.struct("late", "pos")).alias("at"))
    return once.select(key, "edge_id", F.row_number().over(Window.partitionBy(key).orderBy("at", "edge_id")).alias("place"))


def test_role(symbols: DataFrame, ancestors: DataFrame) -> DataFrame:
    """uid, role of test code (uid, name, language, callable, type); ``ancestors``: uid, ancestor."""
    callables = symbols.where("callable").select(F.col("uid").alias("ancestor"))
    inside = ancestors.join(callables, "ancestor").select("uid").distinct().withColumn("inside", F.lit(True))
    case = F.col("callable") & ((F.col("name") == "test") | F.col("name").startswith("test_"))
    role = F.when(F.col("language") != "python", "test_code").when(F.col("inside"), "helper_candidate").when(case, "case_candidate").when(F.col("type"), "container").otherwise("helper_candidate")
    return symbols.where("is_test").join(inside, "uid", "left").select("uid", role.alias("role"))


def arity_excludes(occurrences: DataFrame, members: DataFrame) -> DataFrame:
    """occurrence, excluded: no member (family, name, member, required, most, synthetic) named
    like the call (family, name, args) accepts it, and there is such a member."""
    # Calls alike meet parameter lists alike once; neither side is joined row by row.
    lists = members.where("not synthetic").select("family", "name", "required", "most", F.col("member").isNotNull().alias("known")).distinct()
    out = F.coalesce(F.col("required") > F.col("args"), F.lit(False)) | F.coalesce(F.col("most") < F.col("args"), F.lit(False))
    asked = occurrences.select("family", "name", "args").where("args is not null").distinct().join(lists, ["family", "name"])
    judged = asked.groupBy("family", "name", "args").agg(F.bool_or("known").alias("any"), F.bool_and(out).alias("all"))
    unfit = lambda c: F.coalesce(c, F.lit(False))
    # Arguments unknown: a member there may accept them.
    return occurrences.join(judged, ["family", "name", "args"], "left").groupBy("occurrence").agg((F.bool_or(unfit(F.col("any"))) & F.bool_and(unfit(F.col("all")))).alias("excluded"))


def narrow_by_arity(targets: DataFrame) -> DataFrame:
    """Targets (call_id, target, callable, accepts) that the call's arguments fit; all where none does."""
    fits = ~F.col("callable") | F.coalesce("accepts", F.lit(True))
    some = F.max(fits).over(Window.partitionBy("call_id"))
    return targets.withColumns({"fits": fits, "some": some}).where("fits or not some").drop("fits", "some")


def syntax_definition(calls: DataFrame, declarations: DataFrame) -> DataFrame:
    """call_id, uid: bare calls (path, name) with exactly one declaration (path, name, uid,
    callable, top_level, start) of that name anywhere, in the same file, before the call."""
    only = declarations.groupBy("name").agg(F.count("*").alias("n"), F.first(F.struct("path", "uid", "callable", "top_level", "start")).alias("d")).where("n = 1")
    bare = calls.where("receiver is null and not local").select("call_id", "path", "name", F.col("start").alias("call_start"))
    return bare.join(only, "name").where("d.path = path and d.callable and d.top_level and d.start <= call_start").select("call_id", F.col("d.uid").alias("uid"))


def request_unique(requests: DataFrame) -> DataFrame:
    """id, asked: the request (id, method, params) whose answer each takes, the first of equal ones."""
    first = requests.groupBy("method", "params").agg(F.min("id").alias("asked"))
    return requests.join(first, ["method", "params"]).select("id", "asked")


def located(locations: DataFrame, files: DataFrame) -> DataFrame:
    """Locations (file_id, line, start, end, ...) with the path of their file."""
    at = F.struct("path", "line", "start", "end").alias("at")
    return locations.join(files.select("file_id", "path"), "file_id").select(*(c for c in locations.columns if c not in ("file_id", "line", "start", "end")), at)


def decision_info(sites: DataFrame, decisions: DataFrame) -> DataFrame:
    """site, category, status, reason of the sites that are decided on."""
    return sites.select("site", "category").join(decisions, "site").select("site", "category", F.when(F.col("decided"), "decided").otherwise("unknown").alias("status"), "reason")


def site_rows(sites: DataFrame, decisions: DataFrame, owners: DataFrame) -> DataFrame:
    """Sites of the owners with their decision; unknown where none is recorded."""
    known = decisions.select("site", "decided", "reason", "targets", F.lit(True).alias("recorded"))
    rows = sites.join(owners.select("owner"), "owner").join(known, "site", "left")
    none = F.slice("candidates", 1, 0)
    return rows.select(
        "site", "owner", "category", "candidates",
        F.when(F.col("decided"), "decided").otherwise("unknown").alias("status"),
        F.when(F.col("recorded").isNull(), "no decision recorded").otherwise(F.col("reason")).alias("reason"),
        F.when(F.col("decided"), F.col("targets")).otherwise(none).alias("decided_targets"),
    )


def bridge_info(bridges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Bridges (bridge, kind, from_uid, to_uid) with the languages of both ends."""
    end = lambda side: symbols.select(F.col("uid").alias(f"{side}_uid"), F.col("language").alias(f"{side}_language"))
    return bridges.join(end("from"), "from_uid").join(end("to"), "to_uid").select("bridge", "kind", "from_uid", "to_uid", "from_language", "to_language")


def narrow_to_member(evidence: DataFrame, members: DataFrame) -> DataFrame:
    """id, start, end: evidence (id, path, start, end, name, text) narrowed to the last member
    (path, start, end, name) of that name inside it, else to its own tail if it ends so."""
    size = F.octet_length("name")
    cell = lambda c: F.floor(F.col(c) / X.BIN)
    wide = evidence.select("id", "path", "name", F.col("start").alias("a"), F.col("end").alias("b"), F.explode(F.sequence(cell("start"), cell("end"))).alias("bin"))
    inner = members.select("path", "name", "start", "end", cell("start").alias("bin")).where(F.col("end") - F.col("start") == size)
    last = wide.join(inner, ["path", "name", "bin"]).where("a <= start and end <= b").groupBy("id").agg(F.max("end").alias("last"))
    rows = evidence.join(last, "id", "left")
    tail = (size > 0) & (F.col("end") - F.col("start") > size) & F.col("text").endswith(F.col("name"))
    end = F.coalesce("last", "end")
    return rows.select("id", F.when(F.col("last").isNotNull() | tail, end - size).otherwise(F.col("start")).alias("start"), end.alias("end"))


def callback_span(edges: DataFrame, arguments: DataFrame) -> DataFrame:
    """edge, start: the argument (callee, argument, name, start) that a callback link passes.

    The one spelled the same (the first), else the only one with that name or last member.
    """
    met = edges.join(arguments.withColumnRenamed("argument", "spelled"), "callee")
    same = F.col("spelled") == F.col("argument")
    member = (F.col("name") == F.col("argument")) | (F.regexp_extract("spelled", r"([^.]*)$", 1) == F.col("argument"))
    found = met.groupBy("edge").agg(F.min(F.when(same, F.col("start"))).alias("exact"), F.count_if(member).alias("n"), F.min(F.when(member, F.col("start"))).alias("only"))
    return found.select("edge", F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("start")).where("start is not null")


def overriding(above: DataFrame, methods: DataFrame) -> DataFrame:
    """uid, override: methods (class, name, uid) of the same name in all subclasses; ``above``: cls, ancestor."""
    own = methods.select(F.col("class").alias("ancestor"), "name", "uid")
    return own.join(above, "ancestor").select("uid", "name", F.col("cls").alias("class")).join(methods.withColumnRenamed("uid", "override"), ["class", "name"]).select("uid", "override")
