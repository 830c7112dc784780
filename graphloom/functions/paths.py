"""URL, route and path functions on string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = "{}"
# HTTP methods.
VERBS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "TRACE", "CONNECT"]
_PRINTF = "%[sdvqxfiu]"


def printf_verb(segment: Column) -> Column:
    return segment.rlike(_PRINTF)


def is_param(segment: Column) -> Column:
    """A placeholder segment: {x}, <x>, :x, *, or a printf conversion."""
    return segment.rlike(rf"\{{.*\}}|<.*>|^:.|{_PRINTF}") | (segment == "*") | (segment == PLACEHOLDER)


def segments(path: Column) -> Column:
    """Segments of a path; {name} is a placeholder."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.startswith("{") & s.endswith("}"), PLACEHOLDER).otherwise(s))


def normalize(url: Column, require_root: bool = True) -> Column:
    """struct(path, verb) of a URL or route: scheme, host, query, fragment and anchors go,
    parameters become {}; null if ``require_root`` and it is no absolute path."""
    verbs = "|".join(VERBS)
    verb = F.nullif(F.regexp_extract(url, f"^({verbs}) /", 1), F.lit(""))
    s = F.regexp_replace(url, f"^({verbs}) (?=/)", "")
    full = s.rlike("^(?i)(https?|wss?)://") | (s.startswith("//") if require_root else F.lit(False))
    rest = F.regexp_extract(s, "^(?i)(?:(?:https?|wss?):)?//[^/]*(.*)$", 1)
    s = F.when(full, F.when(rest == "", "/").otherwise(rest)).otherwise(s)
    plain = F.regexp_replace(F.regexp_extract(s, "^([^?#]*)", 1), r"^\^+|\$+$", "")
    parts = F.transform(F.filter(F.split(plain, "/"), lambda x: x != ""), lambda x: F.when(is_param(x), PLACEHOLDER).otherwise(x))
    out = F.struct(F.concat(F.lit("/"), F.array_join(parts, "/")).alias("path"), verb.alias("verb"))
    return F.when(s.startswith("/"), out) if require_root else out


def join_paths(prefix: Column, path: Column) -> Column:
    a, b = F.regexp_replace(prefix, "/+$", ""), F.regexp_replace(path, "^/+", "")
    return F.when((a == "") & (b == ""), "/").when(b == "", a).otherwise(F.concat(a, F.lit("/"), b))


def verb_of(spelling: Column) -> Column:
    """HTTP method of a literal or constant; null if it is none."""
    last = F.regexp_replace(F.regexp_extract(spelling, r"([^.:]*)$", 1), "^[\"':]+|[\"':]+$", "")
    up = F.upper(F.regexp_replace(last, "^Method", ""))
    return F.when(up.isin(VERBS), up)


def seg_eq(a: Column, b: Column, fold_case: bool = False) -> Column:
    same = F.lower(a) == F.lower(b) if fold_case else a == b
    return (a == PLACEHOLDER) | (b == PLACEHOLDER) | same


def path_match(client: Column, client_open: Column, route: Column, route_open: Column, fold_case: bool = False) -> Column:
    """Number of positions where one side alone has a parameter, or null if the segment
    arrays don't match; an open side has an unknown prefix and matches a suffix."""
    n, m = F.size(client), F.size(route)
    shorter_client = F.when(~client_open & route_open, F.lit(False)).when(client_open & route_open, n <= m).otherwise(F.lit(True))
    short, long = F.when(shorter_client, client).otherwise(route), F.when(shorter_client, route).otherwise(client)
    ok = F.when(~client_open & ~route_open, n == m).otherwise(F.size(long) >= F.size(short))
    ok = ok & ~((F.size(short) == 0) & (F.size(long) > 0) & (client_open | route_open))
    tail = F.slice(long, F.size(long) - F.size(short) + 1, F.size(short))
    pairs = F.arrays_zip(short.alias("s"), tail.alias("l"))
    fits = F.forall(pairs, lambda p: seg_eq(p["s"], p["l"], fold_case))
    wild = F.size(F.filter(pairs, lambda p: (p["s"] == PLACEHOLDER) != (p["l"] == PLACEHOLDER)))
    return F.when(ok, F.when(F.size(short) == 0, F.lit(0)).when(fits, wild))


def method_ok(client: Column, route: Column) -> Column:
    return (client == route) | (route == "*") | (client == "*")


def id_matches(op_id: Column, name: Column) -> Column:
    """Whether an operation id names a handler."""
    plain = lambda c: F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]", ""))
    return (op_id == name) | op_id.startswith(F.concat(name, F.lit("_"))) | F.array_contains(F.split(op_id, "-"), name) | (plain(op_id) == plain(name))


def fs_route_key(glob: str, url_root: str | None, path: Column) -> Column:
    """The route of a file under a file-system routing glob; null outside its root."""
    parts = [s for s in glob.split("/") if s]
    fixed = lambda s: not set(s) & set("*?[{")
    if url_root is not None:
        root = [s for s in url_root.split("/") if s]
    else:
        root = []
        for s in parts:
            if not fixed(s):
                break
            root.append(s)
    segs = F.filter(F.split(path, "/"), lambda s: s != "")
    n = len(root)
    inside = F.size(segs) > n
    for i, s in enumerate(root):
        inside = inside & F.coalesce(F.get(segs, F.lit(i)) == s, F.lit(False))
    rest = F.slice(segs, n + 1, F.greatest(F.size(segs) - n - 1, F.lit(0)))
    stem = F.split(F.element_at(segs, -1), r"\.")[0]
    keep = F.lit(not (parts and fixed(parts[-1].split(".")[0]))) & (stem != "index")
    return F.when(inside, F.concat(F.lit("/"), F.array_join(F.when(keep, F.concat(rest, F.array(stem))).otherwise(rest), "/")))


def command_tokens(command: Column) -> Column:
    """Words of a command line without quotes around them."""
    return F.filter(F.transform(F.split(command, r"\s+"), lambda w: F.regexp_replace(w, "^[\"']+|[\"']+$", "")), lambda w: w != "")


def names_a_file(token: Column) -> Column:
    extension = F.regexp_extract(token, r"^.+\.([a-zA-Z0-9]+)$", 1)
    return ~token.startswith("-") & ~token.contains("://") & (token.contains("/") | extension.rlike("[a-zA-Z]"))


def looks_like_url(text: Column) -> Column:
    return F.lower(text).rlike("^(/|https?://|wss?://)")


def join(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def normalize_relative(base: Column, relative: Column) -> Column:
    """``relative`` from ``base`` with . and .. resolved; null if it leaves the root."""
    clean = lambda c: F.filter(c, lambda p: (p != "") & (p != "."))
    start = F.struct(F.filter(F.split(base, "/"), lambda p: p != "").alias("at"), F.lit(True).alias("ok"))

    def step(acc: Column, part: Column) -> Column:
        up = part == ".."
        at = F.when(~up, F.concat(acc["at"], F.array(part))).otherwise(F.slice(acc["at"], 1, F.greatest(F.size(acc["at"]) - 1, F.lit(0))))
        return F.struct(at.alias("at"), (acc["ok"] & (~up | (F.size(acc["at"]) > 0))).alias("ok"))

    return F.aggregate(clean(F.split(relative, r"[/\\]")), start, step, lambda acc: F.when(acc["ok"], F.array_join(acc["at"], "/")))


def relative_to(path: Column, folder: Column) -> Column:
    return F.when((folder != "") & path.startswith(F.concat(folder, F.lit("/"))), F.substr(path, F.length(folder) + 2)).otherwise(path)


def ancestors(folder: Column) -> Column:
    """Proper ancestors, nearest first, ending with the root ''."""
    parts = F.split(folder, "/")
    n = F.size(parts)
    return F.when(folder == "", F.expr("cast(array() as array<string>)")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), n - i), "/")))


def within(path: Column, folder: Column) -> Column:
    return (folder == "") | (path == folder) | path.startswith(F.concat(folder, F.lit("/")))


# Languages of file extensions and interpreters.
EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "rs": "rust", "go": "go", "java": "java",
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "cs": "csharp", "php": "php",
    "rb": "ruby", "scala": "scala", "hs": "haskell", "r": "r", "sh": "bash", "bash": "bash", "proto": "proto", "graphql": "graphql",
}
INTERPRETERS = {"python": "python", "node": "javascript", "bash": "bash", "sh": "bash", "zsh": "bash", "ksh": "bash", "ruby": "ruby", "php": "php", "Rscript": "r"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def language_of_path(path: Column) -> Column:
    """Language by extension; json and yaml only where the file is named as a contract."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    extension = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    contract = name.rlike(r"^(.*\.)?(openapi|swagger)\.(json|ya?ml)$")
    return F.when(contract, "openapi").when(extension.isin("json", "yaml", "yml"), F.lit(None)).otherwise(_lookup(EXTENSIONS, extension))


def language_of_shebang(line: Column) -> Column:
    """Language of the interpreter that a first line names."""
    words = F.filter(F.split(F.regexp_replace(F.substr(line, F.lit(3)), r"[\r\n]+$", ""), "[ \t]+"), lambda w: w != "")
    first = F.regexp_extract(F.get(words, F.lit(0)), r"([^/]*)$", 1)
    after = F.filter(F.slice(words, 2, 100), lambda w: ~w.startswith("-") & ~w.contains("="))
    name = F.when(first == "env", F.regexp_extract(F.get(after, F.lit(0)), r"([^/]*)$", 1)).otherwise(first)
    name = F.regexp_replace(name, r"\.exe$", "")
    return F.when(line.startswith("#!"), _lookup(INTERPRETERS, F.regexp_replace(name, "(?<=.)[0-9.]+$", "")))


def cargo_package_name(text: Column) -> Column:
    """``name`` of the [package] section of a manifest."""
    return F.nullif(F.regexp_extract(text, r"""(?ms)^\[package\][^\[]*?^\s*name\s*=\s*["']([^"']*)["']""", 1), F.lit(""))
