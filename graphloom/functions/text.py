"""Identifier and text functions on string columns (all JVM-side expressions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that search ignores, and suffixes that folding strips, in order.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "code", "do", "does", "find", "for", "from",
    "function", "how", "i", "in", "is", "it", "me", "of", "on", "or", "show", "that", "the", "this", "to",
    "trace", "what", "when", "where", "which", "with", "would",
]
SUFFIXES = ["ations", "ation", "ings", "ing", "ions", "ion", "ies", "ers", "er", "ed", "es", "s"]


def tokens(text: Column) -> Column:
    """Lower-case words of identifiers and prose, without stop words."""
    spaced = F.regexp_replace(text, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    words = F.transform(F.split(spaced, r"[^\p{IsAlphabetic}\p{N}]+"), F.lower)
    return F.filter(words, lambda w: (w != "") & ~w.isin(STOP_WORDS))


def fold(word: Column) -> Column:
    """The word without the first suffix of the list that leaves four characters; ies becomes y."""
    out = word
    for suffix in reversed(SUFFIXES):
        stem = F.left(word, F.length(word) - len(suffix))
        fits = word.endswith(suffix) & (F.length(word) >= len(suffix) + 4)
        out = F.when(fits, F.concat(stem, F.lit("y")) if suffix == "ies" else stem).otherwise(out)
    return out


def terms(text: Column) -> Column:
    """Folded tokens of more than one character."""
    return F.transform(F.filter(tokens(text), lambda w: F.length(w) > 1), fold)


def normalize_qualified(name: Column) -> Column:
    """A qualified name with dots for colons, without generic arguments and a final ()."""
    text = F.regexp_replace(F.trim(name), r"\(\)$", "")
    text = reduce(lambda t, _: F.regexp_replace(t, r"(?<=[\p{L}\p{N}_])<[^<>]*>", ""), range(6), text)
    text = F.regexp_replace(text, r"(?<=[\p{L}\p{N}_])<.*$", "")
    return F.regexp_replace(F.regexp_replace(text, r"\.?:+", "."), r"^\.+|\.+$", "")


def module_path(path: Column) -> Column:
    """A source path as a dotted module; package index files stand for their folder."""
    stem = F.regexp_replace(path, r"\.[^.]*$", "")
    return F.replace(F.regexp_replace(stem, r"/(__init__|index|mod)$", ""), F.lit("/"), F.lit("."))


def is_identifier(text: Column) -> Column:
    return text.rlike(r"^[_$\p{IsAlphabetic}][_$\p{IsAlphabetic}\p{N}]*\z")


def member_of(callee: Column) -> Column:
    """The last member of a callee if it is an identifier, else null."""
    tail = F.regexp_replace(F.trim(callee), r"^.*(\.|::|->)", "")
    return F.when(is_identifier(tail), tail)


def member_tail(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"([^.>:]*)$", 1))


def base_name(spelling: Column) -> Column:
    """The bare name of a base class as it is spelt."""
    head = F.trim(F.regexp_extract(F.trim(spelling), r"^([^\[<({]*)", 1))
    last = F.regexp_replace(F.regexp_replace(F.regexp_replace(head, r"^.*\s", ""), r"^.*::", ""), r"^.*\.", "")
    return F.when(spelling.contains("="), "").otherwise(F.regexp_replace(last, r"^[*&(),:]+|[*&(),:]+$", ""))


# Separators before a member and the form they stand for, in order.
SEPARATORS = [("::", "path"), ("\\", "path"), ("?.", "recv"), ("&.", "recv"), ("->", "recv"), (".", "recv"), (":", "recv"), ("$", "recv")]


def split_callee(callee: Column, member: Column) -> Column:
    """struct(form, qualifier): how the member is reached (path, recv, other; null for a
    bare name) and the text before the separator."""
    text = F.trim(callee)
    prefix = F.rtrim(F.left(text, F.length(text) - F.length(member)))

    def answer(form: str | None, qualifier: Column) -> Column:
        return F.struct(F.lit(form).cast("string").alias("form"), qualifier.alias("qualifier"))

    out = answer("other", F.lit(""))
    for sep, form in reversed(SEPARATORS):
        out = F.when(prefix.endswith(sep), answer(form, F.trim(F.left(prefix, F.length(prefix) - len(sep))))).otherwise(out)
    return F.when(~text.endswith(member), answer("other", F.lit(""))).when(prefix == "", answer(None, F.lit(""))).otherwise(out)


def truncate_chars(text: Column, most: int) -> Column:
    return F.left(text, F.lit(most))


def one_line(text: Column) -> Column:
    """Line breaks and the white space around them as one space; none inside brackets' edges."""
    t = F.regexp_replace(F.trim(text), r",?\s*[\n\r]\s*(?=[)\]}])", "")
    t = F.regexp_replace(t, r"(?<=[(\[{])\s*[\n\r]\s*", "")
    return F.regexp_replace(t, r"\s*[\n\r]\s*", " ")


def negate_text(condition: Column, truthy: Column, language: Column) -> Column:
    simple = ~condition.rlike(r"\s")
    wrapped = F.when(simple, condition).otherwise(F.concat(F.lit("("), condition, F.lit(")")))
    return (
        F.when(truthy | (condition == ""), condition)
        .when(language == "bash", F.concat(F.lit("! "), condition))
        .when(language.isin("python", "haskell"), F.concat(F.lit("not "), wrapped))
        .otherwise(F.concat(F.lit("!"), wrapped))
    )


def camel_case(snake: Column) -> Column:
    """snake_case as camelCase; leading underscores stay."""
    lead = F.regexp_extract(snake, r"^(_*)", 1)
    parts = F.filter(F.split(F.substr(snake, F.length(lead) + 1), "_+"), lambda p: p != "")
    cased = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))))
    return F.concat(lead, F.array_join(cased, ""))


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))


def _mangle(name: Column) -> Column:
    units = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.when(c.rlike("^[a-zA-Z0-9]$"), c).when(c == "_", "_1").when(c == ";", "_2").when(c == "[", "_3").otherwise(F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", "_0$1")))
    return F.array_join(units, "")


def jni_mangle(package: Column, classes: Column, method: Column) -> Column:
    """The C symbol of a native method: array of package parts, array of nested classes, name."""
    head = F.array_join(F.transform(package, lambda p: F.concat(_mangle(p), F.lit("_"))), "")
    return F.concat(F.lit("Java_"), head, _mangle(F.array_join(classes, "$")), F.lit("_"), _mangle(method))


def decode_escape(raw: Column) -> Column:
    """The character of a two-character escape; other text as it is."""
    second = F.substr(raw, F.lit(2), F.lit(1))
    escape = raw.startswith("\\") & (F.length(raw) == 2)
    return F.when(~escape, raw).when(second == "n", "\n").when(second == "t", "\t").otherwise(second)


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def closest(key: Column, names: list[str]) -> Column:
    """The first nearest of the names that is near enough or shares a prefix; null without one."""
    options = F.transform(F.array(*map(F.lit, names)), lambda n: F.struct(F.levenshtein(key, n).alias("d"), n.alias("name")))
    near = F.filter(options, lambda o: (o["d"] <= F.greatest(F.floor(F.octet_length(key) / 3), F.lit(2))) | o["name"].startswith(key) | key.startswith(o["name"]))
    best = F.array_min(F.transform(near, lambda o: o["d"]))
    return F.get(F.filter(near, lambda o: o["d"] == best), F.lit(0))["name"]


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ** spans folders, * and ? stay inside a name, {a,b} and [..] choose."""
    out, i, depth = "", 0, 0
    parts = [p for p in glob.split("/") if p]
    for n, part in enumerate(parts):
        last = n == len(parts) - 1
        if part == "**":
            out += "(?:[^/]+(?:/[^/]+)*)?" if last else "(?:[^/]+/)*"
            continue
        i = 0
        while i < len(part):
            c = part[i]
            if c == "*":
                out += "[^/]*"
            elif c == "?":
                out += "[^/]"
            elif c == "[" and "]" in part[i + 2 :]:
                end = part.index("]", i + 2)
                body = part[i + 1 : end]
                out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
                i = end
            elif c == "{":
                out, depth = out + "(?:", depth + 1
            elif c == "}" and depth:
                out, depth = out + ")", depth - 1
            elif c == "," and depth:
                out += "|"
            else:
                out += "\\" + c if c in r".^$+()|\[]{}" else c
            i += 1
        out += "" if last else "/"
    return out


def _slashes(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"[\\/]+", "/"), "^/|/$", "")


def glob_matches(glob: str, path: Column) -> Column:
    return _slashes(path).rlike(f"^{glob_pattern(glob)}\\z")


def glob_matches_within(glob: str, path: Column) -> Column:
    """The folder from which the glob matches (by file name without a slash); null if none."""
    clean, pattern = _slashes(path), glob_pattern(glob)
    if "/" not in glob:
        hit = F.regexp_extract(clean, r"([^/]+)\z", 1).rlike(f"^{pattern}\\z")
        return F.when(hit, F.regexp_replace(clean, r"/?[^/]+\z", ""))
    return F.when(clean.rlike(f"^(?:[^/]+/)*?{pattern}\\z"), F.regexp_replace(F.regexp_extract(clean, f"^((?:[^/]+/)*?){pattern}\\z", 1), "/$", ""))
