"""Secret scans with DataFrame functions only.

Three patterns give the base spans. On top, candidate strings (long runs of key
characters with a letter among them) are scanned with a sliding window: an aggregate
walks the string with the count of each character in the window and the sum of
c * log2(c), takes the leaving character out and the entering one in, and so has the
Shannon entropy of every window by incremental counts. A candidate is reported from the
first to the last window whose entropy reaches the threshold of its character class,
unless an allow-list names it or a base span covers it; one that a base span covers in
part is reported whole, beside that base span.

Places of matches come from the texts between them (``split``) and their lengths.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import shared as S

#: The base patterns. Runs of fewer characters than asked for are left out of the last
#: two, which match no differently for it.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
VALUE_LEAST = 6
#: Candidate strings, the window, and the least entropy (bits) of a window by class.
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
WINDOW = 20
LEAST_BITS = {"hex": 3.0, "mixed": 3.8, "lower": 3.7, "letters": 3.8}
#: Candidates that are no secrets: UUIDs, integrity digests, marked examples.
ALLOW_PATTERN = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^sha(1|256|384|512)-|(?i)example"
#: Matches whose places are listed at once.
MANY = 256
KINDS = ("assign", "access", "hex", "entropy")
#: c * log2(c) in millionths, so that adding and taking away is exact.
_F = [0, *(round(c * math.log2(c) * 1e6) for c in range(1, WINDOW + 2))]
_SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"


def _most(bits: float) -> int:
    """The largest sum of c * log2(c) at which a window has this entropy."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * 1e6)


def _places(parts: str, found: str, kind: int, values: str | None = None) -> Column:
    """Spans of the matches ``found`` between ``parts``; with ``values``, of those whose value is long enough."""
    # Arrays are walked, never indexed in a lambda: an inlined column would be computed for each element.
    pairs = f"zip_with({parts}, {found}, (g, t) -> named_struct('gap', length(g), 'text', t, 'ok', t is not null))"
    if values:
        pairs = f"zip_with({pairs}, {values}, (x, v) -> named_struct('gap', x.gap, 'text', x.text, 'ok', coalesce(length(v) >= {VALUE_LEAST}, false)))"
    # A list that grows is copied at each step, so it grows in blocks of MANY.
    block = f"""aggregate(slice({pairs}, b * {MANY} + 1, {MANY}), named_struct('pos', 0, 'out', cast(array() as {_SPAN})),
          (a, x) -> named_struct('pos', a.pos + x.gap + coalesce(length(x.text), 0),
            'out', if(x.ok, array_append(a.out, named_struct('start', a.pos + x.gap, 'kind', {kind}, 'end', a.pos + x.gap + length(x.text), 'text', x.text)), a.out)))"""
    return F.expr(
        f"""aggregate(transform(sequence(0, (size({parts}) - 1) div {MANY}), b -> {block}), named_struct('pos', 0, 'out', cast(array() as array<{_SPAN}>)),
          (a, x) -> named_struct('pos', a.pos + x.pos,
            'out', array_append(a.out, transform(x.out, s -> named_struct('start', a.pos + s.start, 'kind', s.kind, 'end', a.pos + s.end, 'text', s.text)))),
          a -> flatten(a.out))"""
    )


def _hull(text: str) -> str:
    """(first, last) start of a window of ``text`` at its class's entropy; first is -1 without one."""
    codes = f"transform(split({text}, ''), c -> ascii(c) - 42)"
    table = f"array({','.join(f'{x}L' for x in _F)})"
    most = f"""case when not {text} rlike '[0-9]' then {_most(LEAST_BITS['letters'])}L when {text} rlike '^[0-9a-fA-F]+$' then {_most(LEAST_BITS['hex'])}L
      when {text} rlike '[A-Z]' then {_most(LEAST_BITS['mixed'])}L else {_most(LEAST_BITS['lower'])}L end"""
    left = "element_at(a.counts, x.enter) - if(x.leave = x.enter, 1, 0)"
    total = f"(a.total - if(x.leave > 0, {table}[element_at(a.counts, greatest(x.leave, 1))] - {table}[element_at(a.counts, greatest(x.leave, 1)) - 1], 0L) + {table}[{left} + 1] - {table}[{left}])"
    hot = f"a.n >= {WINDOW - 1} and {total} <= a.most"
    return f"""aggregate(
      filter(zip_with({codes}, concat(array_repeat(0, {WINDOW}), {codes}), (e, l) -> named_struct('enter', e, 'leave', l)), x -> x.enter > 0),
      named_struct('most', {most}, 'counts', array_repeat(0, 80), 'total', 0L, 'n', 0, 'first', -1, 'last', -1),
      (a, x) -> named_struct('most', a.most, 'counts', transform(a.counts, (c, k) -> c + if(k + 1 = x.enter, 1, 0) - if(k + 1 = x.leave, 1, 0)), 'total', {total}, 'n', a.n + 1,
        'first', if(a.first < 0 and {hot}, a.n - {WINDOW - 1}, a.first), 'last', if({hot}, a.n - {WINDOW - 1}, a.last)),
      a -> named_struct('first', a.first, 'last', a.last))"""


_LETTER = "x.text rlike '[A-Za-z]'"


def spans(docs: DataFrame, allow: tuple[str, ...] = ()) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, lists of (start, kind, end, text) spans: those of
    the base patterns and those added by entropy. Returns their names too.

    Null texts are empty. Places are in characters, ends exclusive. ``allow``: strings
    that are never reported by entropy.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "candidate": CANDIDATE}
    kept = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    found = docs.select(kept.alias("row"), text.alias("text")).withColumns({f"m_{k}": F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in every.items()})
    found = found.withColumns(
        {
            "v_assign": F.when(F.size("m_assign") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1))),
            **{f"p_{k}": F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)) for k, p in every.items()},
        }
    )
    none = F.expr(f"cast(array() as {_SPAN})")
    place = {f"s_{k}": F.when(F.size(f"m_{k}") > 0, _places(f"p_{k}", f"m_{k}", min(n, 3), "v_assign" if k == "assign" else None)).otherwise(none) for n, k in enumerate(every)}
    placed = found.withColumns(place).select("row", "text", F.array_sort(F.concat("s_assign", "s_access", "s_hex")).alias("base"), "s_candidate")
    allowed = F.array(*(F.lit(a) for a in allow)) if allow else F.expr("cast(array() as array<string>)")
    maybe = placed.withColumn("allowed", allowed).withColumn("maybe", F.expr(f"filter(s_candidate, x -> {_LETTER} and not x.text rlike r'{ALLOW_PATTERN}' and not array_contains(allowed, x.text))"))
    hulls = maybe.withColumn("hulls", F.when(F.size("maybe") > 0, F.expr(f"transform(maybe, y -> named_struct('at', y, 'hull', {_hull('y.text')}))")))
    added = F.expr(
        f"""filter(
          transform(filter(hulls, z -> z.hull.first >= 0), z -> named_struct('start', z.at.start + z.hull.first, 'kind', 3,
            'end', z.at.start + z.hull.last + {WINDOW}, 'text', substr(z.at.text, z.hull.first + 1, z.hull.last + {WINDOW} - z.hull.first))),
          z -> not exists(base, b -> b.start <= z.start and z.end <= b.end))"""
    )
    base, more = S.fresh(docs, "base"), S.fresh(docs, "added")
    return hulls.select("row.*", F.col("base").alias(base), F.coalesce(added, none).alias(more)), base, more


def _joined(column: str) -> Column:
    names = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({column}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')")


def scan(docs: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans.

    ``spans``: kind:start:end of all spans by start, then kind, comma-joined, in
    characters with exclusive ends; ``base_sha256`` is the digest of the same string of
    the base kinds alone. A text that is null or empty has none. Other columns are
    ignored; rows are never merged.
    """
    found, base, added = spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), allow)
    count = lambda k: F.expr(f"cast(size(filter({base}, x -> x.kind = {k})) as long)")
    return found.select(
        "doc_id",
        *(count(n).alias(f"n_{k}") for n, k in enumerate(KINDS[:3])),
        F.size(added).cast("long").alias("n_entropy"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(f"array_sort(concat({base}, {added}))").alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[secret]", allow: tuple[str, ...] = ()) -> DataFrame:
    """``docs``, all rows and columns, with every span replaced by ``mark``; ``n_chars``,
    where there is one, follows the new text. A null text stays null."""
    found, base, added = spans(docs, allow)
    out = f"""aggregate(array_sort(concat({base}, {added})), named_struct('pos', 0, 'out', ''),
      (a, x) -> named_struct('pos', greatest(a.pos, x.end), 'out', if(x.start >= a.pos, concat(a.out, substr(text, a.pos + 1, x.start - a.pos), '{mark}'), a.out)),
      a -> concat(a.out, substr(text, a.pos + 1)))"""
    hit = F.size(base) + F.size(added) > 0
    text = F.when(hit, F.expr(out)).otherwise(F.col("text"))
    columns = {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(hit, F.length(F.expr(out)).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns(columns).select(*(F.col(f"`{c}`") for c in docs.columns))


def oracle_sql() -> str:
    """DuckDB SQL with the rows of ``scan`` over documents."""
    python = ALLOW_PATTERN.replace("'", "''")
    table = "[" + ",".join(map(str, _F)) + "]"

    def places(name: str, pattern: str, kind: int, keep: str) -> str:
        pattern = pattern.replace("'", "''")
        return f"""{name} AS (
  SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'start': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0), 'text': m[i], 'value': v[i], 'kind': {kind}}})) AS s
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {1 if kind == 0 else 0}) AS v, regexp_split_to_array(t, '{pattern}') AS p FROM texts)
  ), {name}_s AS (SELECT doc_id, CAST(s.start AS BIGINT) AS st, CAST(s.start + length(s.text) AS BIGINT) AS en, {kind} AS kind, s.text AS txt FROM {name} WHERE {keep})"""

    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{places("a", ASSIGN, 0, f"length(s.value) >= {VALUE_LEAST}")},
{places("k", ACCESS, 1, "true")},
{places("h", HEX, 2, "true")},
{places("c", CANDIDATE, 3, "true")},
base AS (SELECT * FROM a_s UNION ALL SELECT * FROM k_s UNION ALL SELECT * FROM h_s),
maybe AS (SELECT * FROM c_s WHERE regexp_matches(txt, '[A-Za-z]') AND NOT regexp_matches(txt, '{python}')),
windows AS (SELECT doc_id, st, txt, unnest(range(0, length(txt) - {WINDOW - 1})) AS w FROM maybe),
sums AS (SELECT doc_id, st, txt, w, list_sum(list_transform(map_values(list_histogram(string_split(txt[w + 1:w + {WINDOW}], ''))), lambda n: {table}[CAST(n AS BIGINT) + 1])) AS total FROM windows),
hot AS (SELECT doc_id, st, min(w) AS f, max(w) AS l FROM sums WHERE total <= CASE WHEN NOT regexp_matches(txt, '[0-9]') THEN {_most(LEAST_BITS["letters"])} WHEN regexp_matches(txt, '^[0-9a-fA-F]+$') THEN {_most(LEAST_BITS["hex"])} WHEN regexp_matches(txt, '[A-Z]') THEN {_most(LEAST_BITS["mixed"])} ELSE {_most(LEAST_BITS["lower"])} END GROUP BY doc_id, st),
added AS (SELECT doc_id, st + f AS st, st + l + {WINDOW} AS en, 3 AS kind FROM hot x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.st <= x.st + x.f AND x.st + x.l + {WINDOW} <= b.en)),
every AS (SELECT doc_id, st, en, kind FROM base UNION ALL SELECT doc_id, st, en, kind FROM added),
named AS (SELECT doc_id, st, en, kind, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || st || ':' || en AS s FROM every),
per AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_entropy,
  coalesce(string_agg(s, ',' ORDER BY st, kind) FILTER (kind < 3), '') AS b, string_agg(s, ',' ORDER BY st, kind) AS spans FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per USING (doc_id)"""
