"""URL filters with a Bloom filter cascade.

A rule is a host and a path prefix; it fits the host, all its subdomains, and paths
that start with the prefix. A page's keys are all rule strings that would fit it: every
suffix of its host at a label, with every prefix of its path that is as long as some
rule's path. The corpus's complete key universe is the set of all pages' keys.

The cascade makes membership in the list exact over that universe without a join. Level
0 holds the listed keys; level 1 the keys of the universe that level 0 takes wrongly;
level 2 the listed keys that level 1 takes wrongly, and so on until no key is left. A
key is listed if the first level that does not hold it is an odd one. Level 0 is sized
by the ratio of list to universe, so all levels together grow with the list and the
logarithm of the universe only; that is what is sent to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import shared as S

U64 = S.U64
Rules = Sequence[tuple[str, str]]


class Bloom:
    """A Bloom filter over pairs of 64-bit hashes."""

    def __init__(self, one: np.ndarray, two: np.ndarray, p: float, salt: int) -> None:
        self.salt, self.spread = U64(salt), U64(salt * 0x9E3779B97F4A7C15 % 2**64)
        n = max(1, len(one))
        self.size = max(64, math.ceil(n * -math.log(p) / math.log(2) ** 2))
        self.tests = max(1, round(self.size / n * math.log(2)))
        self.bits = np.zeros(self.size, bool)
        for place in self._places(one, two):
            self.bits[place] = True
        self.bits = np.packbits(self.bits)

    def _places(self, one: np.ndarray, two: np.ndarray) -> Iterator[np.ndarray]:
        step = S.mix(two + self.salt) | U64(1)
        at = S.mix(one ^ self.spread)
        for _ in range(self.tests):
            yield (at % U64(self.size)).astype(np.int64)
            at = at + step

    def holds(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = np.ones(len(one), bool)
        for place in self._places(one, two):
            out &= (self.bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
        return out


class Cascade:
    """Levels of Bloom filters that tell listed keys from the rest of a universe."""

    def __init__(self) -> None:
        self.levels: list[Bloom] = []

    def grow(self, listed: tuple[np.ndarray, np.ndarray], wrong: tuple[np.ndarray, np.ndarray]) -> None:
        """Add levels until nothing is taken wrongly; ``wrong`` are the keys of the
        universe off the list that level 0 holds."""
        own, other = wrong, listed
        while len(own[0]):
            level = Bloom(*own, 0.5, len(self.levels) + 1)
            self.levels.append(level)
            hit = level.holds(*other)
            own, other = (other[0][hit], other[1][hit]), own

    def has(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = np.full(len(one), len(self.levels) % 2 == 1)
        open_ = np.ones(len(one), bool)
        for n, level in enumerate(self.levels):
            stop = open_ & ~level.holds(one, two)
            out[stop] = n % 2 == 1
            open_ &= ~stop
        return out


def split_url(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path) of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 1), upper, upper.lower()), F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 2)


def _keys(host: str, path: str, lengths: list[int]) -> Column:
    labels = f"split({host}, '[.]')"
    suffixes = f"transform(sequence(1, size({labels})), i -> array_join(slice({labels}, i, size({labels})), '.'))"
    prefixes = f"transform(filter(array({','.join(map(str, lengths))}), n -> n <= length({path})), n -> substr({path}, 1, n))"
    return F.expr(f"flatten(transform({suffixes}, h -> transform({prefixes}, p -> concat(h, p))))")


def _hashes(df: DataFrame, key: str = "key") -> DataFrame:
    return df.select(F.xxhash64(key).alias("a"), F.xxhash64(F.col(key), F.lit(1)).alias("b"))


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = df.toArrow()
    return tuple(rows.column(c).to_numpy().view(U64) for c in ("a", "b"))


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of the keys of ``listed`` over those of ``universe`` (columns a, b: hashes).

    Only the list and the keys of the universe that level 0 takes wrongly reach the
    driver: about as many as the list has, by the size of level 0.
    """
    own = _arrays(listed)
    out = Cascade()
    if not len(own[0]):
        return out
    rest = universe.join(listed, ["a", "b"], "left_anti")
    n = max(1, universe.count())
    out.levels.append(Bloom(*own, min(0.5, max(1e-12, len(own[0]) * math.sqrt(0.5) / n)), 0))
    sent = universe.sparkSession.sparkContext.broadcast(out.levels[0])

    def wrong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = sent.value.holds(*(batch.column(c).to_numpy().view(U64) for c in ("a", "b")))
            yield batch.filter(pa.array(hit))

    out.grow(own, _arrays(rest.mapInArrow(wrong, "a long, b long")))
    return out


def _judge(sent, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow, block = sent.value
        for batch in batches:
            lists = batch.column("keys")
            counts = np.diff(lists.offsets.to_numpy())
            keys = lists.flatten()
            one, two = (batch.column(c).flatten().to_numpy().view(U64) for c in ("a", "b"))
            is_block = block.has(one, two)
            hit = np.flatnonzero(is_block | allow.has(one, two))
            page = np.repeat(np.arange(batch.num_rows), counts)[hit]
            text = keys.take(pa.array(hit)).to_pylist()
            order = sorted(range(len(hit)), key=lambda i: (page[i], len(text[i]), text[i].find("/")))
            rule, verdict = [None] * batch.num_rows, ["allow"] * batch.num_rows
            for i in order:  # the longest comes last
                rule[page[i]] = text[i]
                verdict[page[i]] = "block" if is_block[hit[i]] else "allow"
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*names, "rule", "verdict"])

    return run


def judge(pages: DataFrame, allow: Rules, block: Rules) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict.

    ``rule`` is the longest listed key that fits the page (of equally long ones the
    longer host; null without one) and ``verdict`` the rule's list; a key on both lists
    is blocked. A page that no rule fits is not on the block list, so the method allows
    it. A url that is null or has no ``://`` has an empty host and path and fits no
    rule. Other columns are ignored; repeated rows are each judged. The lists are
    arguments that the caller holds; what is sent to the tasks is some bytes a rule,
    whatever the size of the corpus.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    lists = [sorted({h.lower() + p for h, p in rules}) for rules in (allow, block)]
    lengths = sorted({len(p) for rules in (allow, block) for _, p in rules})
    if not lengths:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    keyed = rows.withColumn("keys", F.when(F.col("host") != "", _keys("host", "path", lengths)).otherwise(F.expr("cast(array() as array<string>)")))
    universe = S.cut(_hashes(keyed.select(F.explode("keys").alias("key")).distinct()))
    as_table = lambda keys: _hashes(spark.createDataFrame([(k,) for k in keys], "key string"))
    sent = spark.sparkContext.broadcast(tuple(build(as_table(keys), universe) for keys in lists))
    hashed = keyed.withColumns({"a": F.transform("keys", lambda k: F.xxhash64(k)), "b": F.transform("keys", lambda k: F.xxhash64(k, F.lit(1)))})
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string"
    return hashed.mapInArrow(_judge(sent, ["page_id", "host", "path"]), schema)


def oracle_sql(allow: Rules, block: Rules) -> str:
    """DuckDB SQL with the rows of ``judge`` over pages."""
    rules = ", ".join(f"('{h.lower()}', '{p}', '{v}')" for rules, v in ((allow, "allow"), (block, "block")) for h, p in rules)
    return f"""
WITH rules(h, p, v) AS (VALUES {rules}),
rest AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN instr(url, '://') > 0 THEN url[instr(url, '://') + 3:] ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, n, translate(regexp_extract(r, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^([^/?#]*)([^?#]*)', 2) AS path FROM rest),
fit AS (SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC, v DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fit ON fit.n = parts.n AND k = 1"""
