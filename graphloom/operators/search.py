"""Text retrieval: literal line search, source windows, BM25 over fields, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators.lineage import cut

# Page limits, field weights and BM25 constants.
PAGE_BYTES, PREVIEW, PREVIEW_LEAD, PAGE_LIMIT = 48_000, 160, 30, 100
FIELD_WEIGHT = {"name": 3.0, "qualified": 1.5, "file": 0.8, "doc": 1.0, "class_doc": 0.6, "declaration": 0.35, "body": 0.35}
TYPE_FACTOR, DUNDER_FACTOR = 0.8, 0.85


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text of every line of ``files`` (path, text)."""
    out = files.select("path", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return out.select("path", (F.col("n") + 1).alias("line"), "text")


def search(files: DataFrame, literal: str, limit: int = PAGE_LIMIT, offset: int = 0) -> DataFrame:
    """Lines that hold a literal, by (path, line): path, line, column, preview.

    The file is tested before it is split into lines; the page ends at ``limit`` rows
    or at PAGE_BYTES bytes of previews.
    """
    hits = lines(files.where(F.col("text").contains(literal))).where(F.col("text").contains(literal))
    column = F.instr("text", literal)
    first = F.greatest(column - PREVIEW_LEAD, F.lit(1))
    rows = hits.select("path", "line", column.alias("column"), F.substr("text", first, F.lit(PREVIEW)).alias("preview"))
    page = rows.orderBy("path", "line").offset(offset).limit(min(limit, PAGE_LIMIT))
    total = F.sum(F.octet_length("preview")).over(Window.orderBy("path", "line").rowsBetween(Window.unboundedPreceding, 0))
    return page.withColumn("_bytes", total).where(F.col("_bytes") <= PAGE_BYTES).drop("_bytes")


def source(files: DataFrame, path: str, start: int, count: int) -> DataFrame:
    """Lines ``start`` to ``start + count - 1`` of a file, with the next line to ask for (null at the end)."""
    count = min(count, 200)
    every = lines(files.where(F.col("path") == path)).where(F.col("line") >= start)
    window = every.where(F.col("line") < start + count)
    more = every.where(F.col("line") == start + count).select(F.lit(start + count).alias("next_line")).limit(1)
    return window.join(F.broadcast(more), F.lit(True), "left").select("line", "text", "next_line")


def postings(symbols: DataFrame, fields: list[str]) -> DataFrame:
    """uid, field, term, tf of the folded terms of the fields (null is empty)."""
    texts = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), T.terms(F.coalesce(F.col(f), F.lit(""))).alias("terms")) for f in fields)))
    return symbols.select("uid", texts.alias("x")).select("uid", "x.field", F.explode("x.terms").alias("term")).groupBy("uid", "field", "term").agg(F.count("*").alias("tf"))


def bm25(symbols: DataFrame, question: str, fields: list[str], limit: int = 20, offset: int = 0, keep=None, weights: dict[str, float] | None = None) -> DataFrame:
    """uid, score of the best symbols: by score, then uid; rounded after sorting.

    ``symbols``: uid, the text ``fields``, and optionally ``factor``. A term's document
    frequency counts a symbol once over all fields; ``keep`` (a condition) is applied
    before paging; ``weights`` restricts the fields that score.
    """
    weights = weights or {f: FIELD_WEIGHT[f] for f in fields if f != "body"}
    wanted = symbols.sparkSession.range(1).select(F.array_distinct(T.terms(F.lit(question))).alias("t")).first()["t"]
    texts = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("text")) for f in fields)))
    split = symbols.select("uid", texts.alias("x")).select("uid", "x.field", T.terms(F.col("x.text")).alias("terms"))
    # One pass over the texts: lengths of all fields, and the question's terms alone.
    found = cut(split.select("uid", "field", F.size("terms").alias("len"), F.filter("terms", lambda w: w.isin(wanted)).alias("terms")))
    n = max(1, found.count() // len(fields))
    average = found.groupBy("field").agg((F.sum("len") / n).alias("avg"))
    hits = found.where(F.size("terms") > 0).select("uid", "field", "len", F.explode("terms").alias("term")).groupBy("uid", "field", "len", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count_distinct("uid").alias("df")).select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    scored = hits.where(F.col("field").isin(list(weights))).join(F.broadcast(df), "term").join(F.broadcast(average), "field")
    part = table[F.col("field")] * F.col("idf") * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("avg")))
    factor = F.coalesce(F.col("factor"), F.lit(1.0)) if "factor" in symbols.columns else F.lit(1.0)
    total = scored.groupBy("uid").agg(F.sum(part).alias("raw")).join(symbols, "uid")
    total = total.where(keep) if keep is not None else total
    ranked = total.select("uid", (F.col("raw") * factor).alias("raw")).where("raw > 0").orderBy(F.desc(F.round("raw", 9)), "uid").offset(offset).limit(limit)
    return ranked.select("uid", F.round("raw", 3).alias("score"))


def symbol_factor(kind, name):
    """Types and dunder members score lower."""
    dunder = name.startswith("__") & name.endswith("__")
    return F.when(kind.isin("class", "interface", "type"), TYPE_FACTOR).otherwise(1.0) * F.when(dunder, DUNDER_FACTOR).otherwise(1.0)


def suggest(symbols: DataFrame, reference: str, fields: list[str]) -> DataFrame:
    """At most three uids: of the exact name first, then the best hits."""
    exact = symbols.where(F.col("name") == reference).select(F.lit(0).alias("rank"), F.lit(0.0).alias("score"), "uid")
    ranked = bm25(symbols, reference, fields, limit=3).select(F.lit(1).alias("rank"), (-F.col("score")).alias("score"), "uid")
    best = exact.unionByName(ranked).groupBy("uid").agg(F.min(F.struct("rank", "score")).alias("by"))
    return best.orderBy("by", "uid").limit(3).select("uid")


def nearest_named(symbols: DataFrame, path: str, line: int) -> DataFrame:
    """At most five symbols nearest to a line."""
    distance = F.when(F.lit(line) < F.col("start_line"), F.col("start_line") - line).when(F.lit(line) > F.col("end_line"), line - F.col("end_line")).otherwise(0)
    return symbols.where(F.col("path") == path).select("uid", distance.alias("distance"), "start_line").orderBy("distance", "start_line", "uid").limit(5)
