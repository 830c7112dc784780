"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are read as lower-case words without punctuation. An item
and a document that share a run of ``LEAST`` words (a seed) are tiled: running
Karp-Rabin hashing finds the longest common runs of words that are not marked yet,
marks the longest first in both texts, and repeats with shorter search lengths until no
run of ``LEAST`` words is left. Tiles may stand in any order, so reordered passages
count in full. Hashes only find seeds: tiles are made of words that are equal. An item
is found in a document if its tiles cover at least ``coverage`` of its words.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import shared as S

U64 = S.U64
#: Words in a seed and in the shortest tile.
LEAST = 5
#: Places of a document whose pairs with those of an item are listed at once.
CHUNK = 1 << 14
#: Words of an item that tiles must cover.
COVERAGE = 0.6
#: Benchmarks of at most so many bytes of text go to every task; larger ones meet the documents by a shuffle on seeds.
SMALL = 8 << 20

_TABLE = S.LOWER.copy()
_TABLE[[c for c in range(128) if not chr(c).isalnum()]] = 32


def clean(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some texts in lower case, without punctuation, and where each text starts."""
    data, offsets = S.text_bytes(column)
    out = _TABLE[data]
    if len(out) > 1:  # capital letters U+00C0 to U+00DE
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out, offsets


def numbered(item: bytes, doc: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of an item and a document, equal only for equal words."""
    number: dict[bytes, int] = {}
    return tuple(np.array([number.setdefault(w, len(number)) for w in x.split()], U64) for x in (item, doc))


def _free(marked: np.ndarray, n: int) -> np.ndarray:
    """Starts of the stretches of n words without a mark."""
    total = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(total[n:] == total[: len(total) - n]) if len(marked) >= n else np.zeros(0, np.int64)


def _fragments(p: int, t: int, n: int, used_i: np.ndarray, used_d: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """What marks have left of a match, as matches of at least ``least`` words."""
    gone = np.flatnonzero(used_i[p : p + n] | used_d[t : t + n])
    bounds = np.concatenate(([-1], gone, [n]))
    for a, b in zip((bounds[:-1] + 1).tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= least:
            yield a - b, p + a, t + a


def tile(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in document, length) of the tiles.

    The longest match of unmarked words is marked first, of equal ones that which
    starts first in the item, then in the document, until none of ``least`` words is
    left. Hashes of ``search`` words find the matches of that length and more; they
    wait in a heap, and what marks leave of a match goes back to it.
    """
    used_i, used_d = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    tiles: list[tuple[int, int, int]] = []
    search = max(least, min(20, len(item)))
    sums_i, sums_d = S.BY_WORD.sums(item), S.BY_WORD.sums(doc)
    while True:
        a, b = _free(used_i, search), _free(used_d, search)
        ha, hb = S.BY_WORD.slices(sums_i, a, a + search), S.BY_WORD.slices(sums_d, b, b + search)
        order = np.argsort(ha, kind="stable")
        lo, hi = np.searchsorted(ha[order], hb), np.searchsorted(ha[order], hb, side="right")
        matches = []
        for k in range(0, len(b), CHUNK):  # pairs of starts with equal hashes
            n = (hi - lo)[k : k + CHUNK]
            t = np.repeat(b[k : k + CHUNK], n)
            p = a[order[np.repeat(lo[k : k + CHUNK] - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
            inner = (p > 0) & (t > 0)
            inner[inner] = (item[p[inner] - 1] == doc[t[inner] - 1]) & ~used_i[p[inner] - 1] & ~used_d[t[inner] - 1]
            for i, d in zip(p[~inner].tolist(), t[~inner].tolist(), strict=True):  # others are part of a match that starts earlier
                size = 0
                while i + size < len(item) and d + size < len(doc) and not used_i[i + size] and not used_d[d + size] and item[i + size] == doc[d + size]:
                    size += 1
                if size >= search:
                    matches.append((-size, i, d))
        heapq.heapify(matches)
        while matches:
            n, p, t = heapq.heappop(matches)
            if used_i[p : p - n].any() or used_d[t : t - n].any():
                for left in _fragments(p, t, -n, used_i, used_d, search):
                    heapq.heappush(matches, left)
                continue
            used_i[p : p - n] = True
            used_d[t : t - n] = True
            tiles.append((p, t, -n))
        if search == least:
            return tiles
        search = max(least, search // 2)


class Items:
    """The benchmark in memory: text of each item, and items by seed."""

    def __init__(self, ids: list[int], texts: list[bytes]) -> None:
        self.ids, self.texts = ids, texts
        words = [S.words(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0] for x in texts]
        grams = [S.BY_WORD.grams(S.BY_WORD.sums(w), LEAST) for w in words]
        every = np.concatenate(grams) if grams else np.zeros(0, U64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        order = np.argsort(every, kind="stable")
        self.seeds, self.owner = every[order], owner[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(S.mix(self.seeds) >> U64(42)).astype(np.int64)] = True

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Items that share a seed with these grams."""
        grams = np.unique(grams)
        a, b = np.searchsorted(self.seeds, grams), np.searchsorted(self.seeds, grams, side="right")
        found = [self.owner[x:y] for x, y in zip(a, b, strict=True) if y > x]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


ROW = "doc_id long, item_id long, coverage double, n_tiles int"


def _pairs(out: list[tuple]) -> pa.RecordBatch:
    d, i, c, n = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(c, pa.float64()), pa.array(n, pa.int32())], names=["doc_id", "item_id", "coverage", "n_tiles"])


def _found(doc_id: int, item_id: int, item: bytes, doc: bytes) -> list[tuple]:
    a, b = numbered(item, doc)
    tiles = tile(a, b)
    return [(doc_id, item_id, sum(t[2] for t in tiles) / len(a), len(tiles))] if tiles else []


def _against(shared_items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*shared_items.value)
        for batch in batches:
            _, offsets = S.text_bytes(batch.column("text"))
            for i, j in S.slices_of(offsets):
                part = batch.slice(i, j - i)
                data, offset = clean(part.column("text"))
                h, _, _, at = S.words(data, offset)
                grams = S.BY_WORD.grams(S.BY_WORD.sums(h), LEAST)
                maybe = np.flatnonzero(items.bits[(S.mix(grams) >> U64(42)).astype(np.int64)])
                doc = np.searchsorted(at, maybe, side="right") - 1
                inside = maybe + LEAST <= at[doc + 1]
                maybe, doc = maybe[inside], doc[inside]
                ids, out = part.column("doc_id").to_pylist(), []
                for d in np.unique(doc).tolist():
                    text = data[offset[d] : offset[d + 1]].tobytes()
                    for k in items.of(grams[maybe[doc == d]]).tolist():
                        out += _found(ids[d], items.ids[k], items.texts[k], text)
                yield _pairs(out)

    return run


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, offsets = S.text_bytes(batch.column("text"))
        for i, j in S.slices_of(offsets):
            part = batch.slice(i, j - i)
            h, _, _, at = S.words(*clean(part.column("text")))
            grams = S.BY_WORD.grams(S.BY_WORD.sums(h), LEAST)
            start = np.arange(len(grams))
            doc = np.searchsorted(at, start, side="right") - 1
            inside = start + LEAST <= at[doc + 1]
            yield pa.RecordBatch.from_arrays([pa.array(part.column("id").to_numpy()[doc[inside]]), pa.array(S.signed(grams[inside]))], names=["id", "seed"])


def _tile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            (a, at), (b, bt) = clean(part.column("item_text")), clean(part.column("text"))
            out = []
            for r, (d, k) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("item_id").to_pylist(), strict=True)):
                out += _found(d, k, a[at[r] : at[r + 1]].tobytes(), b[bt[r] : bt[r + 1]].tobytes())
            yield _pairs(out)


def overlaps(docs: DataFrame, benchmark: DataFrame, small: int = SMALL) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles) of each pair with a common tile.

    Items of fewer than ``LEAST`` words, null texts and null ids match nothing; of rows
    that repeat an item_id each is an item of its own.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item_text")).where("item_id is not null and item_text is not null")
    if (items.agg(F.sum(F.octet_length("item_text")).alias("n")).first()["n"] or 0) <= small:
        rows = items.toArrow()
        data, at = clean(rows.column("item_text"))
        own = [(i, data[x:y].tobytes()) for i, x, y in zip(rows.column("item_id").to_pylist(), at[:-1], at[1:], strict=True)]
        sent = docs.sparkSession.sparkContext.broadcast(([i for i, _ in own], [t for _, t in own]))
        return texts.mapInArrow(_against(sent), ROW)
    keyed = items.withColumn("id", F.xxhash64("item_id", "item_text"))
    wanted = keyed.select("id", F.col("item_text").alias("text")).mapInArrow(_seeds, "id long, seed long").distinct()
    seeds = texts.select(F.col("doc_id").alias("id"), "text").mapInArrow(_seeds, "id long, seed long").withColumnRenamed("id", "doc_id")
    pairs = seeds.join(wanted, "seed").select("doc_id", "id").distinct()
    return pairs.join(keyed, "id").join(texts, "doc_id").select("doc_id", "item_id", "item_text", "text").mapInArrow(_tile_rows, ROW)


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, small: int = SMALL) -> DataFrame:
    """Per row of ``docs``: doc_id, contaminated, kept, n_items, item_id, coverage.

    ``contaminated``: an item of ``benchmark`` is covered to at least ``coverage``;
    ``item_id`` is the one covered most (then the smallest id), with its coverage;
    null and 0.0 where the document is clean. Other columns are ignored. Null texts and
    null doc_ids are clean; rows that repeat a doc_id share their findings.
    """
    found = overlaps(docs, benchmark, small).where(F.col("coverage") >= coverage)
    best = found.groupBy("doc_id").agg(F.count_distinct("item_id").alias("n_items"), F.max(F.struct("coverage", (-F.col("item_id")).alias("i"))).alias("top"))
    best = best.select("doc_id", "n_items", (-F.col("top.i")).alias("item_id"), F.col("top.coverage").alias("coverage"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(best, "doc_id", "left")
    hit = F.col("n_items").isNotNull()
    return rows.select("doc_id", hit.alias("contaminated"), (~hit).alias("kept"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The clean rows of ``docs``, all columns."""
    hit = S.fresh(docs, "hit")
    found = overlaps(docs, benchmark).where(F.col("coverage") >= coverage).select(F.col("doc_id").alias(hit)).distinct()
    return docs.join(found, F.col("doc_id").cast("long") == F.col(hit), "left_anti")
