"""Substring dedup with suffix automata of reference shards.

The reference of a document is all text before it. A shard of the reference holds the
contexts of one window key (see ``windows``): the distinct word sequences around it, in
document order. A suffix automaton of the shard is built while the same contexts stream
through it, so a context meets exactly what stands earlier, its own start included. The
stream keeps the matching statistic (longest suffix of what was read that occurs
earlier); where it reaches the threshold, the maximal matched span is removed.

Sending every shard to every document would cost shards x documents. A shard can match
only documents that hold its key, so it is sent to those alone: shards and documents
meet by a shuffle on the key. Copies of a context are known as such by a 128-bit
BLAKE2b digest of its words and never streamed; all others go as words, not as hashes.
A key with very many different contexts is not one shard: there each window is a row
and the earliest place of its digest is found by a partial aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import shared as S
from graphloom.llm import windows as W

U64 = S.U64
#: Words of the grams that give a window's key.
GRAM = 4


class SuffixAutomaton:
    """Suffix automaton of several sequences, grown symbol by symbol.

    States are numbers; ``step`` reads a symbol: it first moves the match (the longest
    suffix of the current sequence that occurs in what was read before) and then
    appends the symbol to the sequence. It returns the length of the match.
    """

    __slots__ = ("edges", "last", "length", "link", "matched", "state")

    def __init__(self) -> None:
        self.edges: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.begin()

    def begin(self) -> None:
        """Start a new sequence."""
        self.last = self.state = self.matched = 0

    def step(self, symbol: int) -> int:
        edges, link, length = self.edges, self.link, self.length
        at, matched = self.state, self.matched
        while True:
            to = edges[at].get(symbol)
            if to is not None:
                at, matched = to, matched + 1
                break
            at = link[at]
            if at < 0:
                at = matched = 0
                break
            matched = length[at]
        self._append(symbol)
        while at and matched <= length[link[at]]:
            at = link[at]
        self.state, self.matched = at, matched
        return matched

    def _append(self, symbol: int) -> None:
        edges, link, length = self.edges, self.link, self.length
        p = self.last
        to = edges[p].get(symbol)
        if to is not None:
            self.last = to if length[p] + 1 == length[to] else self._clone(p, to, symbol)
            return
        new = len(edges)
        edges.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and symbol not in edges[p]:
            edges[p][symbol] = new
            p = link[p]
        if p >= 0:
            to = edges[p][symbol]
            link[new] = to if length[p] + 1 == length[to] else self._clone(p, to, symbol)
        self.last = new

    def _clone(self, p: int, to: int, symbol: int) -> int:
        edges, link, length = self.edges, self.link, self.length
        new = len(edges)
        edges.append(edges[to].copy())
        length.append(length[p] + 1)
        link.append(link[to])
        link[to] = new
        while p >= 0 and edges[p].get(symbol) == to:
            edges[p][symbol] = new
            p = link[p]
        return new


def _slices(raw: bytes, starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[bytes]:
    """Words lo to hi (exclusive) with one space between, of words joined so."""
    return (raw[x:y] for x, y in zip(starts[lo].tolist(), ends[hi - 1].tolist(), strict=True))


def _words(batch: pa.RecordBatch) -> Iterator[tuple]:
    data, offsets = S.text_bytes(batch.column("text"))
    ids = batch.column("doc_id").to_numpy()
    for i, j in S.slices_of(offsets):
        part = data[offsets[i] : offsets[j]]
        h, s, e, at = S.words(part, offsets[i : j + 1] - offsets[i])
        yield ids[i:j], np.zeros(j - i, np.int64), h, at, lambda lo, hi, part=part, s=s, e=e: _slices(*S.spaced(part, s, e), lo, hi)


def _contexts(length: int):
    def cut_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = S.text_bytes(batch.column("text"))
        row, lo, hi, v, hot = W.flat_runs(batch.column("runs"))
        _, s, e, at = S.words(data, offsets)
        found = list(_slices(*S.spaced(data, s, e), at[row] + lo, np.minimum(at[row] + hi + length, at[row + 1])))
        ids = batch.column("doc_id").to_numpy()[row]
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(ids), pa.array(lo), pa.array(hot), pa.array(found, pa.binary())], names=["v", "doc_id", "lo", "hot", "context"])

    return cut_out


def stream(contexts: list[list[int]], length: int) -> list[tuple[int, int, int]]:
    """(context, start, end) of the maximal spans of at least ``length`` symbols that
    occur earlier in the contexts, in the order given."""
    shard = SuffixAutomaton()
    out = []
    for n, context in enumerate(contexts):
        shard.begin()
        step = shard.step
        start = end = -1
        for i, symbol in enumerate(context, 1):
            m = step(symbol)
            if m >= length:
                if start >= 0 and i - m <= end:
                    start, end = min(start, i - m), i
                else:
                    if start >= 0:
                        out.append((n, start, end))
                    start, end = i - m, i
        if start >= 0:
            out.append((n, start, end))
    return out


def _shards(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in S.whole_groups(batches, "v", 4 << 20):
            ids, lo = table.column("doc_id").to_pylist(), table.column("lo").to_pylist()
            raw = table.column("context").to_pylist()
            bounds = S.group_bounds(table.column("v").to_numpy()).tolist()
            found: list[tuple[int, int, int]] = []
            number: dict[bytes, int] = {}
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                for n, s, e in stream([[number.setdefault(w, len(number)) for w in x.split(b" ")] for x in raw[a:b]], length):
                    found.append((ids[a + n], lo[a + n] + s, lo[a + n] + e))
            i, s, e = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["doc_id", "start", "end"])

    return run


def _each_window(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                ids, lo, v, raw = (batch.column(c).slice(i, 512).to_numpy(zero_copy_only=False) for c in ("doc_id", "lo", "v", "context"))
                data = np.frombuffer(b" ".join(raw), np.uint8)
                ends = np.append(np.flatnonzero(data == 32), len(data))
                starts = np.append(0, ends[:-1] + 1)
                size = np.array([x.count(b" ") + 1 for x in raw], np.int64)
                count = np.maximum(size - length + 1, 0)
                row = np.repeat(np.arange(len(raw)), count)
                place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
                at = (np.cumsum(size) - size)[row] + place
                one, two = S.digests(_slices(data.tobytes(), starts, ends, at, at + length))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array((lo[row] + place).astype(np.int32)), pa.array(v[row]), pa.array(one), pa.array(two)], names=["doc_id", "start", "v", "a", "b"])

    return run


def repeated_spans(docs: DataFrame, length: int = 20) -> DataFrame:
    """(doc_id, start, end) in words: spans whose windows of ``length`` words start
    earlier too. Spans of a document may overlap; a null doc_id or text has none."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    found = W.candidates(texts, _words, length, min(GRAM, length), first_stays=True)
    work = W.contexts(texts, found.where("work"), _contexts(length))
    cold = work.where("not hot").repartition("v").sortWithinPartitions("v", "doc_id", "lo").mapInArrow(_shards(length), "doc_id long, start int, end int")
    each = work.where("hot").mapInArrow(_each_window(length), "doc_id long, start int, v long, a long, b long")
    first = each.groupBy("v", "a", "b").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    hot = each.join(first, ["v", "a", "b"]).where("struct(doc_id, start) <> first").select("doc_id", "start", (F.col("start") + length).alias("end"))
    whole = found.where("whole").select("doc_id", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    return whole.unionByName(cold).unionByName(hot)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("spans")
        counts = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0)
        x = lists.flatten()
        start, end = x.field("start").to_numpy(), x.field("end").to_numpy()
        at = np.concatenate(([0], np.cumsum(counts)))
        total, gone, digest = [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            w = (text or "").encode().split()  # bytes split at space and bytes 9 to 13
            n = len(w)
            if counts[i]:
                s, e = W.merged(start[at[i] : at[i + 1]], np.minimum(end[at[i] : at[i + 1]], n))
                bounds = [0, *np.stack((s, e), 1).reshape(-1).tolist(), n]
                w = [y for j in range(0, len(bounds), 2) for y in w[bounds[j] : bounds[j + 1]]]
            total.append(n)
            gone.append(n - len(w))
            digest.append(hashlib.sha256(b" ".join(w)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup(docs: DataFrame, length: int = 20) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    Words are split at space and bytes 9 to 13 and not changed (null text: none). Every
    word covered by a window of ``length`` consecutive words whose word sequence also
    starts earlier (smaller doc_id, or earlier in the same document) is removed; the
    first occurrence stays. Other columns are ignored; a null doc_id row loses nothing;
    rows that repeat a doc_id are places of the same document.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = W.spans_by_doc(repeated_spans(docs, length))
    rows = texts.where("doc_id is not null").join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    lost = texts.where("doc_id is null").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return rows.unionByName(lost).mapInArrow(_apply, "doc_id long, n_words long, n_removed long, kept_sha256 string")
