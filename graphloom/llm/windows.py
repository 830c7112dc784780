"""Repeated fixed-length windows: candidates by content, without pairs.

A sequence (bytes or words of a text) is split into runs of window starts. The windows
of a run share one key: the smallest hash of the short grams inside the window. Equal
windows have equal keys wherever they stand, so a window can only repeat where its key
does, and one row for a run of windows stands for all of them. Nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import shared as S

U64 = S.U64
#: Window starts in a run at most, so that a row's context is bounded.
LONGEST_RUN = 512
#: Windows in the different contexts of one key that one task takes; beyond, windows are dealt out one by one.
HOT = 300_000


def sliding(x: np.ndarray, w: int, best: np.ufunc, pad: int) -> np.ndarray:
    """best over x[i : i + w] for each i up to len(x) - w, by block prefixes and suffixes."""
    n = len(x)
    if n < w:
        return np.zeros(0, x.dtype)
    full = np.full(-(-n // w) * w, pad, x.dtype)
    full[:n] = x
    block = full.reshape(-1, w)
    ahead = best.accumulate(block, axis=1).reshape(-1)
    back = best.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return best(back[: n - w + 1], ahead[w - 1 : n])


def runs(symbols: np.ndarray, at: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of the windows of several sequences that stand one after the other.

    ``at``: where each sequence starts, and the end. Returns per run: sequence, first
    and last window start (in the whole array), key, and whether a window may repeat
    within the run itself.
    """
    w = length - k + 1
    gram = S.mix(S.BY_WORD.grams(S.BY_WORD.sums(symbols), k)) | U64(1)
    low = sliding(gram, w, np.minimum, 2**64 - 1)
    z = np.zeros(0, np.int64)
    if not len(low):
        return z, z, z, np.zeros(0, U64), np.zeros(0, bool)
    ok = np.zeros(len(low) + 1, np.int8)
    a, b = at[:-1], np.maximum(at[1:] - length + 1, at[:-1])
    a, b = a[b > a], b[b > a]
    np.add.at(ok, a, 1)
    np.add.at(ok, b, -1)
    ok = np.cumsum(ok[:-1]).astype(bool)
    starts = np.flatnonzero(ok)
    if not len(starts):
        return z, z, z, np.zeros(0, U64), np.zeros(0, bool)
    key = low[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(starts)))
    if (sizes > LONGEST_RUN).any():
        more = [np.arange(f, f + n, LONGEST_RUN) for f, n in zip(first, sizes, strict=True) if n > LONGEST_RUN]
        first = np.union1d(first, np.concatenate(more))
        sizes = np.diff(np.append(first, len(starts)))
    lo, v = starts[first], key[first]
    hi = lo + sizes - 1
    seq = np.searchsorted(at, lo, side="right") - 1
    # A gram that is the smallest of some window; a key with two of them in one sequence may repeat within a run.
    low[~ok] = 0
    most = sliding(np.concatenate((np.zeros(w - 1, U64), low, np.zeros(w - 1, U64))), w, np.maximum, 0)
    anchor = np.flatnonzero(most == gram[: len(most)])
    home = np.searchsorted(at, anchor, side="right") - 1
    found, times = np.unique(S.mix(gram[anchor] ^ S.mix(home.astype(U64) + U64(7))), return_counts=True)
    multi = np.isin(S.mix(v ^ S.mix(seq.astype(U64) + U64(7))), found[times > 1])
    return seq, lo, hi, v, multi


#: Of a batch: ids, place of the first symbol in its text, symbols, starts of the
#: sequences, and a function that gives the bytes of slices of the symbols.
Symbols = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable[[np.ndarray, np.ndarray], Iterator[bytes]]]]]


def _scan(parts: Symbols, length: int, k: int, keys_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, base, symbols, at, raw in parts(batch):
                seq, lo, hi, v, multi = runs(symbols, at, length, k)
                v = pa.array(S.signed(v))
                if keys_only:
                    yield pa.RecordBatch.from_arrays([v], names=["v"])
                    continue
                move = base[seq] - at[seq]
                c, d = S.digests(raw(lo, hi + length))
                yield pa.RecordBatch.from_arrays([pa.array(ids[seq]), v, pa.array(c), pa.array(d), pa.array((lo + move).astype(np.int32)), pa.array((hi + move).astype(np.int32)), pa.array(multi)], names=["doc_id", "v", "c", "d", "lo", "hi", "multi"])

    return run


RUN_ROW = "doc_id long, v long, c long, d long, lo int, hi int, multi boolean"


def candidates(texts: DataFrame, parts: Symbols, length: int, k: int, first_stays: bool) -> DataFrame:
    """Runs with a window that may repeat: doc_id, lo, hi, v, whole, work, hot.

    ``whole``: every window of the run repeats, since the whole context (known by a
    128-bit BLAKE2b digest of its bytes) stands elsewhere too (``first_stays``:
    earlier). ``work``: windows have to be compared with
    the other contexts of the key; of equal contexts only the first works. ``hot``: the
    key's different contexts have more than HOT windows.
    """
    seen = texts.mapInArrow(_scan(parts, length, k, True), "v long").groupBy("v").agg(F.count("*").alias("n"))
    rows = texts.mapInArrow(_scan(parts, length, k, False), RUN_ROW)
    known = rows.join(seen, "v").where("n > 1 or multi").drop("n")
    known = S.cut(known)
    classes = known.groupBy("v", "c", "d").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "lo")).alias("first"), F.max("multi").alias("inner"), F.max(F.col("hi") - F.col("lo") + 1).alias("size"))
    keys = classes.groupBy("v").agg(F.count("*").alias("m"), F.sum("size").alias("windows"))
    classes = classes.join(keys, "v")
    is_first = F.struct("doc_id", "lo") == F.col("first")
    whole = ~is_first if first_stays else F.col("n") > 1
    out = known.drop("multi").join(classes, ["v", "c", "d"]).select("doc_id", "lo", "hi", "v", whole.alias("whole"), (is_first & ((F.col("m") > 1) | F.col("inner"))).alias("work"), (F.col("windows") > HOT).alias("hot"))
    return S.cut(out.where("whole or work"))


def contexts(texts: DataFrame, work: DataFrame, cut_out: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """(v, doc_id, lo, hot, context) of the runs that have to be compared."""
    per_doc = work.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "v", "hot")).alias("runs"))
    joined = texts.join(per_doc, "doc_id").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                yield cut_out(batch.slice(i, 256))

    return joined.mapInArrow(run, "v long, doc_id long, lo int, hot boolean, context binary")


def flat_runs(column: pa.Array) -> tuple[np.ndarray, ...]:
    """The run lists of some documents: row of each run, and its lo, hi, v, hot."""
    counts = np.diff(column.offsets.to_numpy())
    x = column.flatten()
    return np.repeat(np.arange(len(column)), counts), *(x.field(n).to_numpy(zero_copy_only=False) for n in ("lo", "hi", "v", "hot"))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open spans, overlapping and touching ones as one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1] if len(start) else end


def spans_by_doc(spans: DataFrame) -> DataFrame:
    """doc_id, spans: list of (start, end) of each document."""
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def window_spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted starts of hit windows as spans: [start, end) of runs of neighbours."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.append(0, new + 1)], starts[np.append(new, len(starts) - 1)] + length
