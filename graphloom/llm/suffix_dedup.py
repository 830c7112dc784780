"""Suffix-array dedup by a depth-limited radix sort.

Suffixes are ordered only through the threshold: most-significant-digit passes split
the suffixes into groups, and the groups that are left at full depth are exactly the
windows that occur more than once. The key of ``windows`` (equal for equal windows, so
no group is torn apart) deals the suffixes to tasks; there the digits are the bytes
themselves, eight a pass, most significant first. A pass orders only groups whose
digits differ, and a suffix alone in its group drops out at once. A key with very many
different contexts is not sorted in one task: there one pass takes all digits at once,
each window is a row, and its 128-bit digest is counted with a partial aggregation.
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
#: Bytes of the grams that give the key, and of a digit.
GRAM, DIGIT = 32, 8
#: Longest stretch of a text that is scanned at once.
STRETCH = 1 << 18


def _stretches(length: int):
    def parts(batch: pa.RecordBatch) -> Iterator[tuple]:
        data, offsets = S.text_bytes(batch.column("text"))
        ids = batch.column("doc_id").to_numpy()

        def part(data: np.ndarray, *what: np.ndarray) -> tuple:
            raw = data.tobytes()
            return what[0], what[1], S.BYTE_VALUES[data], what[2], lambda lo, hi: (raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True))

        for i, j in S.slices_of(offsets, STRETCH):
            if offsets[j] - offsets[i] <= STRETCH:
                yield part(data[offsets[i] : offsets[j]], ids[i:j], np.zeros(j - i, np.int64), offsets[i : j + 1] - offsets[i])
                continue
            for a in range(0, int(offsets[j] - offsets[i]), STRETCH):  # one long text
                b = min(a + STRETCH + length - 1, int(offsets[j] - offsets[i]))
                yield part(data[offsets[i] + a : offsets[i] + b], ids[i:j], np.array([a]), np.array([0, b - a]))

    return parts


def _contexts(length: int):
    def cut_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = S.text_bytes(batch.column("text"))
        row, lo, hi, v, hot = W.flat_runs(batch.column("runs"))
        raw = data.tobytes()
        a, b = offsets[row] + lo, np.minimum(offsets[row] + hi + length, offsets[row + 1])
        found = [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        ids = batch.column("doc_id").to_numpy()[row]
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(ids), pa.array(lo), pa.array(hot), pa.array(found, pa.binary())], names=["v", "doc_id", "lo", "hot", "context"])

    return cut_out


def _windows(table: pa.Table | pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the contexts, and of each window in them its row, start and place in the bytes."""
    column = table.column("context")
    column = (pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    count = np.maximum(np.diff(offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(column)), count)
    begin = np.concatenate(([0], np.cumsum(count)))
    place = np.arange(begin[-1]) - begin[row]
    return data, row, place, offsets[row] + place


def _digits(data: np.ndarray) -> np.ndarray:
    """The DIGIT bytes that start at each place, the first one most significant."""
    out = np.zeros(len(data), U64)
    for k in range(DIGIT):
        out[: len(data) - k] |= data[k:].astype(U64) << U64(8 * (DIGIT - 1 - k))
    return out


def sort_passes(key: np.ndarray, at: np.ndarray, digits: np.ndarray, length: int) -> np.ndarray:
    """Windows (numbers, in order) whose key and ``length`` bytes another window has too.

    ``key`` of each window, in ascending runs or not; ``at``: its place in ``digits``.
    """
    order = np.arange(len(at))
    new = np.zeros(len(at), bool)
    new[:1] = True
    place, group = at, key
    for d in range(0, length, DIGIT):
        x = digits[place + d] >> U64(8 * max(0, DIGIT - (length - d)))
        if d:
            uneven = ~new[1:] & (x[1:] != x[:-1])
            if not uneven.any():
                continue
            group = np.cumsum(new)
            torn = np.zeros(group[-1] + 1, bool)
            torn[group[1:][uneven]] = True
            some = np.flatnonzero(torn[group])
        else:
            some = np.arange(len(at))
        sorted_ = some[np.lexsort((x[some], group[some]))]
        order[some], place, x[some], own = order[sorted_], place.copy(), x[sorted_], group[sorted_]
        place[some] = at[order[some]]
        first = np.ones(len(some), bool)
        first[1:] = (own[1:] != own[:-1]) | (x[some][1:] != x[some][:-1])
        new[some] = first
        last = np.append(new[1:], True)
        stay = ~(new & last)
        order, place, new = order[stay], place[stay], new[stay]
        if not len(order):
            break
    return np.sort(order)


def repeated(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and start of every window of the contexts that another window of its key equals."""
    data, row, place, at = _windows(table, length)
    left = sort_passes(table.column("v").to_numpy()[row], at, _digits(data), length)
    return row[left], place[left]


def _spans(ids: np.ndarray, lo: np.ndarray, row: np.ndarray, place: np.ndarray, length: int) -> pa.RecordBatch:
    """Neighbouring windows of a row as one span."""
    if not len(row):
        e = pa.array([], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), e, e], names=["doc_id", "start", "end"])
    new = np.flatnonzero((np.diff(row) != 0) | (np.diff(place) != 1))
    a, b = np.append(0, new + 1), np.append(new, len(row) - 1)
    r = row[a]
    return pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array((lo[r] + place[a]).astype(np.int32)), pa.array((lo[r] + place[b] + length).astype(np.int32))], names=["doc_id", "start", "end"])


def _sort_groups(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in S.whole_groups(batches, "v", 1 << 20):
            row, place = repeated(table, length)
            yield _spans(table.column("doc_id").to_numpy(), table.column("lo").to_numpy(), row, place, length)

    return run


def _each_window(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                data, row, place, at = _windows(part, length)
                raw = data.tobytes()
                one, two = S.digests(raw[p : p + length] for p in at.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(part.column("doc_id").to_numpy()[row]), pa.array((part.column("lo").to_numpy()[row] + place).astype(np.int32)), pa.array(one), pa.array(two)], names=["doc_id", "start", "a", "b"])

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        lists = batch.column("spans")
        counts = np.diff(lists.offsets.to_numpy())
        x = lists.flatten()
        start, end = x.field("start").to_numpy(), x.field("end").to_numpy()
        at = np.concatenate(([0], np.cumsum(np.where(lists.is_valid().to_numpy(zero_copy_only=False), counts, 0))))
        size, gone, many, digest = [], [], [], []
        for i, text in enumerate(texts):
            raw = (text or "").encode()
            s, e = W.merged(start[at[i] : at[i + 1]], np.minimum(end[at[i] : at[i + 1]], len(raw)))
            bounds = [0, *np.stack((s, e), 1).reshape(-1).tolist(), len(raw)]
            rest = b"".join(raw[bounds[j] : bounds[j + 1]] for j in range(0, len(bounds), 2))
            size.append(len(raw))
            gone.append(len(raw) - len(rest))
            many.append(len(s))
            digest.append(hashlib.sha256(rest).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, start, end): bytes of strings of ``length`` bytes that start elsewhere too.

    Spans of a document may overlap. Rows with a null doc_id or text have none; rows
    that repeat a doc_id count as further places of the text.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    k = min(GRAM, max(1, length // 4))
    found = W.candidates(texts, _stretches(length), length, k, first_stays=False)
    work = W.contexts(texts, found.where("work"), _contexts(length))
    cold = work.where("not hot").repartition("v").sortWithinPartitions("v").mapInArrow(_sort_groups(length), "doc_id long, start int, end int")
    each = work.where("hot").mapInArrow(_each_window(length), "doc_id long, start int, a long, b long")
    twice = each.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    hot = each.join(twice, ["a", "b"]).select("doc_id", "start", (F.col("start") + length).alias("end"))
    whole = found.where("whole").select("doc_id", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    return whole.unionByName(cold).unionByName(hot)


def dedup(docs: DataFrame, length: int = 400) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes (null: empty). Every byte covered by a ``length``-byte string
    that also starts anywhere else, in another document or the same, is removed;
    matches never cross documents. ``n_spans`` counts maximal removed runs. Other
    columns are ignored; a null doc_id row loses nothing.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = W.spans_by_doc(repeated_spans(docs, length))
    rows = texts.where("doc_id is not null").join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    lost = texts.where("doc_id is null").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return rows.unionByName(lost).mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
