"""Helpers shared by the operators: cut lineage, stream whole groups, hash sequences."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a local one, unless
    the executors run on other machines."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Rows in a batch that goes to Python at most: whole texts are long rows.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS where it is larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def _drop_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended; the cluster cleans its folder
            return


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so that later
    stages, also after a lost executor, start from files all machines can read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/graphloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_drop_written)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, target: int = 8 << 20) -> Iterator[pa.Table]:
    """Rows sorted by ``key`` come in; tables that hold only whole groups go out.

    A table is sent once about ``target`` bytes wait, so memory is bounded by that
    plus the largest group (callers bound the groups).
    """
    wait: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        wait.append(batch)
        size += batch.nbytes
        if size < target:
            continue
        table = pa.Table.from_batches(wait)
        keys = table.column(key).to_numpy()
        start = len(keys) - int(np.argmin((keys == keys[-1])[::-1])) if (keys != keys[-1]).any() else 0
        if start:
            yield table.slice(0, start).combine_chunks()
            wait, size = table.slice(start).combine_chunks().to_batches(), 0
            size = sum(b.nbytes for b in wait)
    if wait:
        yield pa.Table.from_batches(wait).combine_chunks()


def group_bounds(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def digests(parts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit BLAKE2b digests of byte strings, as two 64-bit columns."""
    every = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts]), np.int64).reshape(-1, 2)
    return every[:, 0], every[:, 1]


class Rolling:
    """Polynomial hashes modulo 2**64 of any slice of a sequence of 64-bit symbols.

    With an odd base the powers have inverses, so one running sum gives the hash of
    each slice by a subtraction and a multiplication, for a whole batch at once. Long
    regular sequences collide: good for seeds and keys, never as a proof of equality.
    """

    def __init__(self, base: int) -> None:
        self.base = base | 1
        self.down = np.ones(1, U64)
        self.up = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.up) >= n:
            return
        n = max(n, 1 << 16, 2 * len(self.up))
        inverse = pow(self.base, -1, 1 << 64)
        for name, b in (("up", self.base), ("down", inverse)):
            p = np.full(n, b, U64)
            p[0] = 1
            setattr(self, name, np.multiply.accumulate(p))

    def sums(self, symbols: np.ndarray) -> np.ndarray:
        self._grow(len(symbols) + 1)
        out = np.zeros(len(symbols) + 1, U64)
        np.cumsum(symbols * self.down[: len(symbols)], out=out[1:])
        return out

    def slices(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.up[start]

    def grams(self, sums: np.ndarray, k: int) -> np.ndarray:
        """Of every k consecutive symbols."""
        n = len(sums) - k
        return (sums[k:] - sums[:n]) * self.up[:n] if n > 0 else np.zeros(0, U64)


class Prime:
    """Polynomial hashes of slices modulo the prime 2**31 - 1 in two lanes: 62 bits.

    The lanes have their own bases and read their own halves of the symbols, which
    have to be well mixed. No regular sequence makes slices of this hash collide.
    """

    P = U64((1 << 31) - 1)

    def __init__(self, *bases: int) -> None:
        self.bases = bases
        self.up = self.down = np.ones((2, 1), U64)

    def _mod(self, x: np.ndarray) -> np.ndarray:
        x = (x & self.P) + (x >> U64(31))
        x = (x & self.P) + (x >> U64(31))
        return np.where(x >= self.P, x - self.P, x)

    def _powers(self, base: int, n: int) -> np.ndarray:
        out = np.ones(1, U64)
        while len(out) < n:
            out = np.concatenate((out, self._mod(out * U64(pow(base, len(out), int(self.P))))))
        return out

    def _grow(self, n: int) -> None:
        if self.up.shape[1] < n:
            n = max(n, 1 << 16)
            self.up = np.stack([self._powers(b, n) for b in self.bases])
            self.down = np.stack([self._powers(pow(b, -1, int(self.P)), n) for b in self.bases])

    def sums(self, symbols: np.ndarray) -> np.ndarray:
        self._grow(len(symbols) + 1)
        out = np.zeros((2, len(symbols) + 1), U64)
        for lane, x in enumerate((symbols & self.P, symbols >> U64(33))):
            y = x * self.down[lane, : len(symbols)]
            np.cumsum((y & self.P) + (y >> U64(31)), out=out[lane, 1:])
        return out

    def slices(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        one, two = (self._mod(self._mod(s[end] - s[start]) * up[start]) for s, up in zip(sums, self.up, strict=True))
        return one << U64(31) | two

    def grams(self, sums: np.ndarray, k: int) -> np.ndarray:
        """Of every k consecutive symbols."""
        at = np.arange(max(0, sums.shape[1] - k))
        return self.slices(sums, at, at + k)


_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=U64) | U64(1)
BY_BYTE, BY_WORD = Rolling(0x9E3779B97F4A7C15), Rolling(0xC2B2AE3D27D4EB4F)
SURE_BYTE, SURE_WORD = Prime(1_203_847_613, 1_759_220_927), Prime(1_487_326_921, 1_912_034_477)
#: Words end at a space or one of the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each text starts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices_of(offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` bytes together (or one longer text)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _word_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    plain = ~SPACE[data]
    start = plain.copy()
    start[1:] &= ~plain[:-1]
    start[starts] = plain[starts]
    end = plain
    after = plain.copy()
    end = after.copy()
    end[:-1] &= ~after[1:]
    end[ends] = after[ends]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


#: Bytes whose words are hashed at once; longer batches are cut at a space.
PIECE = 1 << 19


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, sure: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its first byte, its end, where each text's words start).

    ``sure``: hashes of ``Prime`` in place of those of ``Rolling``.
    """
    n, at, out = len(data), 0, []
    by = SURE_BYTE if sure else BY_BYTE
    while at < n:
        to = min(n, at + PIECE)
        while to < n and not SPACE[data[to]]:
            to += 1
        part = data[at:to]
        starts, ends = offsets - at, offsets - 1 - at
        s, e = _word_ends(part, starts[(starts >= 0) & (starts < to - at)], ends[(ends >= 0) & (ends < to - at)])
        sums = by.sums(BYTE_VALUES[LOWER[part] if lower else part])
        out.append((mix(by.slices(sums, s, e) + (e - s).astype(U64)), s + at, e + at))
        at = to
    if not out:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z, np.zeros(len(offsets), np.int64)
    h, s, e = (np.concatenate(x) for x in zip(*out, strict=True))
    return h, s, e, np.searchsorted(s, offsets)


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space each, and where each starts and ends in that."""
    size = ends - starts
    to = np.cumsum(size + 1) - 1
    out = np.full(int(to[-1]) + 1 if len(to) else 0, 32, np.uint8)
    plain = np.ones(len(out), bool)
    plain[to] = False
    out[plain] = data[~SPACE[data]]
    return out.tobytes(), to - size, to


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word of the bytes, equal only for equal words."""
    at = np.concatenate(([0], np.cumsum(ends - starts)))
    letters = np.ascontiguousarray(data[~SPACE[data]])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until it is none of the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges``: columns ``u``, ``v`` (long), any direction, repeats and loops allowed.
    Returns ``id``, ``component`` (the smallest id reachable) for ids that have an
    edge to another id. Each step aggregates minima before it shuffles and joins them
    back (skewed keys may be split); nothing is gathered per node or on the driver.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(e)
    for _ in range(limit):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        e = cut(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct())
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = e.groupBy("u").agg(F.min("v").alias("m"))
    return stars.select(F.col("u").alias("id"), F.col("m").alias("component")).unionByName(stars.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct())
