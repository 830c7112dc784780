"""MinHash near-dedup with SetSketch registers.

A document's set is its distinct five-word shingles. Register i keeps the minimum
over the set of an exponential variable, rounded to the exponent of a base b just
above 1 (truncated to 16 bits): sketches of unions are register-wise maxima, and equal
registers are about as likely as sets are similar.

1. One pass over the texts gives each document its set size, a 128-bit BLAKE2b digest
   of its words in order and the hashes of its bands of registers.
2. Documents with the same words in the same order form a class, known by its smallest
   doc_id; only that one goes on, so copies are never paired.
3. Documents that share a band value join one coarse group (components of a star from
   the smallest id in each band value; no pairs).
4. A coarse group is a unit of work. A group larger than ``BLOCK`` is dealt into blocks
   and every two blocks form a unit, so that no task holds an unbounded group. In a
   unit registers are compared jointly: the likelihood of (larger, smaller, equal)
   register counts, given both set sizes, must not lie below a margin under the
   threshold. What is left is confirmed on the full sets, of words and not of hashes,
   unless both sides are already connected. A unit returns links of a spanning forest,
   not pairs.
5. Components of the confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import shared as S

U64 = S.U64
#: Registers in a band, bands: at similarity 0.8 a pair is missed with probability
#: (1 - 0.8**6)**44 = 2e-6, at 0.85 with 2e-9.
ROWS, BANDS = 6, 44
#: Register base and rate, and the largest register value.
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Registers compared for the estimate, and how far under the threshold it may lie
#: (five standard deviations).
ESTIMATE = 128
MARGIN = 5.0
#: Documents in a unit's block.
BLOCK = 2048
SHINGLE = 5

_rng = np.random.default_rng(77)
SEEDS = _rng.integers(1, 1 << 32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_BAND_SEEDS = _rng.integers(1, 1 << 63, BANDS, dtype=U64)


def _places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and words of all shingles, repeats included, and where each text's start."""
    n = np.diff(at)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(n.dtype))
    starts = np.concatenate(([0], np.cumsum(count)))
    return np.repeat(at[:-1] - starts[:-1], count) + np.arange(starts[-1]), np.repeat(np.minimum(n, SHINGLE), count), starts


def shingle_hashes(word: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of shingles from hashes of all words."""
    return S.mix(S.SURE_WORD.slices(S.SURE_WORD.sums(word), first, first + size) + size.astype(U64))


def shingle_numbers(word: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers of shingles, equal only for equal ones, from such numbers of all words."""
    top = int(word.max(initial=0)) + 2
    word = np.append(word, np.zeros(SHINGLE, np.int64))
    out = word[first]
    for k in range(1, SHINGLE):
        _, out = np.unique(out * top + np.where(k < size, word[first + k] + 1, 0), return_inverse=True)
    return out.astype(np.int32)


def registers(hashes: np.ndarray, starts: np.ndarray, how_many: int) -> np.ndarray:
    """Registers of sets that are not empty, as rows of a uint16 matrix."""
    x = (hashes >> U64(32)).astype(np.uint32)
    low = np.empty((how_many, len(starts) - 1), np.uint32)
    for i in range(how_many):
        low[i] = np.minimum.reduceat(x * SEEDS[i], starts[:-1])
    h = -np.log1p(-(low.T.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)) + TOP // 3, 0, TOP).astype(np.uint16)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in _runs(batch):
            part = batch.slice(i, j - i)
            data, offsets = S.text_bytes(part.column("text"))
            data = S.LOWER[data]
            word, s, e, at = S.words(data, offsets, sure=True)
            raw, to, end = S.spaced(data, s, e)
            one, two = S.digests(raw[to[a] : end[b - 1]] if b > a else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            first, length, starts = _places(at)
            hashes = shingle_hashes(word, first, length)
            size = np.array([len(np.unique(hashes[a:b])) for a, b in zip(starts[:-1], starts[1:], strict=True)], np.int64)
            full = np.flatnonzero(size)
            bands = np.zeros((j - i, BANDS), U64)
            if len(full):
                r = registers(hashes, np.append(starts[full], starts[-1]), ROWS * BANDS).astype(U64).reshape(len(full), BANDS, ROWS)
                key = np.broadcast_to(_BAND_SEEDS, (len(full), BANDS)).copy()
                for k in range(ROWS):
                    key = S.mix(key + r[:, :, k])
                bands[full] = key
            out = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(one), pa.array(two), out], names=["doc_id", "n_shingles", "text_a", "text_b", "bands"])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    _, offsets = S.text_bytes(batch.column("text"))
    return S.slices_of(offsets)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, text_a, text_b, bands of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_sketches, "doc_id long, n_shingles long, text_a long, text_b long, bands array<long>")


def not_below(larger: np.ndarray, smaller: np.ndarray, n_u: float, n_v: np.ndarray, cut: float) -> np.ndarray:
    """Whether the maximum likelihood estimate of the similarity is at least ``cut``.

    With u, v the sizes' shares, registers of the first set are larger with probability
    p(u - v J), smaller with p(v - u J), p(x) = -log_b(1 - x (b - 1) / b); the
    likelihood is concave in J, so its slope at ``cut`` tells.
    """
    u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)
    top = np.minimum(u / v, v / u)
    j = np.minimum(cut, top)
    c, ln = (BASE - 1) / BASE, np.log(BASE)

    def p(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-c * np.maximum(x, 0)) / ln, 1e-12)

    def slope(x: np.ndarray) -> np.ndarray:
        return c / (1 - c * np.maximum(x, 0)) / ln

    x, y = u - v * j, v - u * j
    equal = ESTIMATE - larger - smaller
    at = -larger * v * slope(x) / p(x) - smaller * u * slope(y) / p(y) + equal * (v * slope(x) + u * slope(y)) / np.maximum(1 - p(x) - p(y), 1e-12)
    return (at >= 0) & (top >= cut)


def forest(sets: list[np.ndarray], regs: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (index pairs) of a spanning forest of the pairs left x right whose sets (of
    small numbers) meet the threshold: 100 * intersection >= percent * union."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    local = np.concatenate(sets) if n else np.zeros(0, np.int32)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    member = np.zeros(int(local.max(initial=-1)) + 1, bool)
    label = np.arange(n)
    t = percent / 100
    cut = max(0.0, t - MARGIN * np.sqrt(t * (1 - t) / ESTIMATE))
    links: list[tuple[int, int]] = []
    same = left is right
    for at, i in enumerate(left):
        js = right[at + 1 :] if same else right
        js = js[(label[js] != label[i]) & (100 * np.minimum(sizes[js], sizes[i]) >= percent * np.maximum(sizes[js], sizes[i]))]
        if not len(js):
            continue
        more, less = (regs[js] < regs[i]).sum(1), (regs[js] > regs[i]).sum(1)
        js = js[not_below(more, less, float(sizes[i]), sizes[js].astype(float), cut)]
        own = local[starts[i] : starts[i + 1]]
        member[own] = True
        for part in range(0, len(js), 256):
            some = js[part : part + 256]
            some = some[label[some] != label[i]]
            if not len(some):
                continue
            flat = np.concatenate([local[starts[j] : starts[j + 1]] for j in some])
            meet = np.add.reduceat(member[flat].astype(np.int64), np.concatenate(([0], np.cumsum(sizes[some])[:-1])))
            for j in some[100 * meet >= percent * (sizes[some] + sizes[i] - meet)]:
                if label[j] != label[i]:
                    links.append((int(i), int(j)))
                    label[label == label[j]] = label[i]
        member[own] = False
    return links


def _scanned(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Registers of each text, where words start and end, and where each text's words start."""
    out = []
    for i, j in S.slices_of(offsets):
        word, s, e, at = S.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], sure=True)
        first, size, starts = _places(at)
        full = np.flatnonzero(np.diff(starts))
        regs = np.zeros((j - i, ESTIMATE), np.uint16)
        if len(full):
            regs[full] = registers(shingle_hashes(word, first, size), np.append(starts[full], starts[-1]), ESTIMATE)
        out.append((regs, s + offsets[i], e + offsets[i], np.diff(at)))
    regs, s, e, count = (np.concatenate(x) for x in zip(*out, strict=True))
    return regs, s, e, np.concatenate(([0], np.cumsum(count)))


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in S.whole_groups(batches, "unit", 2 << 20):
            data, offsets = S.text_bytes(table.column("text"))
            data = S.LOWER[data]
            regs, s, e, at = _scanned(data, offsets)
            ids, side = table.column("doc_id").to_numpy(), table.column("side").to_numpy()
            bounds = S.group_bounds(table.column("unit").to_numpy())
            u: list[int] = []
            v: list[int] = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                x, y = at[a], at[b]
                first, size, starts = _places(at[a : b + 1] - x)
                exact = shingle_numbers(S.word_numbers(data[offsets[a] : offsets[b]], s[x:y], e[x:y]), first, size)
                own = a + np.flatnonzero(np.diff(starts))  # a row that repeats the id of another may be empty
                sets = [np.unique(exact[starts[d - a] : starts[d - a + 1]]) for d in own]
                left, right = (np.flatnonzero(side[own] == k) for k in (0, 1))
                pairs = forest(sets, regs[own], left, right if len(right) else left, percent)
                u += [int(ids[own[i]]) for i, _ in pairs]
                v += [int(ids[own[j]]) for _, j in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents link where 100 * |A and B| >= percent * |A or B| for their sets of
    five-word shingles (A-Z lower-cased, words split at space and bytes 9 to 13); fewer
    words count as one shingle, and a text without words or a null text is empty and
    linked with nothing. ``component_id`` is the smallest doc_id reachable by links,
    ``kept`` marks it. Other columns are ignored. Rows with equal doc_id are each
    returned; a null doc_id is linked with nothing, has no component and is kept.
    """
    made = S.cut(sketches(docs))
    full = made.where("n_shingles > 0 and doc_id is not null")
    sets = full.groupBy("text_a", "text_b").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = S.cut(sets)
    keyed = classes.select(F.col("rep").alias("doc_id"), F.explode("bands").alias("band"))
    stars = keyed.groupBy("band").agg(F.min("doc_id").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
    coarse = S.components(keyed.join(stars, "band").select("u", F.col("doc_id").alias("v")))
    coarse = S.cut(coarse.select(F.col("id").alias("doc_id"), F.col("component").alias("grp")))
    sizes = coarse.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = coarse.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    pair = F.expr("transform(sequence(0, blocks - 1), b -> struct(least(b, block) as i, greatest(b, block) as j, if(b >= block, 0, 1) as side))")
    units = dealt.select("doc_id", "grp", F.explode(pair).alias("x")).select("doc_id", F.col("x.side").alias("side"), F.xxhash64("grp", "x.i", "x.j").alias("unit"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    work = texts.join(units.hint("merge"), "doc_id").repartition("unit").sortWithinPartitions("unit")
    links = work.select("unit", "doc_id", "side", "text").mapInArrow(_verify(percent), "u long, v long")
    found = S.components(links)
    by_class = classes.select("text_a", "text_b", "rep").join(found, F.col("rep") == F.col("id"), "left").select("text_a", "text_b", F.coalesce("component", "rep").alias("component"))
    rest = made.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = full.select("doc_id", "n_shingles", "text_a", "text_b").join(by_class, ["text_a", "text_b"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
