"""Embedding near-dedup by NN-descent.

1. Equal vectors of a label form a class, known by its smallest id; only that goes on.
2. First neighbours: vectors are sorted by the signs of random projections, in several
   orders, and each takes the best of those next to it.
3. NN-descent: around each vector its neighbours and a sample of those it is a
   neighbour of meet (neighbours of neighbours), and each takes over those that beat
   its worst one. A list holds the ``K`` best; a list whose best ones are all links is
   saturated and enlarged, up to ``LONGEST``.
4. Recall is audited: links of a bounded query sample against all rows, by brute force
   in blocks, have to lie in the components found; below ``RECALL`` the graph is
   refined further with longer lists. If the audit still fails, all vectors of a label
   count as one coarse component, so that every pair is compared.
5. Edges at the threshold are kept. Each coarse component (dealt into blocks where it is
   large, so no task holds an unbounded group) is compared exactly in double precision:
   this confirms links, drops none of them to a list's length, and counts them.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import shared as S

_log = logging.getLogger(__name__)
#: Neighbours of a vector, of a saturated one, and sampled vectors it is a neighbour of.
K, LONGEST, REVERSE = 8, 24, 8
#: Sort orders for the first neighbours, sign bits of each, and how far a vector looks.
ORDERS, BITS, REACH = 8, 24, 6
ROUNDS, MORE_ROUNDS = 2, 3
#: Queries of the audit at most, and the recall it asks for.
QUERIES, RECALL = 256, 0.98
#: Vectors in a block of the exact comparison.
BLOCK = 1024
#: How far single precision may stray from the cosine.
SLACK = 1e-4


def _matrix(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.float64) for x in column.to_pylist()]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("embedding")
        flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        at = at - at[0]
        vec = [_unit(flat[a:b][None, :])[0].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("space"), batch.column("n"), pa.array(vec, pa.binary())], names=["id", "space", "n", "vec"])


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            rows = _matrix(part.column("vec"))
            codes = np.zeros((len(rows), ORDERS), np.int64)
            dims = np.array([len(r) for r in rows])
            for d in np.unique(dims):
                if d not in planes:
                    planes[d] = np.random.default_rng(int(d)).standard_normal((d, ORDERS * BITS))
                own = np.flatnonzero(dims == d)
                signs = (np.stack([rows[k] for k in own]) @ planes[d] > 0).reshape(len(own), ORDERS, BITS)
                codes[own] = signs @ (1 << np.arange(BITS))
            short = [r.astype(np.float32).tobytes() for r in rows]
            for t in range(ORDERS):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), part.column("space"), pa.array(codes[:, t]), part.column("id"), pa.array(short, pa.binary())], names=["t", "space", "code", "id", "vec"])


def _edges(u, v, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim, pa.float32())], names=["u", "v", "sim"])


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best of the vectors that stand next to each in sorted rows."""
    wait: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]).combine_chunks()
        table = pa.concat_tables([wait, table]).combine_chunks() if wait is not None else table
        n = table.num_rows
        ids, t, space = (table.column(c).to_numpy() for c in ("id", "t", "space"))
        bounds = S.group_bounds(S.mix(space.astype(np.int64).view(S.U64) + t.astype(S.U64)))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            x = np.stack([np.frombuffer(v, np.float32) for v in table.column("vec").slice(a, b - a).to_pylist()])
            sims = np.full((2 * REACH, b - a), -2, np.float32)
            for k in range(1, min(REACH, b - a - 1) + 1):
                s = np.einsum("ij,ij->i", x[:-k], x[k:])
                sims[k - 1, :-k] = s
                sims[REACH + k - 1, k:] = s
            step = np.concatenate((np.arange(1, REACH + 1), -np.arange(1, REACH + 1)))
            best = np.argpartition(-sims, 2, axis=0)[:3]
            for row in best:
                i = np.flatnonzero(sims[row, np.arange(b - a)] > -2)
                yield _edges(ids[a + i], ids[a + i + step[row[i]]], sims[row[i], i])
        wait = table.slice(max(0, n - REACH))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All around one vector meet: per one of them the three best that beat its worst neighbour."""
    for table in S.whole_groups(batches, "u", 4 << 20):
        bounds = S.group_bounds(table.column("u").to_numpy())
        ids, worst = table.column("id").to_numpy(), table.column("worst").to_numpy()
        vec = [np.frombuffer(v, np.float32) for v in table.column("vec").to_pylist()]
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            x = np.stack(vec[a:b])
            sims = x @ x.T
            np.fill_diagonal(sims, -2)
            k = min(3, b - a - 1)
            best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            s = np.take_along_axis(sims, best, 1)
            i, j = np.nonzero(s > worst[a:b, None])
            out.append((ids[a + i], ids[a + best[i, j]], s[i, j]))
        if out:
            yield _edges(*(np.concatenate(c) for c in zip(*out, strict=True)))


def _best(edges: DataFrame, k: int, threshold: float) -> DataFrame:
    """The k best of each vector; saturated lists longer."""
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    rows = edges.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 3 * k)
    return S.cut(rows.where((F.col("rank") <= k) | (F.col("sim") >= threshold)).drop("rank"))


def _refine(graph: DataFrame, nodes: DataFrame, k: int, threshold: float, turn: int) -> DataFrame:
    sampled = Window.partitionBy("v").orderBy(F.xxhash64("u", "v", F.lit(turn)))
    back = graph.select("u", "v").withColumn("rank", F.row_number().over(sampled)).where(F.col("rank") <= REVERSE).select(F.col("v").alias("u"), F.col("u").alias("id"))
    around = graph.select("u", F.col("v").alias("id")).unionByName(back).distinct().unionByName(nodes.select(F.col("id").alias("u"), "id"))
    worst = graph.groupBy("u").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0).cast("float")).alias("worst"))
    known = nodes.join(worst, nodes["id"] == worst["u"], "left").select("id", "short", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))
    groups = around.join(known, "id").select("u", "id", F.col("short").alias("vec"), "worst").repartition("u").sortWithinPartitions("u")
    return _best(graph.unionByName(groups.mapInArrow(_meet, "u long, v long, sim float")), k, threshold)


def _exact(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in S.whole_groups(batches, "unit", 4 << 20):
            bounds = S.group_bounds(table.column("unit").to_numpy())
            u: list = []
            v: list = []
            links: list = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part = table.slice(a, b - a)
                ids, n, side = (part.column(c).to_numpy() for c in ("id", "n", "side"))
                x = np.stack(_matrix(part.column("vec")))
                left = np.flatnonzero(side == 0)
                right = np.flatnonzero(side == 1)
                alone = not len(right)
                right = left if alone else right
                hit = x[left] @ x[right].T >= threshold
                if alone:
                    np.fill_diagonal(hit, False)
                label = np.arange(len(ids))
                for i, at in enumerate(left):
                    for j in right[hit[i] & (label[right] != label[at])]:
                        if label[j] != label[at]:
                            u.append(int(ids[at]))
                            v.append(int(ids[j]))
                            links.append(0)
                            label[label == label[j]] = label[at]
                count = np.zeros(len(ids), np.int64)
                count[left] = hit @ n[right]
                if not alone:
                    count[right] = n[left] @ hit
                u += ids.tolist()
                v += ids.tolist()
                links += count.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(links, pa.int64())], names=["u", "v", "links"])

    return run


def _audit(reps: DataFrame, coarse: DataFrame, threshold: float) -> float:
    """Share of the links of a query sample that lie inside the coarse components."""
    queries = reps.orderBy(F.xxhash64("id")).limit(QUERIES).select("id", "space", "vec").toPandas()
    if not len(queries):
        return 1.0
    by_space = {s: (g["id"].to_numpy(), np.stack([np.frombuffer(x, np.float64) for x in g["vec"]])) for s, g in queries.groupby("space")}
    sent = reps.sparkSession.sparkContext.broadcast(by_space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, space = batch.column("id").to_numpy(), batch.column("space").to_numpy()
            vec = batch.column("vec").to_pylist()
            for s in np.unique(space).tolist():
                if s not in sent.value:
                    continue
                q, x = sent.value[s]
                own = np.flatnonzero(space == s)
                for k in range(0, len(own), 1000):
                    some = own[k : k + 1000]
                    i, j = np.nonzero(x @ np.stack([np.frombuffer(vec[r], np.float64) for r in some]).T >= threshold)
                    other = q[i] != ids[some[j]]
                    yield pa.RecordBatch.from_arrays([pa.array(q[i][other]), pa.array(ids[some[j]][other])], names=["q", "x"])

    true = reps.select("id", "space", "vec").mapInArrow(run, "q long, x long")
    home = coarse.select(F.col("id").alias("q"), F.col("component").alias("cq"))
    found = true.join(home, "q", "left").join(coarse.select(F.col("id").alias("x"), F.col("component").alias("cx")), "x", "left")
    n, hit = found.agg(F.count("*"), F.count_if(F.col("cq") == F.col("cx"))).first()
    return hit / n if n else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, they have as many components,
    and their cosine in double precision is at least ``threshold``. ``n_links`` counts
    the other vectors linked directly, ``component_id`` is the smallest vec_id
    reachable, ``kept`` marks it. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing. Other columns are ignored. Rows that
    repeat a vec_id are vectors of their own in the counts; a row without vec_id has no
    component and is kept.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.expr("vec_id is not null and label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    key = ["label", "embedding"]
    classes = rows.where("fine").groupBy(*key).agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    packed = classes.select("id", F.xxhash64("label", F.size("embedding")).alias("space"), "n", "embedding")
    reps = S.cut(packed.mapInArrow(_pack, "id long, space long, n long, vec binary"))
    order = reps.mapInArrow(_orders, "t int, space long, code long, id long, vec binary")
    order = order.repartitionByRange("t", "space", "code", "id").sortWithinPartitions("t", "space", "code", "id")
    graph = _best(order.mapInArrow(_beside, "u long, v long, sim float"), K, threshold)
    short = reps.mapInArrow(_shorten, "id long, short binary")
    turn, k = 0, K
    for rounds in (ROUNDS, 1, 1, 1)[: 1 + MORE_ROUNDS]:
        for _ in range(rounds):
            graph = _refine(graph, short, k, threshold, turn)
            turn += 1
        coarse = S.cut(S.components(graph.where(F.col("sim") >= threshold - SLACK).select("u", "v")))
        recall = _audit(reps, coarse, threshold)
        _log.info("turn %d: audited recall %.4f", turn, recall)
        if recall >= RECALL:
            break
        k = min(2 * k, LONGEST)
    else:
        coarse = reps.select("id", F.col("space").alias("component"))
    sizes = coarse.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = coarse.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pair = F.expr("transform(sequence(0, blocks - 1), b -> struct(least(b, block) as i, greatest(b, block) as j, if(b >= block, 0, 1) as side))")
    units = dealt.select("id", "component", F.explode(pair).alias("x")).select("id", F.col("x.side").alias("side"), F.xxhash64("component", "x.i", "x.j").alias("unit"))
    work = reps.join(units, "id").repartition("unit").sortWithinPartitions("unit").select("unit", "id", "side", "n", "vec")
    checked = S.cut(work.mapInArrow(_exact(threshold), "u long, v long, links long"))
    found = S.components(checked.where("u <> v").select("u", "v"))
    counts = checked.where("u = v").groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("links"))
    by_class = classes.join(counts, "id", "left").join(found, "id", "left")
    by_class = by_class.select(*key, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    good = rows.where("fine").select("vec_id", *key).join(by_class, key).select("vec_id", "n_links", "component_id")
    rest = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.astype(np.float32).tobytes() for x in _matrix(batch.column("vec"))], pa.binary())], names=["id", "short"])
