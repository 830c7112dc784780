"""Incremental updates: what changed between two snapshots, and what depends on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, state (added, removed, changed, unchanged) from two tables of path, hash."""
    a, b = old.select("path", F.col("hash").alias("before")), new.select("path", F.col("hash").alias("after"))
    state = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def reuse_hashes(files: DataFrame, previous: DataFrame) -> DataFrame:
    """path, hash: the previous hash where size and mtime are the same, else a new one."""
    known = previous.select("path", "size", "mtime", F.col("hash").alias("known"))
    return files.join(known, ["path", "size", "mtime"], "left").select("path", F.coalesce("known", F.sha2("content", 256)).alias("hash"), F.col("known").isNotNull().alias("reused"))


def inventory_fingerprint(files: DataFrame) -> DataFrame:
    """One hash over all (path, hash) in order of path: hashes of each are hashed in
    blocks by path prefix first, so no task gathers all paths."""
    lines = files.select(F.concat("path", F.lit("\0"), "hash").alias("line"))
    blocks = lines.groupBy(F.left(F.sha2("line", 256), F.lit(3)).alias("block")).agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("line"))), 256).alias("h"))
    return blocks.agg(F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: x["h"])), 256).alias("fingerprint"))


def changed_names(old: DataFrame, new: DataFrame, dirty: DataFrame) -> DataFrame:
    """Names declared in dirty files before or after, not both: symmetric difference."""
    a = old.join(dirty, "path", "left_semi").select("path", "name").distinct()
    b = new.join(dirty, "path", "left_semi").select("path", "name").distinct()
    only = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), ["path", "name"], "full_outer").where("a is null or b is null")
    return only.select("name").distinct()


def interface_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths in both snapshots whose interface hash differs."""
    return old.select("path", F.col("interface").alias("a")).join(new.select("path", F.col("interface").alias("b")), "path").where("a <> b").select("path")


def requery(dependencies: DataFrame, mentions: DataFrame, changed: DataFrame, names: DataFrame) -> DataFrame:
    """Files to ask again: those that depend on a changed file or mention a changed name."""
    by_file = dependencies.join(changed.select(F.col("path").alias("target")), "target", "left_semi").select("path")
    by_name = mentions.join(names, "name", "left_semi").select("path")
    return by_file.unionByName(by_name).distinct()


def fold_changes(log: DataFrame) -> DataFrame:
    """path, change: a log of (path, seq, op) with op add, change or remove as one delta;
    an addition that was removed again leaves nothing."""
    ends = log.groupBy("path").agg(F.min_by("op", "seq").alias("first"), F.max_by("op", "seq").alias("last"))
    change = F.when((F.col("first") == "add") & (F.col("last") == "remove"), F.lit(None)).when(F.col("first") == "add", "add").when(F.col("last") == "remove", "remove").otherwise("change")
    return ends.select("path", change.alias("change")).where("change is not null")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one bag holds more often than the other, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def debounced(events: DataFrame, gap: str = "5 minutes", key: str = "key") -> DataFrame:
    """Change batches: events of a key (key, ts, path) that follow each other within the
    gap, as one set of paths."""
    return events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"), F.count_distinct("path").alias("n_paths"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("w")


def generations(events: DataFrame) -> DataFrame:
    """Latest generation of each path; a generation is the place of an event in the queue."""
    order = Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("path", F.col("event_id").alias("generation"), "kind")


def committed(queue: DataFrame, started: int) -> DataFrame:
    """What stays queued when an update that began at generation ``started`` is done."""
    return queue.where(F.col("generation") > started)


def violations(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Broken invariants of an index and how many rows break each."""
    uids = symbols.select("uid")
    checks = [
        ("duplicate_uid", symbols.groupBy("uid").count().where("count > 1")),
        ("dangling_from", edges.join(uids, edges["from_uid"] == uids["uid"], "left_anti")),
        ("dangling_to", edges.join(uids, edges["to_uid"] == uids["uid"], "left_anti")),
        ("bad_tier", edges.where("tier not in (0, 1, 2)")),
    ]
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks]
    first = out[0]
    for more in out[1:]:
        first = first.unionByName(more)
    return first
