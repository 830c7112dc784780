"""Snapshots of tables in a folder: full writes, appended deltas, compaction.

A write goes to a new numbered folder and counts once its ``_SUCCESS`` file is there, so
readers never see half of one. A delta holds changed rows and, as tombstones, removed
keys; loading folds deltas over the newest base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# When deltas are folded into a new base.
MAX_DELTAS, DELTA_SHARE = 64, 4


def _folders(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, name) of the finished snapshots under ``root``, by the session's file systems."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    done = [n for n in names if n.split("-")[0] in ("base", "delta") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return sorted((int(n.split("-")[1]), n) for n in done)


def save(table: DataFrame, root: str) -> str:
    """Write a full snapshot; returns its folder."""
    number = max((n for n, _ in _folders(table.sparkSession, root)), default=-1) + 1
    table.write.parquet(f"{root}/base-{number:09d}")
    return f"{root}/base-{number:09d}"


def append(changed: DataFrame, removed: DataFrame, root: str, key: str) -> str:
    """Write a delta: rows of ``changed`` and the keys of ``removed``."""
    number = max(n for n, _ in _folders(changed.sparkSession, root)) + 1
    gone = removed.select(key).withColumn("_removed", F.lit(True))
    changed.withColumn("_removed", F.lit(False)).unionByName(gone, allowMissingColumns=True).write.parquet(f"{root}/delta-{number:09d}")
    return f"{root}/delta-{number:09d}"


def load(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The newest base with all later deltas: of each key the newest row, unless removed."""
    folders = _folders(spark, root)
    at = max(i for i, (_, name) in enumerate(folders) if name.startswith("base"))
    out = spark.read.parquet(f"{root}/{folders[at][1]}").withColumns({"_removed": F.lit(False), "_number": F.lit(folders[at][0])})
    for number, name in folders[at + 1 :]:
        out = out.unionByName(spark.read.parquet(f"{root}/{name}").withColumn("_number", F.lit(number)))
    newest = Window.partitionBy(key).orderBy(F.desc("_number"))
    return out.withColumn("_n", F.row_number().over(newest)).where("_n = 1 and not _removed").drop("_n", "_number", "_removed")


def wants_compaction(spark: SparkSession, root: str) -> bool:
    """Whether there are many deltas since the base, or they hold much beside it."""
    folders = _folders(spark, root)
    at = max(i for i, (_, name) in enumerate(folders) if name.startswith("base"))
    deltas = folders[at + 1 :]
    rows = sum(spark.read.parquet(f"{root}/{name}").count() for _, name in deltas)
    return len(deltas) > MAX_DELTAS or rows * DELTA_SHARE > spark.read.parquet(f"{root}/{folders[at][1]}").count()


def compact(spark: SparkSession, root: str, key: str) -> str:
    return save(load(spark, root, key), root)
