"""Inventory of a source tree: files that are read, and those refused with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import paths as P
from graphloom.functions import text as T
from graphloom.operators.relations import is_config_name, is_excluded_dir, is_sensitive_name

# Limits of one inventory.
MAX_FILES, MAX_FILE_BYTES, MAX_TOTAL_BYTES = 50_000, 2_000_000, 400_000_000


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (below ``root``), size, mtime, content of all files under ``root`` that are not empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    clean = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace(F.col("path"), f"^[a-z]+:/*{clean}/", "")
    return files.select(path.alias("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"), "content")


def refusal(exclude: tuple[str, ...] = ()) -> Column:
    """Why a file is not read: excluded, sensitive, colon, oversize or not_utf8; null if it is."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    folders = F.filter(F.split(P.parent(F.col("path")), "/"), lambda d: d != "")
    excluded = F.exists(folders, is_excluded_dir)
    for glob in exclude:
        excluded = excluded | T.glob_matches_within(glob, F.col("path")).isNotNull()
    return (
        F.when(excluded, "excluded")
        .when(is_sensitive_name(name), "sensitive")
        .when(F.col("path").contains(":"), "colon")
        .when(F.col("size") > MAX_FILE_BYTES, "oversize")
        .when(~F.is_valid_utf8(F.col("content").cast("string")), "not_utf8")
    )


def scan(files: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, language, is_config, reason, hash, text of each file of ``read_tree``; refused
    ones have a reason and no text, and files that are neither source nor configuration go."""
    rows = files.withColumn("reason", refusal(exclude))
    first = F.regexp_extract(F.col("content").cast("string"), r"^([^\n]*)", 1)
    named = F.regexp_extract("path", "([^/]*)$", 1)
    language = F.when(named.contains("."), P.language_of_path(F.col("path"))).otherwise(P.language_of_shebang(first))
    rows = rows.withColumns({"language": F.when(F.col("reason").isNull(), language), "is_config": is_config_name(named)})
    rows = rows.where("reason is not null or language is not null or is_config")
    read = F.col("reason").isNull()
    return rows.select("path", "language", "is_config", "reason", F.when(read, F.sha2("content", 256)).alias("hash"), F.when(read, F.col("content").cast("string")).alias("text"))


def safe_path(path: str) -> str:
    """``path`` if it stays below the root and names nothing hidden; ValueError otherwise."""
    parts = path.replace("\\", "/").split("/")
    if not path or path.startswith("/") or ":" in path or any(p in ("", ".", "..") or p.startswith(".") for p in parts):
        raise ValueError(f"unsafe path: {path!r}")
    return "/".join(parts)


def read_verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose content has the expected hash; a difference fails the read."""
    both = files.join(expected.select("path", F.col("hash").alias("_hash")), "path")
    same = F.when(F.sha2("content", 256) == F.col("_hash"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("changed: "), "path")).cast("binary"))
    return both.select("path", same.alias("content"))
