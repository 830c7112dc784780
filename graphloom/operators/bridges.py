"""Cross-language links: clients or uses joined with routes or providers.

Every matcher ends in ``emit``: one candidate takes the kind's tier, several make every
link a possible one, and no link is stronger than its kind allows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import paths as P
from graphloom.operators.dealing import UNIT, meet

# Strongest tier of each kind of link (0 proven, 1 inferred, 2 possible).
MAX_TIER = {"c_abi": 0, "c_cpp": 0, "jni": 0, "cgo": 0, "pyo3": 0, "cpython": 0, "python_stub": 0, "wasm_bindgen": 0, "napi": 0, "js_ts": 0, "http": 1, "openapi": 1, "grpc": 1, "graphql": 1, "user_contract": 1, "subprocess": 2, "ffi": 2, "message": 2}

# Uses that a unit of work holds of a key, and the least number of tasks that units are dealt to.
USES, LEAST_PARTS = 500, 64
# Classes of uses that are sent to every task.
FEW = 100_000

LINK = ["from_uid", "to_uid", "kind", "tier", "candidates"]


def clamp(kind: Column, tier: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in MAX_TIER.items() for x in kv))
    return F.greatest(tier, F.coalesce(table[kind], F.lit(2)))


def emit(links: DataFrame, kind: str, unique_tier: Column | int) -> DataFrame:
    """from_uid, to_uid, kind, tier, candidates of links (from_uid, to_uid, ...); self links go."""
    rows = links.where("from_uid <> to_uid").dropDuplicates(["from_uid", "to_uid"])
    return _rated(rows.withColumn("candidates", F.count("*").over(Window.partitionBy("from_uid"))), kind, unique_tier).select(*LINK)


def _rated(counted: DataFrame, kind: str, unique_tier: Column | int) -> DataFrame:
    tier = F.lit(unique_tier) if isinstance(unique_tier, int) else unique_tier
    rating = clamp(F.lit(kind), F.when(F.col("candidates") == 1, tier).otherwise(2))
    return counted.withColumns({"kind": F.lit(kind), "tier": rating})


def by_name(uses: DataFrame, provides: DataFrame, kind: str, tier: int, key: str = "name", other_file: bool = False, other_language: bool = False) -> DataFrame:
    """Links by an equal key: C symbols, JNI and cgo names, extension exports, topics, RPC methods.

    Links between a use and a provider of one row each can't repeat: they are counted from
    the sizes of the keys, rated before they are made, and each use meets bundles of providers,
    which are taken apart last. Others are made distinct, by joins that are planned only where
    some uid has two rows; one count of the uids, run at once, tells. Counts and units of work
    belong to classes, the uses alike in key and in what has to differ, so uses are joined with
    them once.
    """
    differ = (["path"] if other_file else []) + (["language"] if other_language else [])
    alike_a, alike_b = (["_key", *(mark + c for c in differ)] for mark in ("_a_", "_b_"))

    def columns(df: DataFrame, uid: str, mark: str) -> DataFrame:
        rows = df.select(F.col("uid").alias(uid), F.col(key).alias("_key"), *(F.col(c).alias(mark + c) for c in differ))
        # Unlike dropna() this tells Spark that there are no nulls, so it doesn't look for them in every link.
        return rows.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in rows.columns)))

    def side(df: DataFrame, uid: str) -> DataFrame:
        # Dealt by uid once, for the distinct rows, their count and the joins on it.
        return df.repartition(uid).distinct().withColumn("_one", F.count("*").over(Window.partitionBy(uid)) == 1)

    def apart(b: Callable[[str], Column]) -> Column:
        return reduce(lambda x, c: x & (F.col(f"_a_{c}") != b(f"_b_{c}")), differ, F.lit(True))

    a1, b1 = columns(uses, "from_uid", "_a_"), columns(provides, "to_uid", "_b_")
    once, n_classes = _counts(a1.select(F.col("from_uid").alias("uid"), F.xxhash64(*alike_a).alias("_class")), b1.select(F.col("to_uid").alias("uid"), F.lit(None).cast("long").alias("_class")))
    classes = a1.groupBy(*alike_a).agg(F.count("*").alias("_uses"))
    if not once:
        a, b = side(a1, "from_uid"), side(b1, "to_uid")
        a1 = a.where("_one").drop("_one")
        # A provider of several rows meets a use of one row once, unless its rows differ in more than the key.
        b1 = b.where("_one").drop("_one") if differ else b.drop("_one")
        several = a.where("not _one").drop("_one").join(b.drop("_one"), "_key")
        if differ:
            several = several.unionByName(a1.join(b.where("not _one").drop("_one"), "_key"))
        several = several.where(apart(F.col) & (F.col("from_uid") != F.col("to_uid"))).select("from_uid", "to_uid").distinct()
    # Providers of a class: those of the key, without those alike in what has to differ.
    sizes = b1.groupBy(*alike_b).agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("_key").orderBy(*alike_b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bundles = sizes.withColumns({"_first": F.floor(before / UNIT), "_bundles": F.ceil(F.col("_size") / UNIT)})
    units = classes.groupBy("_key").agg(F.ceil(F.sum("_uses") / USES).alias("_na"))
    units = units.join(bundles.groupBy("_key").agg(F.max(F.col("_first") + F.col("_bundles")).alias("_nb"), F.sum("_size").alias("_n")), "_key")
    n, classes = F.col("_n"), classes.drop("_uses").join(units, "_key") if differ else units
    for alike in (*([c] for c in differ), *([differ] if len(differ) == 2 else [])):
        name = "_n" + "".join(alike)
        found = sizes.groupBy("_key", *(F.col(f"_b_{c}").alias(f"_a_{c}") for c in alike)).agg(F.sum("_size").alias(name))
        classes = classes.join(found, ["_key", *(f"_a_{c}" for c in alike)], "left")
        size = F.coalesce(name, F.lit(0))
        n = n - size if len(alike) == 1 else n + size
    classes = classes.select(*alike_a, "_na", "_nb", n.alias("_n1"))
    # Few classes are sent to the uses, as Spark may take the uses for the smaller side.
    counted = a1.join(classes.hint("broadcast") if n_classes <= FEW else classes, alike_a)
    candidates, others = F.col("_n1"), F.col("to_uid")
    if not once:
        # The use itself among them.
        own = b1.groupBy(F.col("to_uid").alias("from_uid")).agg(F.collect_list(F.struct(*alike_b)).alias("_own"))
        itself = F.exists("_own", lambda x: (x["_key"] == F.col("_key")) & apart(lambda c: x[c]))
        counted = a1.join(own, "from_uid", "left").withColumn("_self", F.coalesce(itself, F.lit(False))).drop("_own")
        if differ:
            counted = counted.join(several.groupBy("from_uid").agg(F.count("*").alias("_n2")), "from_uid", "left")
            candidates = candidates + F.coalesce("_n2", F.lit(0))
        counted = counted.join(classes, alike_a).withColumn("_n1", F.col("_n1") - F.col("_self").cast("int"))
        others = F.when(F.col("_self"), F.array_remove("to_uid", F.col("from_uid"))).otherwise(others)
    total = counted.withColumn("candidates", candidates).where("_n1 > 0")
    left = _rated(total, kind, tier).select("from_uid", *alike_a, "kind", "tier", "candidates", *([] if once else ["_self"]), F.pmod(F.xxhash64("from_uid"), "_na").alias("_ua"), F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_ub"))
    right = b1.join(bundles.join(units, "_key"), alike_b).withColumn("_ub", F.col("_first") + F.pmod(F.xxhash64("to_uid"), F.col("_bundles")))
    right = right.groupBy(*alike_b, "_ub", "_na").agg(F.collect_list("to_uid").alias("to_uid")).withColumn("_ua", F.explode(F.sequence(F.lit(0), F.col("_na") - 1))).drop("_na")
    met = meet(left, right, ["_key", "_ua", "_ub"], LEAST_PARTS).where(apart(F.col))
    plain = met.withColumn("to_uid", F.explode(others)).select(*LINK)
    if once:
        return plain
    pairs = several.withColumn("candidates", F.count("*").over(Window.partitionBy("from_uid")))
    if differ:
        ones = counted.where("_n2 is not null").select("from_uid", "_n1")
        pairs = pairs.join(ones, "from_uid", "left").withColumn("candidates", F.col("candidates") + F.coalesce("_n1", F.lit(0)))
    return plain.unionByName(_rated(pairs, kind, tier).select(*LINK))


def _counts(a: DataFrame, b: DataFrame) -> tuple[bool, int]:
    """Whether every uid has one row in both frames together (told by hashes: two uids of one
    hash make it False), and about how many classes there are."""
    rows = a.union(b).withColumn("uid", F.xxhash64("uid")).repartition("uid")
    rows = rows.groupBy("uid").agg(F.count("*").alias("n"), F.max("_class").alias("_class"))
    most, classes = rows.agg(F.max("n"), F.approx_count_distinct("_class")).first()
    return (most or 0) <= 1, classes


def http(clients: DataFrame, routes: DataFrame) -> DataFrame:
    """Clients (uid, method, path) on routes (uid, method, path): by equal segment counts,
    a parameter matching any segment; of the routes that match, the ones with the fewest
    parameter positions are the candidates."""
    a = clients.select(F.col("uid").alias("from_uid"), F.col("method").alias("m_a"), P.segments(F.col("path")).alias("a"), F.col("dynamic") if "dynamic" in clients.columns else F.lit(False).alias("dynamic"))
    b = routes.select(F.col("uid").alias("to_uid"), F.col("method").alias("m_b"), P.segments(F.col("path")).alias("b"))
    # Where the parameters of both sides stand fixes which segments must be equal, so each
    # pair of such masks is a join on those segments.
    mask = lambda c: F.transform(c, lambda s: s == P.PLACEHOLDER)
    a = a.where("a is not null").withColumn("mask_a", mask(F.col("a")))
    b = b.where("b is not null").withColumn("mask_b", mask(F.col("b")))
    masks = a.select("mask_a").distinct().join(b.select("mask_b").distinct(), F.size("mask_a") == F.size("mask_b"))
    masks = masks.withColumns({"free": F.zip_with("mask_a", "mask_b", lambda x, y: x | y), "wild": F.size(F.filter(F.zip_with("mask_a", "mask_b", lambda x, y: x != y), lambda x: x))})
    bound = lambda c: F.zip_with(c, "free", lambda s, f: F.when(~f, s).otherwise(P.PLACEHOLDER))
    a = a.join(masks, "mask_a").select("from_uid", "m_a", "dynamic", "mask_a", "mask_b", "wild", bound("a").alias("bound"))
    b = b.join(masks, "mask_b").select("to_uid", "m_b", "mask_a", "mask_b", bound("b").alias("bound"))
    near = a.join(b, ["mask_a", "mask_b", "bound"]).where(P.method_ok(F.col("m_a"), F.col("m_b")))
    best = near.withColumn("least", F.min("wild").over(Window.partitionBy("from_uid"))).where("wild = least")
    return emit(best, "http", F.when(F.col("dynamic"), 2).otherwise(1))


def strongest(bridges: DataFrame) -> DataFrame:
    """Of identical crossings the strongest tier."""
    return bridges.groupBy("from_uid", "to_uid", "kind").agg(F.min("tier").alias("tier"))
