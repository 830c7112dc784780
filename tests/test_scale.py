"""Queries on small tables that are odd in the way larger ones are: against their oracles."""

from __future__ import annotations

import glob
import os
import random
import re
from collections import Counter

import duckdb
import pytest

from graphloom.operators import bridges as B
from graphloom.operators import families as M
from graphloom.operators import similar as S
from graphloom.plans import catalog


def agree(spark, folder, name, **tables):
    """Write the tables (lists of dicts) and compare the query with its SQL."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}/*.parquet'")
    got = catalog.QUERIES[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.sql(f"select {columns} from ({catalog.ORACLE_SQL[name]})").fetchall()
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(want)
    return got, rows


def test_consumption_goes_as_far_as_the_sql(spark, tmp_path):
    agree(spark, tmp_path, "J18_compute_consumed", part=([(3 << i,) for i in range(20)], "p_partkey long"))


def test_first_mention_of_keys_over_a_million(spark, tmp_path):
    orders = [(2_000_000, 1), (1, 1), (3_000_005, 2), (4, 2), (10, 3), (7, 3)]
    agree(spark, tmp_path, "F15_first_mention", orders=(orders, "o_orderkey long, o_custkey long"))


def largest_join(df):
    """The most rows that a join of the query's executed plan returned."""
    return largest(df, "Join", "numOutputRows")


def largest(df, kind, metric):
    """The largest value of a metric of the nodes of a kind in the executed plan."""
    text = df._jdf.queryExecution().executedPlan()
    found, todo = 0, [text]
    while todo:
        node = todo.pop()
        if kind in node.nodeName() and node.metrics().contains(metric):
            found = max(found, node.metrics().apply(metric).value())
        inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if re.match("(Shuffle|Broadcast)QueryStage|ResultQueryStage", node.nodeName()) else []
        children = node.children()
        todo += inner + [children.apply(i) for i in range(children.size())]
    return found


def test_arity_of_a_large_family(spark, tmp_path):
    part = [(50 * 7 * i,) for i in range(1, 401)]
    orders = [(5 * i, 50 * i) for i in range(300)]
    got, rows = agree(spark, tmp_path, "D20_arity_excludes", part=(part, "p_partkey long"), orders=(orders, "o_orderkey long, o_custkey long"))
    assert len(rows) == 300 and 0 < largest_join(got) <= 2_000


def test_dispatch_into_many_implementations(spark, tmp_path):
    supplier, customer = [(i, 3) for i in range(500)], [(i, f"c{i}", 3) for i in range(200)]
    got, rows = agree(spark, tmp_path, "O2_dispatch", supplier=(supplier, "s_suppkey long, s_nationkey int"), customer=(customer, "c_custkey long, c_name string, c_nationkey int"))
    assert len(rows) == 200 and 0 < largest_join(got) <= 2_000


def test_calls_of_one_name_without_target(spark, tmp_path):
    part = [(i, "n", "l", i % 21) for i in range(600)]
    got, rows = agree(spark, tmp_path, "O5_no_target", part=(part, "p_partkey long, p_name string, p_type string, p_size int"))
    assert len(rows) > 400 and 0 < largest_join(got) <= 4_000


def test_conformance_of_many_classes(spark, tmp_path):
    orders = [(i, s) for i in range(300) for s in "FOP"]
    got, rows = agree(spark, tmp_path, "E16_implementations", orders=(orders, "o_custkey long, o_orderstatus string"))
    assert len(rows) == 30 * 299 and 0 < largest_join(got) <= 9_000


@pytest.mark.parametrize("few", [10, 0])
def test_classes_are_shuffled_once(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(M, "FEW", few, raising=False)
    orders = [(i, s) for i in (0, 10, 20, 30, *(i for i in range(2_400) if i % 10)) for s in ("FO" if i % 20 else "OP")] + [(40, None), (None, "F"), (41, "F"), (41, None)]
    got, rows = agree(spark, tmp_path, "E16_implementations", orders=(orders, "o_custkey long, o_orderstatus string"))
    assert len(rows) > 4_000 and 0 < shuffled(got)[0] <= 2_300


@pytest.mark.parametrize("name", ["E24_c_abi", "E26_cgo", "E25_jni", "E32_grpc", "E27_ffi", "E28_python_uses", "E33_graphql", "E38_messages"])
def test_links_of_a_frequent_name(spark, tmp_path, name):
    customer, supplier = [(i, 1) for i in range(200)], [(i, 2) for i in range(150)]
    got, rows = agree(spark, tmp_path, name, customer=(customer, "c_custkey long, c_nationkey int"), supplier=(supplier, "s_suppkey long, s_nationkey int"))
    assert len(rows) >= 10_000 and 0 < largest(got, "Exchange", "shuffleRecordsWritten") <= 5_000


@pytest.mark.parametrize("name", ["E26_cgo", "E25_jni", "E32_grpc", "E27_ffi", "E28_python_uses", "E33_graphql", "E38_messages"])
def test_uses_meet_bundles_of_providers(spark, tmp_path, name):
    customer, supplier = [(i, 1 + i % 2) for i in range(200)], [(i, 2) for i in range(150)] + [(i, 4) for i in range(150, 300)]
    got, rows = agree(spark, tmp_path, name, customer=(customer, "c_custkey long, c_nationkey int"), supplier=(supplier, "s_suppkey long, s_nationkey int"))
    assert len(rows) >= 10_000 and 0 < largest_join(got) <= 2_000


def shuffled(df):
    """The rows that all exchanges of the executed plan wrote, and how many exchanges there are."""
    rows, seen, todo = 0, 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.metrics().contains("shuffleRecordsWritten"):
            rows, seen = rows + node.metrics().apply("shuffleRecordsWritten").value(), seen + 1
        children = node.children()
        todo += [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [children.apply(i) for i in range(children.size())]
    return rows, seen


@pytest.mark.parametrize("name", ["E25_jni", "E27_ffi", "E38_messages", "E32_grpc", "E28_python_uses", "E33_graphql"])
def test_uses_are_shuffled_three_times(spark, tmp_path, name):
    customer, supplier = [(i, 1) for i in range(2_000)], [(2, 2), (4, 2), (6, 4)]
    got, rows = agree(spark, tmp_path, name, customer=(customer, "c_custkey long, c_nationkey int"), supplier=(supplier, "s_suppkey long, s_nationkey int"))
    written, exchanges = shuffled(got)
    assert len(rows) > 1_000 and exchanges > 3 and written <= (3 + ("E27" in name or "E38" in name)) * 2_000 + 500


@pytest.mark.parametrize("name", ["E32_grpc", "E27_ffi", "E28_python_uses", "E33_graphql", "E38_messages"])
def test_uses_of_one_row_are_shuffled_at_most_once(spark, tmp_path, name):
    customer, supplier = [(i, 1 + i % 2) for i in range(2_000)], [(2, 2), (4, 2), (6, 4)]
    got, rows = agree(spark, tmp_path, name, customer=(customer, "c_custkey long, c_nationkey int"), supplier=(supplier, "s_suppkey long, s_nationkey int"))
    assert len(rows) > 1_000 and shuffled(got)[0] <= 2_000 + 500


@pytest.mark.parametrize("differ", [[], ["path"], ["language"], ["path", "language"]])
def test_links_of_repeated_uids(spark, differ):
    rnd = random.Random(7)
    rows = lambda n: [(f"u{rnd.randrange(n)}", rnd.choice(["a", "b", "c", None]), rnd.randrange(3), rnd.choice("xy")) for _ in range(60)]
    uses, provides = rows(50), rows(70)
    schema = "uid string, name string, path int, language string"
    got = B.by_name(spark.createDataFrame(uses, schema), spark.createDataFrame(provides, schema), "jni", 0, other_file="path" in differ, other_language="language" in differ)
    links = {(a[0], b[0]) for a in uses for b in provides if a[1] is not None and a[1] == b[1] and a[0] != b[0] and (a[2] != b[2] or "path" not in differ) and (a[3] != b[3] or "language" not in differ)}
    n = Counter(a for a, _ in links)
    assert sorted(map(tuple, got.collect())) == sorted((a, b, "jni", 0 if n[a] == 1 else 2, n[a]) for a, b in links)


def test_copies_are_compared_as_one(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    documents = [(i, " ".join(words), "en") for i in range(200)] + [(200 + i, " ".join([*words[: 39 - i], "x"]), "en") for i in range(4)] + [(300, "a b", "en"), (301, None, "en"), (302, " ".join(words), None)]
    got, rows = agree(spark, tmp_path, "H4_similar", documents=(documents, "doc_id long, text string, lang string"))
    assert len(rows) == 204 * 5 and 0 < largest_join(got) <= 4_000


def test_shared_passages_are_not_compared(spark, tmp_path, monkeypatch):
    compared, cells = [], S._cells
    monkeypatch.setattr(S, "_cells", lambda pairs: compared.append(pairs.count()) or cells(pairs))
    passage = lambda i, j: " ".join(f"p{min(i, j)}x{max(i, j)}w{k}" for k in range(20))
    texts = [" ".join(passage(i, j) for j in range(12) if j != i) for i in range(12)]
    documents = [(i, t, "en") for i, t in enumerate(texts)] + [(20, texts[3] + "\n\tx y", "en"), (21, texts[3], "de"), (22, texts[5].rsplit(" ", 70)[0], "en"), (23, "", "en"), (24, " é ü\f", "en"), (25, None, None)]
    got, rows = agree(spark, tmp_path, "H4_similar", documents=(documents, "doc_id long, text string, lang string"))
    assert {r[:2] for r in rows} == {(3, 20), (20, 3), (5, 22), (22, 5)} and compared[0] <= 24


def test_clients_and_routes_of_one_first_segment(spark, tmp_path):
    pages = [(i, f"https://a.org/en/{i}") for i in range(300)] + [(300, "https://a.org/{x}/7"), (301, "https://a.org/"), (302, "https://a.org/en/{y}")]
    got, rows = agree(spark, tmp_path, "E34_http", pages=(pages, "page_id long, url string"))
    assert len(rows) >= 300 and 0 < largest_join(got) <= 3_000
