"""Small graphs with exact expectations."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from graphloom.operators import flow as V
from graphloom.operators import graph as G
from graphloom.plans import catalog


def edges(spark, pairs, kinds=None):
    rows = [(i, str(a), str(b), (kinds or {}).get((a, b), ("calls", 0))[0], (kinds or {}).get((a, b), ("calls", 0))[1]) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "edge_id long, from_uid string, to_uid string, kind string, tier int")


def nodes(found):
    return [(r["uid"], r["distance"]) for r in found.nodes.orderBy("position").collect()]


CHAIN = [(i, i + 1) for i in range(5)]


def test_chain(spark):
    e = edges(spark, CHAIN)
    full = G.reach(e, ["0"])
    assert nodes(full) == [(str(i), i) for i in range(6)] and full.edges.count() == 5 and not full.depth_hit
    part = G.reach(e, ["0"], max_depth=2)
    assert nodes(part) == [("0", 0), ("1", 1), ("2", 2)] and part.depth_hit
    assert len(nodes(G.reach(e, ["5"], reverse=True))) == 6


def test_cycle_is_complete(spark):
    found = G.reach(edges(spark, [(0, 1), (1, 0)]), ["0"], max_depth=1)
    assert len(nodes(found)) == 2 and not found.depth_hit


def test_work_bound(spark):
    found = G.reach(edges(spark, [(i, i + 1) for i in range(40)]), ["0"], max_work=10)
    assert found.work_hit and found.work == 10


def test_several_starts(spark):
    found = G.reach(edges(spark, CHAIN[:4]), ["4", "2", "4"], reverse=True)
    assert nodes(found)[:2] == [("4", 0), ("2", 0)] and len(nodes(found)) == 5


def test_tiers(spark):
    e = edges(spark, [(0, 1), (1, 2)], {(1, 2): ("inferred_call", 1)})
    assert G.shortest_path(e, "0", "2", G.PROVEN).count() == 0
    hops = G.shortest_path(e, "0", "2", G.INFERRED).orderBy("hop").collect()
    assert [(h["from_uid"], h["to_uid"]) for h in hops] == [("0", "1"), ("1", "2")] and hops[1]["kind"] == "inferred_call"
    assert G.weakest_tier(G.shortest_path(e, "0", "2", G.INFERRED)).first()["tier"] == 1


def test_depth_of_a_path(spark):
    assert G.shortest_path(edges(spark, CHAIN), "0", "5", max_depth=3).count() == 0
    assert G.shortest_path(edges(spark, CHAIN), "3", "3").count() == 0


def test_simple_paths(spark):
    e = edges(spark, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 0), (1, 2), (0, 1)])
    paths = [r["nodes"] for r in G.all_paths(e, "0", "3").orderBy("path_no").collect()]
    assert paths == [["0", "1", "3"], ["0", "2", "3"], ["0", "1", "2", "3"]]
    assert G.all_paths(e, "0", "3", max_paths=1).count() == 1


def test_path_bounds_are_reported(spark):
    e = edges(spark, CHAIN)
    hops, depth_hit = G.find_path(e, "0", "5", max_depth=3)
    assert hops.count() == 0 and depth_hit
    hops, depth_hit = G.find_path(e, "0", "5", max_depth=5)
    assert hops.count() == 5 and not depth_hit
    assert not G.find_path(e, "5", "0")[1]
    assert not G.find_path(edges(spark, [(0, 1), (1, 0)]), "0", "9", max_depth=1)[1]


def test_bounds_of_all_paths(spark):
    e = edges(spark, [(0, 2), (0, 1), (1, 3), (2, 3), (1, 2)])
    full = G.find_paths(e, "0", "3")
    assert [r["nodes"] for r in full.paths.orderBy("path_no").collect()] == [["0", "2", "3"], ["0", "1", "3"], ["0", "1", "2", "3"]]
    assert full[1:] == (False, False, False)
    short = G.find_paths(e, "0", "3", max_depth=2)
    assert short.paths.count() == 2 and short[1:] == (True, False, False)
    few = G.find_paths(e, "0", "3", max_paths=1)
    assert few.paths.first()["nodes"] == ["0", "2", "3"] and few.paths_hit
    cut_off = G.find_paths(e, "0", "3", max_work=3)
    assert [r["nodes"] for r in cut_off.paths.collect()] == [["0", "2", "3"]] and cut_off.work_hit
    assert G.find_paths(e, "0", "3", max_work=6)[1:] == (False, False, False)


def test_deferred_kinds_are_hidden_from_the_proven_view(spark):
    e = edges(spark, [(0, 1)], {(0, 1): ("creates_generator", 0)})
    assert G.in_view(e, G.PROVEN).count() == 0 and G.in_view(e, G.INFERRED).count() == 1


@pytest.mark.parametrize("limit, members, cut", [(64, 4, False), (2, 2, True)])
def test_family(spark, limit, members, cut):
    e = edges(spark, [(1, 0), (2, 0), (3, 2)], {p: ("overrides", 0) for p in [(1, 0), (2, 0), (3, 2)]})
    found, truncated = G.family_closure(e, "0", limit)
    assert found.count() == members and truncated == cut


def test_decision_never_leaves_the_candidates(spark):
    s = "site_id string, owner_uid string, category string, operation string, activation string, via string, candidates array<string>, flow_candidates array<string>, receiver_exact boolean"
    sites = spark.createDataFrame([("s", "o", "no_target", "call", "calls", None, ["a", "b"], [], False), ("w", "o", "flow_call", "field_write", "calls", None, ["a", "b"], [], False)], s)
    decisions = spark.createDataFrame([("s", "decided", ["a", "z"]), ("w", "decided", ["b"])], "site_id string, status string, targets array<string>")
    got = sorted(tuple(r)[1:] for r in G.materialize(sites, decisions).collect())
    assert got == [("a", "inferred_call", 1, "s"), ("b", "inferred_write", 1, "w"), ("b", "possible_link", 2, "s")]


def test_receiver_rule_suppresses_the_rest(spark):
    s = "site_id string, owner_uid string, category string, operation string, activation string, via string, candidates array<string>, flow_candidates array<string>, receiver_exact boolean"
    sites = spark.createDataFrame([("s", "o", "dispatch", "call", "awaits", None, ["a", "b"], ["b"], True)], s)
    decisions = spark.createDataFrame([("s", "decided", ["b"])], "site_id string, status string, targets array<string>")
    assert [tuple(r) for r in G.materialize(sites, decisions).collect()] == [("o", "b", "awaits", 0, "s")]


def test_consumption_is_followed_however_far(spark):
    uses = spark.createDataFrame([("20",), ("20",)], "param string")
    forwards = spark.createDataFrame([(str(i), str(i + 1)) for i in range(20)] + [("20", "0")], "param string, to_param string")
    found = {r["param"]: r["distance"] for r in V.consumed(uses, forwards).collect()}
    assert found == {str(i): 20 - i for i in range(21)}


def test_reach_without_work_bound(spark):
    pairs = [(i, (i * 7 + 3) % 50) for i in range(50)] + [(i, (i * 11 + 1) % 50) for i in range(50)]
    e = edges(spark, pairs)
    bounded, whole = G.reach(e, ["4", "9"], max_depth=4), G.reach(e, ["4", "9"], max_depth=4, max_work=None)
    order = lambda found: [tuple(r) for r in found.nodes.select("uid", "distance", "position").orderBy("position").collect()]
    assert order(whole) == order(bounded) and (whole.work, whole.depth_hit, whole.work_hit) == (bounded.work, bounded.depth_hit, False)


@pytest.fixture
def low_bounds(monkeypatch):
    """The default work bound of every function that takes one, at two edges."""
    for name in ("reach", "impact"):
        function = getattr(G, name)
        places = list(function.__code__.co_varnames[: function.__code__.co_argcount])
        defaults = list(function.__defaults__)
        if "max_work" in places:
            defaults[places.index("max_work") - len(places)] = 2
        monkeypatch.setattr(function, "__defaults__", tuple(defaults))


def rows_and_oracle(spark, name, folder="/root/testdata/sf0.001"):
    sql = catalog.ORACLE_SQL[name]
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = catalog.QUERIES[name](spark, folder)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.sql(f"select {columns} from ({sql})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


@pytest.mark.parametrize("name", ["H9_impact", "J10_mention_names", "J3_reach_reverse", "G1_reaching_edges"])
def test_work_bound_cuts_no_query(spark, low_bounds, name):
    got, want = rows_and_oracle(spark, name)
    assert got == want
