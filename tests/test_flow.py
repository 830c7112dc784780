"""Value flow: fields, cycles, bounds."""

from __future__ import annotations

from graphloom.operators import flow as V


def values(found):
    return {(r["slot"], r["value"]) for r in found.collect()}


def test_moves_fields_and_cycles(spark):
    facts = spark.createDataFrame([("a", "obj1"), ("f", "fn")], "slot string, value string")
    moves = spark.createDataFrame([("a", "b"), ("b", "a")], "source string, target string")
    stores = spark.createDataFrame([("a", "cb", "f")], "slot string, field string, source string")
    loads = spark.createDataFrame([("b", "cb", "g")], "slot string, field string, target string")
    found, bounded = V.solve(facts, moves, loads, stores)
    assert not bounded
    assert values(found) == {("a", "obj1"), ("b", "obj1"), ("f", "fn"), ("@obj1.cb", "fn"), ("g", "fn")}
    calls = spark.createDataFrame([("s1", "g"), ("s2", "zz")], "site_id string, slot string")
    assert [tuple(r) for r in V.call_targets(found, calls).collect()] == [("s1", "fn")]


def test_bounds(spark):
    facts = spark.createDataFrame([("a", str(i)) for i in range(5)], "slot string, value string")
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "source string, target string")
    found, bounded = V.solve(facts, chain, cap=3, rounds=2)
    assert bounded and found.where("slot = 'b'").count() == 3 and found.where("slot = 'b' and saturated").count() == 3
