"""Inventory, text formats, Python facts and streaming on small inputs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from graphloom.sources import formats, inventory, python_facts
from graphloom.streaming import changes


def test_inventory(spark, tmp_path):
    files = {"a/x.py": b"print(1)", "a/run": b"#!/usr/bin/env python3\n", "node_modules/y.js": b"y", "k/server.pem": b"k", "pyproject.toml": b"[x]", "bad.py": b"\xff\xfe", "notes.txt": b"n", "skip/z.py": b"z"}
    for name, content in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)
    tree = inventory.read_tree(spark, str(tmp_path))
    got = {r["path"]: (r["language"], r["is_config"], r["reason"]) for r in inventory.scan(tree, ("skip/**",)).collect()}
    assert got == {"a/x.py": ("python", False, None), "a/run": ("python", False, None), "node_modules/y.js": (None, False, "excluded"), "k/server.pem": (None, False, "sensitive"), "pyproject.toml": (None, True, None), "bad.py": (None, False, "not_utf8"), "skip/z.py": (None, False, "excluded")}
    expected = tree.select("path", F.sha2("content", 256).alias("hash"))
    assert inventory.read_verified(tree, expected).count() == len(files)
    with pytest.raises(Exception, match="changed"):
        inventory.read_verified(tree, expected.withColumn("hash", F.lit("x"))).collect()


@pytest.mark.parametrize("path", ["../a", "/a", "a/../b", ".git/x", "a:b", ""])
def test_unsafe_paths(path):
    with pytest.raises(ValueError):
        inventory.safe_path(path)
    assert inventory.safe_path("a/b.py") == "a/b.py"


@pytest.mark.parametrize(
    "reader, text, want",
    [
        ("jsonc", '{"a": "//no", /* c */ "b": [1, 2,], // x\n}', {"a": "//no", "b": [1, 2]}),
        ("toml", "[p]\nn = 'x'\nv = [1]", {"p": {"n": "x", "v": [1]}}),
        ("ini", "[s]\nKey = v\nflag\n", {"s": {"Key": "v", "flag": ""}}),
        ("yaml", "a: 1\nb:\n  - x\n  - k: true\n    z: 'q'\nc:\n  d: [1, 2]\n# end\n", {"a": 1, "b": ["x", {"k": True, "z": "q"}], "c": {"d": [1, 2]}}),
        ("proto", "package p.q; service S { rpc Get (Req) returns (stream Res); /* rpc No (A) returns (B) */ }", [{"package": "p.q", "service": "S", "rpc": "Get", "request": "Req", "response": "Res"}]),
        ("graphql", "schema { query: Root } type Root { user(id: ID!): User list: [User] } type User { id: ID }", [{"type": "Query", "field": "user"}, {"type": "Query", "field": "list"}]),
        ("openapi", '{"servers": [{"url": "https://h/v1/"}], "paths": {"/u/{id}": {"get": {"operationId": "getU"}, "x": 1}}}', [{"id": "getU", "method": "GET", "path": "/v1/u/{id}"}]),
        ("toml", "not = = toml", None),
    ],
)
def test_formats(spark, reader, text, want):
    rows = spark.createDataFrame([(text,), (None,)], "t string").select(formats.parsed(F.col("t"), reader).alias("x")).collect()
    assert (json.loads(rows[0]["x"]) if rows[0]["x"] is not None else None) == want and rows[1]["x"] is None


def test_python_facts(spark):
    text = "import os\nfrom .m import f as g\nLIMIT = 3\nclass A(B):\n    async def run(self, x):\n        return g(x)(1)\n\ndef gen():\n    yield os.path.join('a')\n"
    rows = python_facts.extract(spark.createDataFrame([("a.py", text), ("b.py", "def ("), ("c.py", None)], "path string, text string")).collect()
    got = {(r["kind"], r["qualified"], r["detail"]) for r in rows if r["kind"] in ("class", "function", "import", "data")}
    assert got == {("import", "os", "os"), ("import", "g", ".m:f"), ("data", "LIMIT", "3"), ("class", "A", "B"), ("function", "A.run", "coroutine:self,x"), ("function", "gen", "generator:")}
    assert {(r["owner"], r["name"]) for r in rows if r["kind"] == "call"} == {("A.run", "g(x)"), ("A.run", "g"), ("gen", "join")}
    assert [r["name"] for r in rows if r["kind"] == "error"] == ["SyntaxError"]


def test_debounce_rule():
    assert not changes.delivered([], 5) and not changes.delivered([(0, "a")], 299) and changes.delivered([(0, "a")], 300)
    assert changes.delivered([(t, "a") for t in range(0, 2001, 100)], 2000)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("r", "a", "2024-01-01 00:00:00", 1), ("r", "b", "2024-01-01 00:00:00.2", 2), ("r", "a", "2024-01-01 00:00:05", 3)]
    frame = spark.createDataFrame(rows, "root string, path string, ts string, generation long").withColumn("ts", F.to_timestamp("ts"))
    frame.write.parquet(str(src))
    stream = spark.readStream.schema(frame.schema).parquet(str(src))
    q = changes.latest(stream.select("path", "generation")).writeStream.format("memory").queryName("latest_generations").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("latest_generations").collect()} == {("a", 3), ("b", 2)}
    seen = []
    q = changes.updates(stream.select("path", "generation"), lambda df, n: seen.extend(tuple(r) for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(seen) == [("a", 3), ("b", 2)]
    assert sorted((r["n_events"], r["paths"]) for r in changes.debounce(frame).collect()) == [(1, ["a"]), (2, ["a", "b"])]
    stale = spark.createDataFrame([("z",), ("y",)], "path string")
    assert [r["path"] for r in changes.next_batch(stale.where("false"), stale, 1).collect()] == ["y"]


def test_snapshots(spark, tmp_path):
    from graphloom.sources import snapshots as N

    root = str(tmp_path / "index")
    table = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    N.save(table([("a", "1"), ("b", "1"), ("c", "1")]), root)
    N.append(table([("b", "2"), ("d", "1")]), table([("a", "")]), root, "path")
    N.append(table([("a", "3")]), table([("d", "")]), root, "path")
    want = {("a", "3"), ("b", "2"), ("c", "1")}
    assert {tuple(r) for r in N.load(spark, root, "path").collect()} == want
    assert N.wants_compaction(spark, root)
    N.compact(spark, root, "path")
    assert {tuple(r) for r in N.load(spark, root, "path").collect()} == want and not N.wants_compaction(spark, root)
