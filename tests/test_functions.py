"""Scalar functions on hand-made values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.functions import paths as P
from graphloom.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [("parseHTTPResponse_code", ["parse", "http", "response"]), ("getURLs", ["get", "ur", "ls"]), ("utf8Decoder", ["utf8decoder"]), ("", []), ("the of", [])],
)
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.lit(text))) == want


@pytest.mark.parametrize("word, want", [("registration", "registr"), ("entries", "entry"), ("es", "es"), ("users", "user")])
def test_fold(spark, word, want):
    assert one(spark, T.fold(F.lit(word))) == want


def test_terms(spark):
    assert one(spark, T.terms(F.lit("How does login work?"))) == ["login", "work"]


@pytest.mark.parametrize("name, want", [("a::b::c()", "a.b.c"), ("Map<K, V<T>>::get", "Map.get"), ("::x:", "x"), ("a.:b", "a.b"), ("operator<", "operator")])
def test_normalize_qualified(spark, name, want):
    assert one(spark, T.normalize_qualified(F.lit(name))) == want


@pytest.mark.parametrize("a, open_a, b, open_b, want", [("users/{}", False, "users/1", False, 1), ("users", False, "users/1", False, None), ("1", True, "users/1", False, 0), ("", True, "users", False, None), ("{}", False, "{}", False, 0), ("", False, "", False, 0)])
def test_path_match(spark, a, open_a, b, open_b, want):
    assert one(spark, P.path_match(P.segments(F.lit(a)), F.lit(open_a), P.segments(F.lit(b)), F.lit(open_b))) == want


@pytest.mark.parametrize("glob, path, want", [("**/*.test.{ts,js}", "a/b/x.test.ts", True), ("src/*", "src/a/b", False), ("[!a]*.py", "b.py", True), ("tests/**", "tests/a/b", True), ("a?c", "abc", True)])
def test_globs(spark, glob, path, want):
    assert one(spark, T.glob_matches(glob, F.lit(path))) is want


def test_mangling(spark):
    assert one(spark, T.jni_mangle(F.array(F.lit("com"), F.lit("a_b")), F.array(F.lit("Outer"), F.lit("In")), F.lit("f;é"))) == "Java_com_a_1b_Outer_00024In_f_2_000e9"


def test_relative_paths(spark):
    assert one(spark, P.normalize_relative(F.lit("a/b"), F.lit("../c/./d"))) == "a/c/d"
    assert one(spark, P.normalize_relative(F.lit("a"), F.lit("../../x"))) is None
    assert one(spark, P.ancestors(F.lit("a/b"))) == ["a", ""]
