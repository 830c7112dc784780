"""Exact and near dedup of texts and vectors against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

from graphloom.llm import embed_dedup, setsketch, substring, suffix_dedup, windows
from graphloom.llm import shared as S


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def awkward(seed, letters, sep, most):
    r = random.Random(seed)
    rows = [(i, sep.join(r.choice(letters) for _ in range(r.randint(0, most)))) for i in range(120)]
    rows += [(300, sep.join("a" * 500)), (301, None), (302, ""), (303, " \t\n"), (None, sep.join("ab" * 100)), (304, rows[3][1]), (305, rows[3][1]), (306, "é" * 50 + sep + "日本" * 30)]
    return rows


@pytest.mark.parametrize("hot", [300_000, 40])
@pytest.mark.parametrize("stretch", [1 << 18, 100])
def test_suffix_dedup(spark, monkeypatch, hot, stretch):
    monkeypatch.setattr(windows, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
    rows = awkward(1, "ab", "", 200)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, v int").repartition(3)
    assert rows_of(suffix_dedup.dedup(docs, 20)) == sorted(brute.suffix_dedup(rows, 20), key=str)


@pytest.mark.parametrize("hot", [300_000, 20])
def test_substring_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(windows, "HOT", hot)
    rows = awkward(2, "ab", " ", 60)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, hot int").repartition(3)
    assert rows_of(substring.dedup(docs, 8)) == sorted(brute.substring_dedup(rows, 8), key=str)


def test_repeated_ids_and_empty_tables(spark):
    twice = spark.createDataFrame([(1, "x y z " * 10), (1, "x y z " * 10)], "doc_id long, text string")
    assert suffix_dedup.dedup(twice, 20).count() == 2
    assert substring.dedup(twice, 4).count() == 2
    assert setsketch.near_duplicates(twice).count() == 2
    empty = twice.where("false")
    for out in (suffix_dedup.dedup(empty, 20), substring.dedup(empty, 4), setsketch.near_duplicates(empty)):
        assert out.count() == 0
    nothing = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embed_dedup.near_duplicates(nothing).count() == 0


def test_regular_strings_are_told_apart(spark):
    """A Thue-Morse string and its complement have the same polynomial hash modulo 2**64."""
    rows, more = [], " ".join("cdefghijklmnopqrstu")
    for n in (512, 2048):
        one, two = brute.thue_morse(n), brute.thue_morse(n, "b", "a")
        rows += [one, two, f"{one} {more}", f"{two} {more}", " ".join(one), " ".join(two)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(suffix_dedup.dedup(docs, 400)) == sorted(brute.suffix_dedup(rows, 400), key=str)
    assert rows_of(substring.dedup(docs, 20)) == sorted(brute.substring_dedup(rows, 20), key=str)
    assert rows_of(setsketch.near_duplicates(docs, 85)) == sorted(brute.near_duplicates(rows, 85), key=str)


def test_radix_passes_order_by_bytes():
    r = random.Random(8)
    for length in (3, 8, 13, 40):
        data = bytes(r.choice(b"ab") for _ in range(600)) * 2
        at = np.arange(len(data) - length + 1)
        key = np.array([data[p] % 2 for p in at])
        left = suffix_dedup.sort_passes(key, at, suffix_dedup._digits(np.frombuffer(data, np.uint8)), length)
        count = Counter(data[p : p + length] for p in at)
        assert left.tolist() == [p for p in at.tolist() if count[data[p : p + length]] > 1]


def test_prime_hashes_of_slices():
    r = np.random.default_rng(9)
    x = S.mix(r.integers(0, 3, 5000, dtype=np.uint64) + np.uint64(1))
    start = r.integers(0, 4000, 3000)
    size = r.integers(0, 12, 3000)
    h = S.SURE_WORD.slices(S.SURE_WORD.sums(x), start, start + size)
    of = {}
    for a, n, v in zip(start.tolist(), size.tolist(), h.tolist(), strict=True):
        of.setdefault(x[a : a + n].tobytes(), set()).add(v)
    assert all(len(v) == 1 for v in of.values()) and len(set().union(*of.values())) == len(of)
    assert (S.SURE_WORD.grams(S.SURE_WORD.sums(x), 5) == S.SURE_WORD.slices(S.SURE_WORD.sums(x), np.arange(4996), np.arange(5, 5001))).all()


def test_long_word_and_long_text(spark):
    rows = [(1, "w" * 700_000), (2, "w" * 700_000 + " x"), (3, "q " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring.dedup(docs, 20).collect()}
    assert got[1]["n_removed"] == 0 and got[3]["n_words"] == 300_000 and got[3]["n_removed"] == 299_999
    spans = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.dedup(docs, 400).collect()}
    assert spans[1] == 700_000 and spans[2] == 700_000 and spans[3] == 600_000


def test_automaton_matches_brute_force():
    r = random.Random(4)
    for _ in range(200):
        texts = [[r.randint(0, 2) for _ in range(r.randint(0, 25))] for _ in range(4)]
        automaton, seen = substring.SuffixAutomaton(), set()
        for text in texts:
            automaton.begin()
            for i in range(1, len(text) + 1):
                want = max((n for n in range(i + 1) if n == 0 or tuple(text[i - n : i]) in seen), default=0)
                assert automaton.step(text[i - 1]) == want
                seen.update(tuple(text[j:i]) for j in range(i))


def near_rows(n=150):
    r = random.Random(5)
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            w = r.choice(rows)[1].split()
            for _ in range(r.randint(0, 4)):
                if w:
                    w[r.randrange(len(w))] = r.choice("uvwxyz")
        else:
            w = [r.choice("abcdefghij") + r.choice("abcdefghij") for _ in range(r.choice([0, 2, 4, 30, 80]))]
        rows.append((i, " ".join(w)))
    return rows + [(500, None), (501, "A B c"), (502, "a b C"), (None, "a b c"), (503, rows[4][1])]


@pytest.mark.parametrize("block", [2048, 16])
@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, monkeypatch, block, percent):
    monkeypatch.setattr(setsketch, "BLOCK", block)
    rows = near_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rep int").repartition(3)
    assert rows_of(setsketch.near_duplicates(docs, percent)) == sorted(brute.near_duplicates(rows, percent), key=str)


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(6)
    a = r.integers(1, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate((a[:800], r.integers(1, 1 << 63, 200, dtype=np.uint64)))
    one, two, both = (setsketch.registers(x, np.array([0, len(x)]), 264)[0] for x in (a, b, np.concatenate((a, b))))
    assert (np.maximum(one, two) == both).all()
    assert abs((one == two).mean() - 800 / 1200) < 0.12


def vectors():
    r = np.random.default_rng(0)
    rows = []
    for i in range(300):
        v = np.array(rows[r.integers(len(rows))][1]) + r.normal(0, 0.13, 8) if i and r.random() < 0.5 else r.normal(0, 1, 8)
        rows.append((i, [float(x) for x in v], int(r.integers(2))))
    same = rows[3][1]
    return rows + [(300, same, rows[3][2]), (301, same, rows[3][2]), (302, None, 1), (303, [], 1), (304, [0.0] * 8, 1), (305, [float("nan")] * 8, 1), (306, [None] + [1.0] * 7, 1), (307, same, None), (None, same, 1), (308, [1.0, 2.0], 1), (309, [2.0, 4.0], 1), (310, [float("inf")] * 8, 1)]


@pytest.mark.parametrize("block", [1024, 8])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rows = vectors()
    root, links, spaces = {i: i for i, *_ in rows}, Counter(), defaultdict(list)
    for n, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            spaces[label, len(v)].append(n)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for own in spaces.values():
        x = np.array([rows[n][1] for n in own])
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1)), strict=True):
            i, j = rows[own[a]][0], rows[own[b]][0]
            links.update((i, j))
            p, q = find(i), find(j)
            root[max(p, q)] = min(p, q)
    want = sorted(((i, links[i], None if i is None else find(i), i is None or find(i) == i) for i, *_ in rows), key=str)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, n int")
    assert rows_of(embed_dedup.near_duplicates(df)) == want


def test_saturated_groups_stay_together(spark, monkeypatch):
    """Four tight sub-groups whose cross pairs link too: no list is long enough to leave its sub-group."""
    monkeypatch.setattr(embed_dedup, "BLOCK", 256)
    r = np.random.default_rng(3)
    axes = np.linalg.qr(r.normal(size=(64, 64)))[0]
    noise = r.normal(size=(4, 300, 64))
    x = (np.sqrt(0.948) * axes[0] + np.sqrt(0.052) * axes[1:5, None] + 0.078 * noise / np.linalg.norm(noise, axis=2)[:, :, None]).reshape(1200, 64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert links.min() > 1000
    df = spark.createDataFrame([(i, [float(a) for a in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(row) for row in embed_dedup.near_duplicates(df).collect()) == [(i, int(n), 0, i == 0) for i, n in enumerate(links)]


def test_components(spark):
    r = random.Random(7)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(9, 9)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["id"]: r["component"] for r in S.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if any(x in p and p[0] != p[1] for p in pairs)}
