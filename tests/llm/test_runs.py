"""Periodic runs against brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from honeyframe import llm
from honeyframe.llm import periodic as R
from honeyframe.llm.ship import ship

llm.load()


def brute(words):
    """All runs of a list of words, from the definition."""
    n, out = len(words), []
    for q in range(1, n // R.TIMES + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i : i + length]
            smallest = next(p for p in range(1, q + 1) if part[p:] == part[: length - p])
            if smallest == q and length >= max(R.LEAST, R.TIMES * q):
                out.append((i, length, q))
            i = j
    return sorted(out)


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return b" ".join(w for k, w in enumerate(words) if k not in gone)


def check(texts):
    runs, stay = R.runs_of(texts)
    at = 0
    for k, t in enumerate(texts):
        mine = [tuple(int(x) for x in r[1:]) for r in runs if r[0] == k]
        assert mine == brute(t)
        assert b" ".join(w for w, s in zip(t, stay[at : at + len(t)]) if s) == collapsed(t, mine)
        at += len(t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), max_size=4))
def test_any_small_texts(texts):
    check(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), min_size=1, max_size=30), st.integers(2, 12), st.lists(st.sampled_from([b"a", b"b"]), max_size=9))
def test_powers_of_words(root, times, around):
    check([around + root * times + around, root * times])


def test_large_names_are_ordered_the_same():
    rng = np.random.default_rng(0)
    left, right = rng.integers(0, 3, 200), rng.integers(0, 3, 200)
    at = np.arange(200)
    packed = R._ranked(left, right, at)
    wide = R._ranked(left << 40, right << 40, at)
    assert all((a == b).all() for a, b in zip(packed, wide))


ODD = [
    (1, "a a a a a a b"), (1, "a a a a a a b"), (2, None), (3, ""), (4, " \t\n\x0b "), (None, "x y x y x y x y"), (None, None),
    (5, "one\ttwo\none  two one two one\x0ctwo\rone"), (6, "w " * 30_000), (7, "ab\x1cab ab\x1cab 　 　 　 　 　 　"),
    (8, " ".join(f"p{i % 300}" for i in range(1300))), (9, "é é é é é é"),
]


def test_odd_rows(spark, monkeypatch):
    ship(spark)
    d = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("runs", "collapsed", "start", "n")})
    got = Counter((r["doc_id"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in R.find_runs(d).collect())
    want = Counter()
    for i, t in ODD:
        words = (t or "").encode().split()
        runs = [(0, 30_000, 1)] if i == 6 else brute(words)
        want[(i, tuple(runs), collapsed(words, runs).decode())] += 1
    assert got == want
    assert R.find_runs(d.where("false")).collect() == []


@pytest.fixture(scope="module")
def result(spark, sf):
    return {r["doc_id"]: r for r in llm.QUERIES["op11_periodic_runs"](spark, sf).collect()}


def test_query_against_brute_force(spark, sf, result):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(docs) == len(result)
    planted = 0
    for d, text in docs:
        words = (text or "").encode().split()
        h = zlib.crc32(str(d).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        got = result[d]
        if n > 1500:  # the definition takes too long for the longest ones
            continue
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        planted += bool(runs)
        assert got["n_runs"] == len(runs)
        assert (got["start"], got["length"], got["period"]) == (best or (None,) * 3)
        assert got["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert got["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert got["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs)).hexdigest()
    assert planted > 5
