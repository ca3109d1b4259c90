"""Repeated byte strings against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from honeyframe import llm
from honeyframe.llm import parsing as P
from honeyframe.llm.ship import ship

llm.load()


def brute(texts, least=P.LEAST):
    """Spans and rest of each text, from the definition."""
    holders = defaultdict(list)
    for k, t in enumerate(texts):
        for i in range(len(t) - least + 1):
            holders[hashlib.blake2b(t[i : i + least], digest_size=16).digest()].append((k, i))
    gone = [np.zeros(len(t), bool) for t in texts]
    for where in holders.values():
        if len(where) > 1:
            for k, i in where:
                gone[k][i : i + least] = True
    out = []
    for t, g in zip(texts, gone):
        edge = np.flatnonzero(np.diff(np.r_[0, g.astype(int), 0]))
        out.append(([(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])], bytes(c for c, x in zip(t, g) if not x)))
    return out


def check(spark, table, **options):
    d = spark.createDataFrame(table, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("block", "k0", "n", "live", "hits", "at")})
    got = Counter((r["doc_id"], r["n_bytes"], tuple(map(tuple, r["spans"])), bytes(r["kept"])) for r in P.remove_repeats(d, **options).collect())
    texts = [(t or "").encode() for _, t in table]
    want = Counter((i, len(t), tuple(s), k) for (i, _), t, (s, k) in zip(table, texts, brute(texts)))
    assert got == want


def prose(rng, n):
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))


def test_windows_without_a_whole_phrase():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 9000).astype(np.uint8).tobytes()
    s = P.Block(data, np.array([0, 399, 400, 0, 3000, 401, len(data) - 4200]))
    places = np.concatenate([np.arange(a, b - P.LEAST + 1) for a, b in zip(s.starts, s.ends) if b - a >= P.LEAST])
    first, n = s.window(places)
    assert sorted(s.bare()[0]) == sorted(places[n < 2])
    lo, hi, _ = s.gaps()
    assert sorted(P._ranges(lo, hi)) == sorted(places)


def test_only_repeat_starts_in_a_piece_whose_first_place_has_no_whole_phrase(spark):
    ship(spark)
    rng = np.random.default_rng(3)
    while True:  # texts with the same two triggers, both in the common end
        q, z, x = rng.choice(list("qrstuvwxyz"), 3, replace=False).tolist()
        word = "".join(chr(97 + c) for c in rng.integers(0, 16, 24))
        tail = x * 100 + word + x * 200 + word + x * 117
        texts = [q * 269 + tail, z * 224 + tail]
        if all((P.triggers(np.frombuffer(t.encode(), np.uint8)) - len(t) + len(tail) > 65).sum() == len(P.triggers(np.frombuffer(t.encode(), np.uint8))) == 2 for t in texts):
            break
    for t in texts:
        (lo,), (hi,), (bare,) = P.Block(t.encode(), np.array([len(t)])).gaps()
        assert lo <= bare < hi
    check(spark, [*enumerate(texts), (2, prose(rng, 200)), (3, None)])


def test_triggers_do_not_depend_on_pieces():
    data = np.random.default_rng(2).integers(0, 256, 5000).astype(np.uint8)
    assert (P.triggers(data, 64) == P.triggers(data)).all()


@pytest.mark.parametrize("sizes", [[9], [1] * 9, [2, 3, 4], [4, 0, 5]])
def test_equal_neighbours_in_sorted_batches(sizes):
    import pyarrow as pa

    keys = np.array([1, 2, 2, 3, 4, 4, 4, 5, 6])
    n = np.array([1, 1, 1, 3, 1, 1, 1, 1, 1])
    ends = np.cumsum(sizes)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[e - m : e]), pa.array(np.arange(9)[e - m : e]), pa.array(n[e - m : e])], names=["k0", "block", "n"]) for m, e in zip(sizes, ends)]
    got = [r for b in P._neighbours(1)(iter(batches)) for r in b.to_pylist()]
    assert sorted(r["block"] for r in got if not r["edge"]) == [1, 2, 3, 4, 5, 6]
    assert sorted((r["block"], r["n"]) for r in got if r["edge"]) == [(0, 1), (8, 1)]
    one = [r for b in P._neighbours(1)(iter([batches[-1].slice(sizes[-1] - 1)])) for r in b.to_pylist()]
    assert [(r["block"], r["edge"]) for r in one] == [(8, True)]


def edits(rng, text, n):
    t = list(text)
    for _ in range(n):
        i = int(rng.integers(0, len(t)))
        kind = rng.integers(0, 3)
        if kind == 0:
            t[i] = chr(97 + int(rng.integers(0, 26)))
        elif kind == 1:
            t.insert(i, "#")
        else:
            del t[i]
    return "".join(t)


@pytest.mark.parametrize("block", [1 << 22, 5000])
def test_copies_passages_and_edits(spark, block):
    ship(spark)
    rng = np.random.default_rng(7)
    base = [prose(rng, 300) for _ in range(6)]
    passages = [prose(rng, 90)[:n] for n in (399, 400, 401, 420, 460, 500)]
    table = [(i, t) for i, t in enumerate(base)]
    table += [(10, base[0]), (11, base[0]), (12, base[1][:900]), (13, base[1][500:1400] + "x"), (14, base[2][3:])]
    for k in range(12):
        table.append((20 + k, edits(rng, base[k % 3], 1 + k % 5)))
    for k in range(18):
        t = prose(rng, 60)
        at = int(rng.integers(0, len(t)))
        table.append((40 + k, t[:at] + passages[k % 6] + t[at:]))
    table += [(70, passages[3]), (71, "y" + passages[5]), (72, passages[5] + passages[5]), (73, base[4][100:700] + base[5][50:800])]
    check(spark, table, block_bytes=block)


def test_periodic_and_odd_rows(spark):
    ship(spark)
    rng = np.random.default_rng(9)
    long = prose(rng, 3000)
    table = [
        (1, None), (2, ""), (None, "short"), (None, None), (3, "a" * 399), (4, "a" * 400), (4, "a" * 400), (5, "b" * 401), (6, "ab" * 900),
        (7, "é" * 300), (8, "x" + "é" * 300), (9, long), (10, "z" * 3000), (11, "q" * 200 + "z" * 450 + "q" * 200), (12, long[5000:5900]),
        (13, "".join(f"{i % 7}-" for i in range(900))), (14, prose(rng, 100) + "c" * 400), (15, "c" * 380 + prose(rng, 100)),
    ]
    check(spark, table)
    d = spark.createDataFrame(table, "doc_id long, text string")
    assert P.remove_repeats(d.where("false")).collect() == []


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    texts = [(t or "").encode() for _, t in docs]
    want = {
        d: (len(t), sum(n for _, n in s), len(s), hashlib.sha256(k).hexdigest()) for (d, _), t, (s, k) in zip(docs, texts, brute(texts))
    }
    got = {r[0]: tuple(r)[1:] for r in llm.QUERIES["op13_prefix_free_parsing"](spark, sf).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_rows_of_keys_are_not_written_before_they_are_sorted(spark):
    """Of all keys only the places of those that repeat are written, also where a key lies
    in every block and where a partition has a single key."""
    rows = [(k, block, b"\1\0\0\0", 1) for block in range(40) for k in (7, 1000 + block, 2000 + block // 2)] + [(5, 3, b"\2\0\0\0", 2)]
    rows = spark.createDataFrame(rows, "k0 long, block long, at binary, n long").repartition(9)

    class Counted(P.Written):
        tables = 0

        def write(self, *args):
            self.tables += 1
            return super().write(*args)

    store = Counted(spark)
    got = {r["block"]: sorted(r["hits"]) for r in P._repeated(rows, ["k0"], "k0", store).collect()}
    assert got == {b: sorted([7, 2000 + b // 2] + [5] * (b == 3)) for b in range(40)}
    assert store.tables == 1


@pytest.mark.parametrize("lane", [0, 1])
def test_hashes_depend_on_bytes_only(lane):
    """Ranges over pieces and in them, at any place; strings that agree in their counts of
    bytes, or in how often they change, do not agree in their hashes."""
    rng = np.random.default_rng(7)
    part = rng.integers(0, 256, 700).astype(np.uint8)
    data = np.concatenate([np.zeros(P._PIECE - 350, np.uint8), part, rng.integers(0, 256, 2 * P._PIECE + 11).astype(np.uint8), part])
    h = P.Hashes(data, lane)
    at = np.arange(len(data) - 700 + 1)
    one, two = P._PIECE - 350, len(data) - 700
    for lo, hi in ((0, 700), (3, 403), (349, 351), (699, 700)):
        assert h.of(np.array([one + lo]), np.array([one + hi])) == h.of(np.array([two + lo]), np.array([two + hi]))
    random = at[at > P._PIECE + 350]
    assert len(np.unique(h.of(random, random + 400))) == len(random)
    turns = np.array([bin(i).count("1") % 2 for i in range(256)], np.uint8)
    both = P.Hashes(np.r_[turns, 1 - turns, turns[::-1][:200], np.roll(turns, 1)[:200]], lane)
    assert len(set(both.of(np.array([0, 256]), np.array([256, 512])).tolist())) == 2
    assert both.of(np.array([5, 5]), np.array([5, 6])).tolist()[0] == 0


def test_digests_are_made_for_a_block_at_once():
    """Before, each place was cut out and digested alone."""
    rng = np.random.default_rng(8)
    text = rng.integers(97, 123, 5000).astype(np.uint8).tobytes()
    s = P.Block(text * 2, np.array([5000, 5000]))
    i = np.arange(5000 - P.LEAST + 1)
    names = [np.zeros(len(s.at), np.int64) for _ in range(4)]
    for k, level in enumerate(names):  # equal ranges of phrases have equal names
        level[:] = s.at % 5000 + 1 + 10_000 * k
    ok, keys = s.keys(names, np.r_[i, i + 5000])
    assert ok.all() and (keys[: len(i)] == keys[len(i) :]).all()
    assert len(np.unique(keys[: len(i), 0])) == len(np.unique(keys[: len(i), 1])) == len(i)
