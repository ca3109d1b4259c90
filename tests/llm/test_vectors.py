"""Cover tree against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from honeyframe.llm import cover_tree as C
from honeyframe.llm.ship import ship


def groups(table, cosine=0.95):
    ok, unit = [], []
    for _, v in table:
        good = v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append(good)
        a = np.array(v, np.float64) if good else None
        unit.append(a / np.linalg.norm(a) if good else None)
    n = len(table)
    link = [[j for j in range(n) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine] for i in range(n)]
    out, seen = Counter(), {}
    for i in range(n):
        if i in seen:
            continue
        todo, part = [i], {i}
        while todo:
            for j in link[todo.pop()]:
                if j not in part:
                    part.add(j)
                    todo.append(j)
        name = min((table[j][0] for j in part if table[j][0] is not None), default=None)
        seen |= dict.fromkeys(part, name)
    for i, (d, _) in enumerate(table):
        out[(d, len(link[i]), seen[i], d == seen[i])] += 1
    return out


def test_against_brute_force(spark):
    ship(spark)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(120, 16))
    near = np.concatenate([base[:3].repeat(40, axis=0) + rng.normal(size=(120, 16)) * s for s in (0.05, 0.2, 0.4)])
    table = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, near]).astype(np.float32))]
    one = table[5][1]
    table += [(900, one), (901, one), (901, one), (902, None), (903, []), (904, [0.0] * 16), (905, [None] + one[1:]), (906, [float("nan")] + one[1:])]
    table += [(907, [float("inf")] + one[1:]), (None, one), (None, None), (908, one[:8]), (909, one[:8]), (910, [2 * x for x in one])]
    d = spark.createDataFrame(table, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("id", "vector", "weight", "cell", "ok", "kept")})
    assert Counter(tuple(r) for r in C.near_vectors(d).collect()) == groups(table)
    assert C.near_vectors(d.where("false")).collect() == []


@pytest.mark.parametrize("block,centres", [(50, 4), (1000, 1)])
def test_blocks_do_not_change_the_result(spark, monkeypatch, block, centres):
    ship(spark)
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "CENTRES", centres)
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=(100, 8)), 5 + rng.normal(size=(200, 8)) * 0.8]).astype(np.float32)
    table = [(i, [float(y) for y in x]) for i, x in enumerate(v)]
    d = spark.createDataFrame(table, "vec_id long, embedding array<float>")
    assert Counter(tuple(r) for r in C.near_vectors(d).collect()) == groups(table)


def test_levels_are_nested_nets():
    rng = np.random.default_rng(2)
    p = rng.normal(size=(300, 5))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    table = C.levels(p, 0.3)
    order = np.lexsort(table.T[::-1])
    tree = C.Tree(p[order], table[order])
    for k in range(1, len(tree.node) - 1):
        assert set(tree.centre[k - 1]) <= set(tree.centre[k])
        assert (tree.node[k - 1][tree.centre[k]] == tree.node[k - 1][tree.centre[k]]).all()
        d = C.distances(tree.points, tree.points)
        assert all(d[i, tree.centre[k][tree.node[k][i]]] <= tree.radius[k][tree.node[k][i]] + 1e-6 for i in range(len(p)))


def _sent(n, dim, n_cells):
    import pyarrow as pa

    v = np.random.default_rng(3).normal(size=(n, dim))
    centres, _ = C._unit(v[:n_cells])
    columns = [np.arange(n), np.ones(n, np.int64), list(v), np.arange(n, dtype=np.int32) % n_cells, np.zeros(n, np.int32), [[0, 1]] * n]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "weight", "vector", "cell", "block", "levels"])
    blocks = np.ones(n_cells, np.int64)
    blocks[1] = 3
    return list(C._send(centres, np.full(n_cells, 2.0), blocks, 0.3)([batch])), int(blocks.sum())


def test_sent_batches_do_not_grow_with_the_blocks(monkeypatch):
    whole, total = _sent(300, 8, 20)
    monkeypatch.setattr(C, "SENT", 64 * 8 * 5)
    cut, _ = _sent(300, 8, 20)
    assert max(b.num_rows for b in cut) <= 64 * 5 // 8
    rows = lambda bs: sorted(str(r) for b in bs for r in b.to_pylist())
    assert rows(cut) == rows(whole) and sum(b.num_rows for b in cut) == 300 * total


def test_waiting_links_do_not_grow_with_the_pairs(monkeypatch):
    """Links of all points of a block become a forest as they come."""
    monkeypatch.setattr(C, "WAITING", 50)
    unit, _ = C._unit(np.random.default_rng(4).normal(size=(200, 3)))
    limit, cosine = float(np.sqrt(2 - 2 * 0.8)), 0.8
    table = C.levels(unit, limit)
    order = np.lexsort(table.T[::-1])
    tree, ids, ones = C.Tree(unit[order], table[order]), np.arange(200)[order], np.ones(200, np.int64)
    _, _, edges = C.link_blocks(ids, ones, tree, ids, ones, tree, limit, cosine, True)
    assert sum(len(p) for p, _ in edges) <= 2 * 200 + 50
    near = unit @ unit.T >= cosine

    def parts(links):
        root = list(range(200))
        for a, b in links:
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
        return [[root[i] == root[j] for j in range(200)] for i in range(200)]

    assert parts((int(a), int(b)) for p, q in edges for a, b in zip(p, q)) == parts(np.argwhere(near).tolist())
