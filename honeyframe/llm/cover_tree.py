"""Threshold pairs of embeddings by a dual traversal of cover trees.

Vectors are scaled to length one in double precision; cosine >= c is distance
<= sqrt(2 - 2c). Equal vectors are one weighted point.

- The top of the tree: centres picked from a bounded sample by farthest-first
  order, whose prefixes are nested nets. Every point joins its nearest centre;
  the covering radius of a centre is the largest distance measured over *all* its
  points. Centres with more than ``BLOCK`` points are dealt into blocks.
- Below it each block has its own levels with halving radii: a level's nodes are
  points of the block farther apart than the radius under one parent, and the
  children of a node include its own centre. Radii of nodes are measured.
- Traversal: pairs of top nodes whose distance exceeds both radii and the limit
  are pruned, a point only goes to the blocks whose ball it can reach. Within a
  pair of blocks levels are walked together: node pairs too far apart are
  pruned, pairs that are near enough as a whole are taken as they are, and the
  rest is opened, down to points.

Links are counted, not written: a pair of nodes taken whole adds weights, and a
few of its links are enough for the components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from honeyframe.llm.common import Written, components, widths

#: Points of a block, centres of the top level at most, and the sample for them.
BLOCK, CENTRES, SAMPLE = 4096, 1024, 8192
#: Bytes of vectors in a batch that is sent to pairs of blocks, and pairs that wait in a list.
SENT, WAITING = 8 << 20, 1 << 18
_EPS = 1e-9


def _unit(rows) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one dimension as rows of length one; which are usable."""
    m = np.asarray(rows, dtype=np.float64)
    norm = np.sqrt((m * m).sum(axis=1))
    ok = np.isfinite(norm) & (norm > 0)
    return m / np.where(ok, norm, 1.0)[:, None], ok


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between rows of length one."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def farthest_first(points: np.ndarray, count: int) -> np.ndarray:
    """Indices of nested nets: each next point is the farthest from those before."""
    out, d = [0], distances(points, points[:1])[:, 0]
    while len(out) < min(count, len(points)):
        k = int(np.argmax(d))
        if d[k] <= _EPS:
            break
        out.append(k)
        d = np.minimum(d, distances(points, points[k : k + 1])[:, 0])
    return np.array(out)


def levels(points: np.ndarray, limit: float) -> np.ndarray:
    """Node of every point on each level of a block, as a table (points, levels).

    Radii halve from level to level. Nodes are numbered in the order of their
    parents and a node's own centre leads its children, so that in the order of
    the rows of the table the first point of a node is its centre.
    """
    n = len(points)
    node = np.zeros(n, np.int64)
    centre = np.zeros(1, np.int64)
    reach = widest = distances(points, points[:1])[:, 0].max(initial=0.0)
    out = [node]
    while widest > limit / 4 and len(centre) < n:
        reach /= 2
        below, centres, widest = np.zeros(n, np.int64), [], 0.0
        order = np.argsort(node, kind="stable")
        ends = np.cumsum(np.bincount(node, minlength=len(centre)))
        for k, todo in enumerate(np.split(order, ends[:-1])):
            c = int(centre[k])
            if len(todo) == 1:
                below[c] = len(centres)
                centres.append(c)
                continue
            while len(todo):
                near = distances(points[todo], points[c : c + 1])[:, 0]
                inside = (near <= reach) | (todo == c)
                below[todo[inside]] = len(centres)
                centres.append(c)
                widest = max(widest, near[inside].max())
                todo = todo[~inside]
                c = int(todo[0]) if len(todo) else -1
        node, centre = below, np.array(centres)
        out.append(node)
    first = np.ones(n, np.int64)
    first[centre] = 0  # the centre before the other points of its node
    return np.stack([*out, first], axis=1)


class Tree:
    """Levels of a block of points that are sorted by their table: for each
    level the node of every point, and the centre and the measured radius of
    every node. The last level is the points. Where only some points of a block
    are at hand, nodes without points are left out and the first point of a node
    stands in for its centre."""

    def __init__(self, points: np.ndarray, table: np.ndarray):
        self.points = points
        n = len(points)
        self.node = [*table[:, :-1].T, np.arange(n)]
        self.centre, self.radius, self.kids = [], [], []
        for k, known in enumerate(self.node):
            _, centre, node = np.unique(known, return_index=True, return_inverse=True)
            self.node[k] = node
            inner = np.einsum("ij,ij->i", points, points[centre[node]])
            away = np.sqrt(np.maximum(2.0 - 2.0 * inner, 0.0))
            away[centre] = 0.0
            self.centre.append(centre)
            self.radius.append(np.maximum.reduceat(away, centre) if n else away)
        for k in range(len(self.node) - 1):
            up = self.node[k][self.centre[k + 1]]
            self.kids.append(np.concatenate([[0], np.cumsum(np.bincount(up, minlength=len(self.centre[k])))]))

    def last(self, k: int) -> bool:
        return k == len(self.node) - 1

    def bounds(self, k: int) -> np.ndarray:
        """First child of each node of a level, and the end; of points themselves."""
        return self.kids[k] if k < len(self.kids) else np.arange(len(self.points) + 1)


def _opened(a: Tree, b: Tree, i: int, j: int, pairs: np.ndarray, same: bool):
    """Children of node pairs with the cosine of their centres, in bounded parts.

    Pairs with many children are one matrix product, the others a list."""
    ba, bb = a.bounds(i), b.bounds(j)
    ca, cb = a.centre[min(i + 1, len(a.node) - 1)], b.centre[min(j + 1, len(b.node) - 1)]
    points = a.last(min(i + 1, len(a.node) - 1))
    na, nb = ba[pairs[:, 0] + 1] - ba[pairs[:, 0]], bb[pairs[:, 1] + 1] - bb[pairs[:, 1]]
    big = na * nb >= 1 << 14
    for x, y in pairs[big].tolist():
        right = np.arange(bb[y], bb[y + 1])
        for lo in range(ba[x], ba[x + 1], 512):
            left = np.arange(lo, min(lo + 512, ba[x + 1]))
            near = a.points[ca[left]] @ b.points[cb[right]].T
            if same and x == y:
                near[(left[:, None] > right[None, :]) | (points & (left[:, None] == right[None, :]))] = -9.0
            yield left, right, near
    small, na, nb = pairs[~big], na[~big], nb[~big]
    each = na * nb
    cuts = np.searchsorted(np.cumsum(each), np.arange(0, each.sum(), 1 << 18), side="left") if len(small) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(small)]):
        lo, hi = int(lo), int(hi)
        p, ea, eb = small[lo:hi], na[lo:hi], nb[lo:hi]
        n = ea * eb
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x = np.repeat(ba[p[:, 0]], n) + at // np.repeat(np.maximum(eb, 1), n)
        y = np.repeat(bb[p[:, 1]], n) + at % np.repeat(np.maximum(eb, 1), n)
        if same:
            inner = np.repeat(p[:, 0] == p[:, 1], n)
            ok = ~inner | (x < y) | ((x == y) & (not points))
            x, y = x[ok], y[ok]
        yield x, y, np.einsum("ij,ij->i", a.points[ca[x]], b.points[cb[y]])


def traverse(a: Tree, b: Tree, limit: float, cosine: float, same: bool):
    """Node pairs of two trees within the limit: yields ``(level a, level b,
    nodes of a, nodes of b)`` of pairs that are linked as a whole.

    In one tree against itself each pair comes once, a node with itself too
    (points with themselves do not).
    """
    roots = np.zeros((1, 2), np.int64)
    if 2 * a.radius[0][0] <= limit - _EPS and same:
        yield 0, 0, roots[:, 0], roots[:, 1]
        return
    stack = [(0, 0, roots)]
    while stack:
        i, j, pairs = stack.pop()
        ni, nj = min(i + 1, len(a.node) - 1), min(j + 1, len(b.node) - 1)
        ends = a.last(ni) and b.last(nj)
        for x, y, near in _opened(a, b, i, j, pairs, same):
            if near.ndim == 1:
                ra, rb = a.radius[ni][x], b.radius[nj][y]
            else:
                ra, rb = a.radius[ni][x][:, None], b.radius[nj][y][None, :]
            if ends:
                hit, rest = near >= cosine, None
            else:
                d = np.sqrt(np.maximum(2.0 - 2.0 * near, 0.0))
                hit = (d + ra + rb <= limit - _EPS) & (near > -2.0)
                rest = (d - ra - rb <= limit + _EPS) & ~hit & (near > -2.0)
            for mask in (hit, rest):
                if mask is None or not mask.any():
                    continue
                if near.ndim == 1:
                    got = np.stack([x[mask], y[mask]], axis=1)
                else:
                    r, c = np.nonzero(mask)
                    got = np.stack([x[r], y[c]], axis=1)
                if mask is hit:
                    yield ni, nj, got[:, 0], got[:, 1]
                else:
                    stack.append((ni, nj, got))


def link_blocks(ids_a, weights_a, tree_a: Tree, ids_b, weights_b, tree_b: Tree, limit: float, cosine: float, same: bool):
    """Links of each point (by weight), and pairs that join the components."""
    got_a, got_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = known = 0
    for i, j, x, y in traverse(tree_a, tree_b, limit, cosine, same):
        na, nb = len(tree_a.centre[i]), len(tree_b.centre[j])
        wa = np.bincount(tree_a.node[i], weights_a, minlength=na).astype(np.int64)
        wb = np.bincount(tree_b.node[j], weights_b, minlength=nb).astype(np.int64)
        self_pair = (x == y) if same else np.zeros(len(x), bool)
        to_a = np.zeros(na, np.int64)
        to_b = np.zeros(nb, np.int64)
        np.add.at(to_a, x, wb[y])
        np.add.at(to_b, y[~self_pair], wa[x[~self_pair]])
        got_a += to_a[tree_a.node[i]]
        got_b += to_b[tree_b.node[j]]
        if same and self_pair.any():  # a point is not its own link
            own = np.zeros(na, bool)
            own[x[self_pair]] = True
            got_a -= np.where(own[tree_a.node[i]], weights_a, 0)
        ca, cb = ids_a[tree_a.centre[i]], ids_b[tree_b.centre[j]]
        edges.append((ca[x], cb[y]))
        # the other points of a node that is linked as a whole, each by one link
        for tree, level, hit, other, ids in ((tree_a, i, x, cb[y], ids_a), (tree_b, j, y, ca[x], ids_b)):
            if not tree.last(level):
                to, of = np.zeros(len(tree.centre[level]), np.int64), np.zeros(len(tree.centre[level]), bool)
                to[hit], of[hit] = other, True
                inner = of[tree.node[level]]
                edges.append((ids[inner], to[tree.node[level][inner]]))
        waiting += sum(len(p) for p, _ in edges[known:])
        if waiting > WAITING:  # as many pairs as there are links would not fit
            edges, waiting = [tuple(np.array(c, np.int64) for c in _forest(edges))], 0
        known = len(edges)
    return got_a, got_b, edges


def _forest(edges: list) -> tuple[list, list]:
    """Pairs that keep the components of the given ones: fewer than points."""
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    left, right = [], []
    for p, q in edges:
        for u, v in zip(p.tolist(), q.tolist()):
            x, y = find(u), find(v)
            if x != y:
                root[x] = y
                left.append(u)
                right.append(v)
    return left, right


def _block(limit: float):
    """Levels of one block, a row for each point."""

    def run(key, pdf):
        unit, _ = _unit(np.stack(pdf["vector"].to_numpy()))
        table = levels(unit, limit)
        return pd.DataFrame({**{c: pdf[c] for c in ("id", "weight", "vector", "cell", "block")}, "levels": [r.tolist() for r in table]})

    return run


def _assign(centres: np.ndarray):
    """Nearest centre of each point and its distance."""

    def run(batches):
        for b in (batch.slice(lo, BLOCK // 4) for batch in batches for lo in range(0, batch.num_rows, BLOCK // 4)):
            unit, _ = _unit(np.stack(b.column(2).to_numpy(zero_copy_only=False)))
            d = distances(unit, centres)
            k = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(k, pa.int32()), pa.array(d[np.arange(len(k)), k])], names=[*b.schema.names, "cell", "away"]
            )

    return run


def _send(centres: np.ndarray, radius: np.ndarray, blocks: np.ndarray, limit: float):
    """Each point to the pairs of blocks that it can have a link in. A point goes to as many
    as there are blocks, so a batch is taken in parts whose rows stay within ``SENT``."""

    def run(batches):
        gap = distances(centres, centres)
        meet = gap - radius[:, None] - radius[None, :] <= limit + _EPS  # pairs of top nodes that stay
        most = max(1, SENT // (8 * centres.shape[1]))
        step = max(1, most // max(1, int(blocks.sum())))
        for b in (batch.slice(lo, step) for batch in batches for lo in range(0, batch.num_rows, step)):
            unit, _ = _unit(np.stack(b.column(2).to_numpy(zero_copy_only=False)))
            d = distances(unit, centres)
            cell, block = b.column(3).to_numpy(), b.column(4).to_numpy()
            reach = (d - radius[None, :] <= limit + _EPS) & meet[cell]
            reach[np.arange(len(cell)), cell] = True
            row, to = np.nonzero(reach)
            n = blocks[to]
            row, other = np.repeat(row, n), np.repeat(to, n)
            part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            mine = np.stack([cell[row], block[row]], axis=1)
            theirs = np.stack([other, part], axis=1)
            first = (mine[:, 0] < theirs[:, 0]) | ((mine[:, 0] == theirs[:, 0]) & (mine[:, 1] <= theirs[:, 1]))
            lo, hi = np.where(first[:, None], mine, theirs), np.where(first[:, None], theirs, mine)
            for s in (slice(k, k + most) for k in range(0, len(row), most)):
                yield pa.RecordBatch.from_arrays([
                    pa.array(lo[s, 0], pa.int32()), pa.array(lo[s, 1], pa.int32()), pa.array(hi[s, 0], pa.int32()), pa.array(hi[s, 1], pa.int32()),
                    pa.array(~first[s]), *(b.column(k).take(pa.array(row[s])) for k in (0, 1, 2, 5)),
                ], names=["c1", "b1", "c2", "b2", "second", "id", "weight", "vector", "levels"])

    return run


def _join(limit: float, cosine: float):
    def run(key, pdf):
        one = key[0] == key[2] and key[1] == key[3]
        sides = []
        for s in (False, True):
            p = pdf[pdf["second"] == s]
            if len(p):
                table = np.stack(p["levels"].to_numpy())
                order = np.lexsort(table.T[::-1])
                unit, _ = _unit(np.stack(p["vector"].to_numpy())[order])
                sides.append((p["id"].to_numpy(np.int64)[order], p["weight"].to_numpy(np.int64)[order], Tree(unit, table[order])))
        if one:
            sides = sides[:1] * 2
        if len(sides) < 2:
            return pd.DataFrame({"id": [], "links": [], "a": [], "b": []}).astype("int64")
        got_a, got_b, edges = link_blocks(*sides[0], *sides[1], limit, cosine, one)
        total = got_a + got_b if one else np.concatenate([got_a, got_b])
        ids = sides[0][0] if one else np.concatenate([sides[0][0], sides[1][0]])
        left, right = _forest(edges)
        some = total > 0
        columns = {"id": ids[some], "links": total[some], "a": left, "b": right}
        n, m = int(some.sum()), len(left)
        out = {}
        for name, values in columns.items():  # two kinds of rows; the other kind's columns are null
            mask = np.arange(n + m) >= n if name in ("id", "links") else np.arange(n + m) < n
            whole = np.zeros(n + m, np.int64)
            whole[~mask] = values
            out[name] = pd.arrays.IntegerArray(whole, mask)
        return pd.DataFrame(out)

    return run


def _usable(vector) -> F.Column:
    v = F.transform(vector, lambda x: x.cast("double"))
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & (total > 0), F.lit(False))


def near_vectors(table: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Links are pairs of rows with a cosine of at least ``cosine`` (over 0.5) in
    double precision. Vectors that are null, zero, empty or hold null or
    non-finite components link with nothing; neither do vectors of different
    length. Equal vectors are links of one another; repeated rows count as rows
    of their own. A null id counts as a link but names no component, unless it
    stands alone. A cosine of exactly ``cosine`` is a link. Other columns are not read; an
    empty table gives an empty result.
    """
    spark = table.sparkSession
    store = Written(spark)
    limit = float(np.sqrt(2.0 - 2.0 * cosine))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("ok", _usable(F.col("vector"))).withColumn("vector", F.when(F.col("ok"), F.col("vector")))
    rows = rows.withColumn("id", F.when(F.col("ok"), F.xxhash64(F.col("vector"))))
    points = store.write(rows.where("ok").groupBy("id").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"),
    ))
    counts, edges = None, None
    for r in points.select(F.size("vector").alias("dim")).distinct().collect():
        own = points.where(F.size("vector") == r["dim"]).select("id", "weight", "vector")
        got = _links_of(own, limit, cosine, store)
        counts = got if counts is None else counts.unionByName(got)
    nodes = points.select(F.col("id").alias("node"))
    if counts is None:
        counts = spark.createDataFrame([], "id long, links long, a long, b long")
    edges = counts.where("a is not null").select("a", "b")
    parts = components(nodes, edges, store)
    links = counts.where("id is not null").groupBy("id").agg(F.sum("links").alias("links"))
    known = points.select("id", "least", "weight").join(parts.select(F.col("node").alias("id"), "component"), "id").join(links, "id", "left")
    names = known.groupBy("component").agg(F.min("least").alias("component_id"))
    full = known.join(names, "component").select("id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "id").join(full, "id", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links_of(points: DataFrame, limit: float, cosine: float, store: Written) -> DataFrame:
    """Counts and joining pairs among points of one dimension."""
    n = points.count()
    want = int(min(CENTRES, -(-n // BLOCK)))
    # a bounded sample, spread by the hash that names a point
    share = min(1.0, SAMPLE / n)
    picked = points.where(F.pmod("id", F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("vector").limit(2 * SAMPLE).toPandas()
    if not len(picked):
        picked = points.select("vector").limit(1).toPandas()
    sample, _ = _unit(np.stack(picked["vector"].to_numpy()))
    centres = sample[farthest_first(sample, want)]
    vector = points.schema["vector"].dataType.simpleString()
    placed = store.write(points.select("id", "weight", "vector").mapInArrow(_assign(centres), f"id long, weight long, vector {vector}, cell int, away double"))
    top = {r["cell"]: r for r in placed.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    radius = np.array([top[k]["radius"] if k in top else -10.0 for k in range(len(centres))])
    blocks = np.array([-(-top[k]["n"] // BLOCK) if k in top else 0 for k in range(len(centres))], np.int64)
    count = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("cell") + 1)
    dealt = placed.select("id", "weight", "vector", "cell", F.pmod(F.xxhash64("id"), count).cast("int").alias("block"))
    shape = f"id long, weight long, vector {vector}, cell int, block int, levels array<int>"
    trees = store.write(dealt.repartition(widths(points.sparkSession), "cell", "block").groupBy("cell", "block").applyInPandas(_block(limit), shape))
    sent = trees.mapInArrow(
        _send(centres, radius, blocks, limit),
        f"c1 int, b1 int, c2 int, b2 int, second boolean, id long, weight long, vector {vector}, levels array<int>",
    )
    keys = ["c1", "b1", "c2", "b2"]
    return store.write(
        sent.repartition(widths(points.sparkSession), *keys).groupBy(*keys).applyInPandas(_join(limit, cosine), "id long, links long, a long, b long")
    )
