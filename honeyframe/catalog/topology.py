"""Queries on atoms and ring topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from honeyframe import fixtures as X
from honeyframe.catalog import query
from honeyframe.catalog.frames import square
from honeyframe.catalog.views import PT, PX, r6 as S6, with_
from honeyframe.functions.numbers import r6
from honeyframe.operators import atoms as A, topology as T
from honeyframe.session import Buckets, cut_lineage, parts_for

MESH = """cells AS (SELECT o_orderkey AS ring_id, 2 * (o_orderkey % 40) + (o_orderkey // 40) % 2 AS cx, 3 * (o_orderkey // 40) AS cy FROM orders),
c0 AS (SELECT ring_id, s, cx + a AS vx, cy + b AS vy FROM cells, (VALUES (0.0, 0, 2), (1.0, 1, 1), (2.0, 1, -1), (3.0, 0, -2), (4.0, -1, -1), (5.0, -1, 1)) t(s, a, b)),
c1 AS (SELECT * FROM c0 WHERE NOT ((s = 2 AND vx % 20 = 7 AND (vy + 2) % 30 = 13) OR (s = 5 AND vx % 20 = 7 AND vy % 30 = 13))),
c2 AS (SELECT * FROM c1 UNION ALL SELECT ring_id, 2.5, vx, vy - 2 FROM c1 WHERE s = 3 AND vx % 20 = 7 AND vy % 30 = 13
  UNION ALL SELECT ring_id, 5.5, vx, vy + 2 FROM c1 WHERE s = 0 AND vx % 20 = 7 AND (vy + 2) % 30 = 13),
rings AS (SELECT 0 AS view, ring_id, row_number() OVER (PARTITION BY ring_id ORDER BY s) - 1 AS seq, (vy + 10) * 100000 + vx + 10 AS atom_id FROM c2),
atoms AS (SELECT 0 AS view, atom_id, vx * 0.8660254037844386::DOUBLE + CASE WHEN vx % 20 = 7 AND vy % 30 = 13 THEN -0.5 WHEN vx % 20 = 7 AND (vy + 2) % 30 = 13 THEN 0.5 ELSE 0 END AS x,
  (vy + CASE WHEN vx % 20 = 7 AND vy % 30 = 13 THEN -1 WHEN vx % 20 = 7 AND (vy + 2) % 30 = 13 THEN 1 ELSE 0 END) * 0.5::DOUBLE AS y, 0.0::DOUBLE AS z, 1 + (atom_id % 7) / 10.0::DOUBLE AS weight
  FROM (SELECT DISTINCT atom_id, atom_id % 100000 - 10 AS vx, atom_id // 100000 - 10 AS vy FROM rings)),
edges AS (SELECT ring_id, seq, least(atom_id, n) AS a, greatest(atom_id, n) AS b FROM (SELECT *, coalesce(lead(atom_id) OVER w, first_value(atom_id) OVER w) AS n FROM rings WINDOW w AS (PARTITION BY ring_id ORDER BY seq))),
bonds AS (SELECT DISTINCT a, b FROM edges), steps AS (SELECT a AS p, b AS q FROM bonds UNION ALL SELECT b, a FROM bonds),
sides AS (SELECT a, b, min(ring_id) AS r1, max(ring_id) AS r2, count(*) AS n FROM edges GROUP BY a, b),
links AS (SELECT r1 AS r, r2 AS o FROM sides WHERE n = 2 UNION ALL SELECT r2, r1 FROM sides WHERE n = 2),
rsize AS (SELECT ring_id, count(*) AS size FROM rings GROUP BY ring_id),
rin AS (SELECT ring_id, size, coalesce(k, 0) = size AS interior FROM rsize LEFT JOIN (SELECT r, count(DISTINCT o) AS k FROM links GROUP BY r) ON r = ring_id),
deg AS (SELECT p, count(*) AS d FROM steps GROUP BY p)"""


def mesh(spark, sf):
    """atoms, bonds and rings of the stand-in mesh, written once."""
    return tuple(cut_lineage(t(spark, sf)) for t in (X.mesh_atoms, X.mesh_bonds, X.mesh_rings))


# -- points ----------------------------------------------------------------------

@query("knn_candidates", with_(PT, """
d AS (SELECT a.id, b.id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist FROM pt a JOIN pt b ON a.id <> b.id AND a.id % 3 = b.id % 3 AND b.x BETWEEN a.x - 25 AND a.x + 25 AND b.y BETWEEN a.y - 25 AND a.y + 25),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(dist, 9), other) AS place FROM d QUALIFY place <= 6)""", body=f"""
SELECT k.id, k.other, {S6('k.dist')} AS dist, k.place, m.id IS NOT NULL AS mutual FROM k LEFT JOIN k m ON m.id = k.other AND m.other = k.id"""))
def knn_candidates(spark, sf):
    p = X.pt(spark, sf).select((F.col("id") % 3).alias("view"), "id", "x", "y")
    d = T.knn_candidates(p, 6)
    return d.select("id", "other", r6("dist").alias("dist"), "place", "mutual")


@query("bond_atoms")
def bond_atoms(spark, sf):
    a = X.mesh_atoms(spark, sf).select("view", F.col("atom_id").alias("id"), "x", "y")
    return T.bond_atoms(T.knn_candidates(a, 6), 3, max_dist=1.4)


@query("order_neighbors", with_(MESH, body="""
SELECT p, q, row_number() OVER (PARTITION BY p ORDER BY round(atan2(b.y - a.y, b.x - a.x), 9), q) AS place FROM steps JOIN atoms a ON a.atom_id = p JOIN atoms b ON b.atom_id = q"""))
def order_neighbors(spark, sf):
    a, b, _ = mesh(spark, sf)
    return T.order_neighbors(b, a).select("p", "q", "place")


@query("trace_rings", with_(MESH, "s AS (SELECT ring_id, count(*) AS size, sum(atom_id) AS total, min(atom_id) AS low FROM rings GROUP BY ring_id)",
       body="SELECT CAST(low AS BIGINT) AS low, CAST(total AS BIGINT) AS total, size FROM s"))
def trace_rings(spark, sf):
    a, b = cut_lineage(X.mesh_atoms(spark, sf)), cut_lineage(X.mesh_bonds(spark, sf))
    r = T.trace_rings(b, a)
    return r.groupBy("view", F.col("low").alias("name")).agg(
        F.count(F.lit(1)).alias("size"), F.sum("atom_id").alias("total"), F.min("atom_id").alias("low")
    ).select("low", "total", "size")


@query("interior_rings", with_(MESH, body="SELECT ring_id, size, interior FROM rin"))
def interior_rings(spark, sf):
    return T.interior_rings(X.mesh_rings(spark, sf)).select("ring_id", "size", "interior")


@query("interior_flags", with_(MESH, """
ia AS (SELECT s.p, count(*) > 2 AND min(d.d) > 2 AS i FROM steps s JOIN deg d ON d.p = s.q GROUP BY s.p)""", body="""
SELECT 'atom' AS kind, p AS a, p AS b, i AS interior FROM ia UNION ALL SELECT 'bond', a, b, x.d > 2 AND y.d > 2 FROM bonds JOIN deg x ON x.p = a JOIN deg y ON y.p = b
UNION ALL SELECT 'ring', ring_id, ring_id, interior FROM rin"""))
def interior_flags(spark, sf):
    a, b, r = mesh(spark, sf)
    ia = T.interior_atoms(b).select(F.lit("atom").alias("kind"), F.col("atom_id").alias("a"), F.col("atom_id").alias("b"), "interior")
    ib = T.interior_bonds(b).select(F.lit("bond").alias("kind"), "a", "b", "interior")
    ir = T.interior_rings(r).select(F.lit("ring").alias("kind"), F.col("ring_id").alias("a"), F.col("ring_id").alias("b"), "interior")
    return ia.unionByName(ib).unionByName(ir)


@query("dual_edges", with_(MESH, "ri AS (SELECT ring_id, -avg(weight) * (count(*) / 2.0 - 1) AS v FROM rings JOIN atoms USING (atom_id) GROUP BY ring_id)", body=f"""
SELECT r1 AS ring1, r2 AS ring2, s.a, s.b, {S6('x.v')} AS i1, {S6('y.v')} AS i2 FROM sides s JOIN ri x ON x.ring_id = r1 JOIN ri y ON y.ring_id = r2 WHERE n = 2"""))
def dual_edges(spark, sf):
    a, _, r = mesh(spark, sf)
    v = cut_lineage(T.ring_intensity(r, a))
    d = T.dual_edges(r)
    for k in ("1", "2"):
        d = d.join(v.select(F.col("ring_id").alias("ring" + k), r6("intensity").alias("i" + k)), "ring" + k)
    return d.select("ring1", "ring2", "a", "b", "i1", "i2")


@query("ring_census", with_(MESH, body="SELECT size, count(*) AS n FROM rin WHERE interior GROUP BY size"))
def ring_census(spark, sf):
    return T.ring_census(X.mesh_rings(spark, sf)).select("size", "n")


@query("bond_lengths", with_(MESH, """
l AS (SELECT 'bond' AS kind, a, b FROM bonds UNION ALL SELECT DISTINCT 'second', s.p, t.q FROM steps s JOIN steps t ON t.p = s.q WHERE s.p < t.q)""", body=f"""
SELECT kind, a, b, {S6("sqrt((x.x - y.x) ** 2 + (x.y - y.y) ** 2) / CASE kind WHEN 'second' THEN sqrt(3) ELSE 1 END")} AS length FROM l JOIN atoms x ON x.atom_id = a JOIN atoms y ON y.atom_id = b"""))
def bond_lengths(spark, sf):
    a, b, _ = mesh(spark, sf)
    one = T.bond_lengths(b, a).select(F.lit("bond").alias("kind"), "a", "b", "length")
    two = T.second_neighbor_distances(b, a).select(F.lit("second").alias("kind"), "a", "b", "length")
    return one.unionByName(two).select("kind", "a", "b", r6("length").alias("length"))


_SHORT = """sb AS (SELECT a, b FROM bonds UNION ALL SELECT least(p, q2), greatest(p, q2) FROM (SELECT s.p, t.q AS q2 FROM steps s JOIN steps t ON t.p = s.q WHERE s.p < t.q AND (s.p + t.q) % 11 = 0)),
sl AS (SELECT DISTINCT s.a, s.b, sqrt((x.x - y.x) ** 2 + (x.y - y.y) ** 2) AS len, (x.x + y.x) / 2 AS mx, (x.y + y.y) / 2 AS my, x.x AS xa, x.y AS ya, y.x AS xb, y.y AS yb FROM sb s JOIN atoms x ON x.atom_id = a JOIN atoms y ON y.atom_id = b)"""


def _dense_bonds(spark, sf):
    """The bonds with some second neighbours bonded as well."""
    a, b = (cut_lineage(t(spark, sf)) for t in (X.mesh_atoms, X.mesh_bonds))
    s = T.second_neighbor_distances(b, a).filter((F.col("a") + F.col("b")) % 11 == 0)
    return a, cut_lineage(b.unionByName(s.select("view", "a", "b")).distinct())


@query("bond_conflicts", with_(MESH, _SHORT, body="""
SELECT s.a, s.b, t.a AS a2, t.b AS b2 FROM sl s JOIN sl t ON (s.a, s.b) <> (t.a, t.b) AND t.mx BETWEEN s.mx - 1 AND s.mx + 1 AND t.my BETWEEN s.my - 1 AND s.my + 1
WHERE s.len * s.len / 4 > (s.mx - t.mx) ** 2 + (s.my - t.my) ** 2 + 1e-9"""))
def bond_conflicts(spark, sf):
    a, b = _dense_bonds(spark, sf)
    # lengths in units where no two distances tie
    d = T.bond_conflicts(b, a)
    mid = cut_lineage(T.bond_lengths(b, a))
    for p, q in (("a", "b"), ("a2", "b2")):
        d = d.join(mid.select(F.col("a").alias(p), F.col("b").alias(q), F.struct("mx", "my", "length").alias("_" + p)), [p, q])
    gap = F.pow(F.col("_a.mx") - F.col("_a2.mx"), 2) + F.pow(F.col("_a.my") - F.col("_a2.my"), 2)
    return d.filter(F.col("_a.length") * F.col("_a.length") / 4 > gap + 1e-9).select("a", "b", "a2", "b2")


@query("bond_crossings", with_(MESH, _SHORT, """
cr AS (SELECT s.a, s.b, t.a AS a2, t.b AS b2, s.len > t.len AS drop_first, (s.xb - s.xa) * (t.ya - s.ya) - (s.yb - s.ya) * (t.xa - s.xa) AS s1, (s.xb - s.xa) * (t.yb - s.ya) - (s.yb - s.ya) * (t.xb - s.xa) AS s2,
  (t.xb - t.xa) * (s.ya - t.ya) - (t.yb - t.ya) * (s.xa - t.xa) AS t1, (t.xb - t.xa) * (s.yb - t.ya) - (t.yb - t.ya) * (s.xb - t.xa) AS t2 FROM sl s JOIN sl t ON (s.a, s.b) < (t.a, t.b)
  AND s.a NOT IN (t.a, t.b) AND s.b NOT IN (t.a, t.b) AND t.mx BETWEEN s.mx - 3 AND s.mx + 3 AND t.my BETWEEN s.my - 3 AND s.my + 3)""", body="""
SELECT a, b, a2, b2 FROM cr WHERE s1 * s2 < -1e-9 AND t1 * t2 < -1e-9"""))
def bond_crossings(spark, sf):
    a, b = _dense_bonds(spark, sf)
    return T.bond_conflicts(b, a, dual=True).select("a", "b", "a2", "b2")


@query("defect_seeds", with_(MESH, body="""
SELECT atom_id FROM (SELECT atom_id, list_sort(list(size)) AS s FROM rings JOIN rin USING (ring_id) WHERE interior GROUP BY atom_id) WHERE s = [5, 6, 7]"""))
def defect_seeds(spark, sf):
    return T.defect_seeds(X.mesh_rings(spark, sf)).select("atom_id")


PATCH = """pk AS (SELECT o_orderkey AS k, o_orderkey % 2 = 1 AS two, o_custkey AS c, 5 + CAST(o_custkey % 4 = 0 AS INT) AS up, 5 + CAST(o_custkey % 5 = 0 AS INT) AS down FROM orders),
pl AS (SELECT k, 0 AS r, [0, 1] AS head, 10 AS rest, up AS size FROM pk UNION ALL SELECT k, 1, [1, 0], 20, down FROM pk
  UNION ALL SELECT k, 2, [up + 7, 0, CASE WHEN two THEN 2 ELSE 20 END], 30, 5 + c % 4 FROM pk UNION ALL SELECT k, 3, [down + 17, 1, CASE WHEN two THEN 3 ELSE 10 END], 40, 5 + c // 4 % 4 FROM pk
  UNION ALL SELECT k, 4, [2, 0, 20], 50, 5 + c // 2 % 3 FROM pk WHERE two UNION ALL SELECT k, 5, [3, 1, 10], 60, 5 + c // 3 % 3 FROM pk WHERE two),
rings AS (SELECT k * 10 + r AS ring_id, size, i AS seq, k * 100 + CASE WHEN i < len(head) THEN head[i + 1] ELSE rest + i - len(head) END AS atom_id FROM pl, range(8) t(i) WHERE i < size),
atoms AS (SELECT DISTINCT atom_id, atom_id % 100 * 1.5::DOUBLE AS x, atom_id % 100 * 7 % 13 * 0.5::DOUBLE AS y FROM rings),
edges AS (SELECT ring_id, size, least(atom_id, n) AS a, greatest(atom_id, n) AS b FROM (SELECT *, coalesce(lead(atom_id) OVER w, first_value(atom_id) OVER w) AS n FROM rings WINDOW w AS (PARTITION BY ring_id ORDER BY seq))),
deg AS (SELECT p, count(*) AS d FROM (SELECT a AS p, b FROM edges UNION SELECT b, a FROM edges) GROUP BY p),
rate AS (SELECT atom_id, count(*) AS n FROM rings GROUP BY atom_id)"""


@query("defect_patterns", with_(PATCH, """
five AS (SELECT a, b, min(ring_id) AS r1, max(ring_id) AS r2 FROM edges WHERE size = 5 GROUP BY a, b HAVING count(*) = 2 AND (SELECT d FROM deg WHERE p = a) > 2 AND (SELECT d FROM deg WHERE p = b) > 2),
ends AS (SELECT a, b, a AS e, r1, r2 FROM five UNION ALL SELECT a, b, b, r1, r2 FROM five),
far AS (SELECT f.a, f.b, e, any_value(n) AS n, count(*) FILTER (size >= 7) AS big, list(ring_id) FILTER (size <= 5) AS small FROM ends f
  JOIN rings r ON r.atom_id = e AND ring_id NOT IN (r1, r2) JOIN rate USING (atom_id) GROUP BY ALL),
hit AS (SELECT a, b, CASE WHEN bool_and(n = 3 AND big = 1) THEN '7557' WHEN bool_and(n = 4 AND coalesce(len(small), 0) > 0) THEN 'z5' END AS kind FROM far GROUP BY a, b HAVING count(*) = 2),
new AS (SELECT DISTINCT o.a, o.b FROM hit h JOIN far f USING (a, b) JOIN edges o ON f.e IN (o.a, o.b) AND (o.a, o.b) <> (f.a, f.b) AND list_contains(f.small, o.ring_id) WHERE kind = 'z5')""", body="""
SELECT DISTINCT kind, atom_id, 'drop' AS action, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM hit JOIN atoms ON atom_id IN (a, b) WHERE kind IS NOT NULL
UNION ALL SELECT 'z5', NULL, 'add', round((p.x + q.x) / 2, 6), round((p.y + q.y) / 2, 6) FROM new JOIN atoms p ON p.atom_id = a JOIN atoms q ON q.atom_id = b"""))
def defect_patterns(spark, sf):
    """Both kinds, by the rule's own sizes 5 and 7, on patches of many ring sizes."""
    tables = Buckets(spark)
    n = parts_for(X.table(spark, sf, "orders").count(), spark, 10_000)  # an order has about 30 corners
    r = tables.write(X.patch_rings(spark, sf, n), n, "ring_id")
    b = tables.write(T.ring_edges(r).select("view", "a", "b").repartition(n, "view", "a").distinct(), n, "view", "a")
    d = T.defect_patterns(r, b, X.patch_atoms(spark, sf))  # its result is made of written tables
    tables.drop()
    return d.select("kind", "atom_id", "action", r6("x").alias("x"), r6("y").alias("y"))


@query("straight_atoms", with_(MESH, """
tw AS (SELECT p, min(q) AS q1, max(q) AS q2 FROM steps GROUP BY p HAVING count(*) = 2)""", body=f"""
SELECT p AS atom_id, {S6('((b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y)) / sqrt(((b.x - a.x) ** 2 + (b.y - a.y) ** 2) * ((c.x - a.x) ** 2 + (c.y - a.y) ** 2))')} AS cosine
FROM tw JOIN atoms a ON a.atom_id = p JOIN atoms b ON b.atom_id = q1 JOIN atoms c ON c.atom_id = q2"""))
def straight_atoms(spark, sf):
    a, b, _ = mesh(spark, sf)
    return T.straight_atoms(b, a, limit=2.0).select("atom_id", r6("cosine").alias("cosine"))


@query("compact_topology", with_(MESH, """
ka AS (SELECT atom_id FROM atoms WHERE atom_id % 17 <> 0), kb AS (SELECT a, b FROM bonds WHERE a % 17 <> 0 AND b % 17 <> 0),
us AS (SELECT a AS atom_id FROM kb UNION SELECT b FROM kb), nm AS (SELECT atom_id, row_number() OVER (ORDER BY atom_id) - 1 AS n FROM us),
torn AS (SELECT DISTINCT e.ring_id FROM edges e ANTI JOIN kb ON kb.a = e.a AND kb.b = e.b)""", body="""
SELECT 'atom' AS kind, atom_id AS a, n AS b FROM nm UNION ALL SELECT 'bond', x.n, y.n FROM kb JOIN nm x ON x.atom_id = a JOIN nm y ON y.atom_id = b
UNION ALL SELECT 'ring', ring_id, n FROM rings JOIN nm USING (atom_id) WHERE ring_id NOT IN (SELECT ring_id FROM torn)"""))
def compact_topology(spark, sf):
    a, b, r = mesh(spark, sf)
    na, nb, nr = T.compact_topology(a.filter(F.col("atom_id") % 17 != 0), b, r)
    out = na.select(F.lit("atom").alias("kind"), F.col("atom_id").alias("a"), F.col("new_id").alias("b"))
    out = out.unionByName(nb.select(F.lit("bond").alias("kind"), "a", "b"))
    return out.unionByName(nr.select(F.lit("ring").alias("kind"), F.col("ring_id").alias("a"), F.col("atom_id").alias("b")))


def signatures(spark, sf):
    a, _, r = mesh(spark, sf)
    return T.ring_signature(r, a, T.defect_seeds(r))


_TURN = "(({x}) - 2 * pi() * floor(({x}) / (2 * pi())))"


@query("ring_signature", "WITH RECURSIVE " + MESH.replace("rings AS (", "rings AS MATERIALIZED (").replace("links AS (", "links AS MATERIALIZED (").replace("rin AS (", "rin AS MATERIALIZED (") + """,
seeds AS (SELECT atom_id AS seed FROM (SELECT atom_id, list_sort(list(size)) AS s FROM rings JOIN rin USING (ring_id) WHERE interior GROUP BY atom_id) WHERE s = [5, 6, 7]),
walk(seed, level, now, before) AS (
  SELECT seed, 0, list(ring_id), []::BIGINT[] FROM seeds JOIN rings ON atom_id = seed GROUP BY seed
  UNION ALL SELECT seed, level + 1, list(DISTINCT o), now FROM (
    SELECT seed, level, now, before, unnest(now) AS r FROM walk WHERE NOT EXISTS (SELECT 1 FROM rin WHERE NOT interior AND list_contains(now, ring_id))) w
    JOIN links USING (r) WHERE NOT list_contains(now, o) AND NOT list_contains(before, o) GROUP BY seed, level, now, before),
cen AS (SELECT ring_id, avg(x) AS x, avg(y) AS y FROM rings JOIN atoms USING (atom_id) GROUP BY ring_id),
ang AS MATERIALIZED (SELECT seed, level, w.ring_id, size, interior, atan2(c.y - a.y, c.x - a.x) AS t FROM (SELECT seed, level, unnest(now) AS ring_id FROM walk) w
  JOIN rin USING (ring_id) JOIN cen c USING (ring_id) JOIN atoms a ON a.atom_id = seed),
st AS (SELECT seed, l[1].t AS t0, l[2].t AS t1 FROM (SELECT seed, list_sort(list({'size': size, 't': round(t, 9)})) AS l FROM ang WHERE level = 0 GROUP BY seed)),
od AS (SELECT seed, level, ring_id, size, interior, CASE WHEN level = 0 THEN size ELSE round(""" + _TURN.format(x="CASE WHEN " + _TURN.format(x="t1 - t0") + " <= pi() THEN 1 ELSE -1 END * (t - t0) + 1e-7") + """, 6) END AS k FROM ang JOIN st USING (seed)),
ln AS (SELECT seed, level, string_agg(CAST(size AS VARCHAR), '-' ORDER BY k, ring_id) AS line, bool_and(interior) AS inside FROM od GROUP BY seed, level),
en AS (SELECT seed, min(level) AS stop FROM ln WHERE NOT inside GROUP BY seed)
SELECT 0 AS view, seed, level, line FROM ln LEFT JOIN en USING (seed) WHERE stop IS NULL OR level < stop""")
def ring_signature(spark, sf):
    return signatures(spark, sf)


# signature-like lines from the report: the first lines depend on the seed
SIGNATURES = """sg AS (SELECT 0 AS view, o_orderkey AS seed, l AS level, CASE WHEN l = 0 THEN '5-6-7' WHEN l = 1 THEN concat('6-6-', CASE WHEN o_custkey % 3 = 0 THEN 6 ELSE 5 END, '-6')
   ELSE concat_ws('-', 5 + o_custkey % 2, 6, 6, 5 + o_orderkey % 3) END AS line FROM orders, range(4) t(l)),
ot AS (SELECT l AS level, CASE WHEN l = 0 THEN '5-6-7' WHEN l = 1 THEN '6-6-6-6' ELSE '5-6-6-6' END AS line FROM range(4) t(l)),
al AS (SELECT seed, sg.level, sg.line, min(CAST(sg.line = ot.line AS INT)) OVER (PARTITION BY seed ORDER BY sg.level) AS ok FROM sg JOIN ot ON ot.level = sg.level),
sc AS (SELECT seed, sum(CASE WHEN ok = 1 THEN (1 + len(string_split(line, '-'))) / 2.0 ELSE 0 END) AS score FROM al GROUP BY seed)"""


def signature_lines(spark, sf):
    o = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seed"), "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("level"))
    n, c, s = F.col("level"), F.col("o_custkey"), F.col("seed")
    line = F.when(n == 0, "5-6-7").when(n == 1, F.concat(F.lit("6-6-"), F.when(c % 3 == 0, "6").otherwise("5"), F.lit("-6"))).otherwise(
        F.concat_ws("-", (5 + c % 2).cast("string"), F.lit("6"), F.lit("6"), (5 + s % 3).cast("string")))
    return o.select(F.lit(0).alias("view"), "seed", "level", line.alias("line"))


@query("match_signatures", "WITH " + SIGNATURES + "\nSELECT seed, score::DOUBLE AS score, row_number() OVER (ORDER BY score DESC, seed) = 1 AS best FROM sc")
def match_signatures(spark, sf):
    n = F.col("level")
    mine = signature_lines(spark, sf)
    other = mine.select("level").distinct().withColumn("line", F.when(n == 0, "5-6-7").when(n == 1, "6-6-6-6").otherwise("5-6-6-6"))
    return T.match_signatures(mine, other).select("seed", F.col("score"), "best")


# views are tiles of 8 x 8 cells; their atom ids are shifted
_SHIFT = 1_000_000_000_000


@query("merge_views", with_(MESH, f"""
tl AS (SELECT *, 1 + (ring_id % 40) // 8 + 5 * ((ring_id // 40) // 8) AS v FROM rings),
st AS (SELECT DISTINCT v FROM tl WHERE ring_id % 8 = 3 AND (ring_id // 40) % 8 = 3)""", body=f"""
SELECT DISTINCT tl.v AS view, atom_id + {_SHIFT} AS atom_id, st.v IS NULL AS is_new, CASE WHEN st.v IS NOT NULL THEN atom_id END AS master FROM tl LEFT JOIN st ON st.v = tl.v"""))
def merge_views(spark, sf):
    """Every tile of the mesh is a view that joins the whole mesh from the ring
    in its middle; a tile without that ring only brings new atoms."""
    a, r = cut_lineage(X.mesh_atoms(spark, sf)), cut_lineage(X.mesh_rings(spark, sf))
    row, c = F.floor(F.col("ring_id") / 40), F.col("ring_id") % 40
    tile = (1 + F.floor(c / 8) + 5 * F.floor(row / 8)).alias("view")
    vr = cut_lineage(r.select(tile, "ring_id", "seq", (F.col("atom_id") + _SHIFT).alias("atom_id")))
    va = vr.select("view", "atom_id").distinct().withColumn("_m", F.col("atom_id") - _SHIFT).join(
        a.select(F.col("atom_id").alias("_m"), "x", "y"), "_m").drop("_m")
    mid = (F.col("ring_id") % 8 == 3) & (row % 8 == 3) & (F.col("seq") < 2)
    start = vr.filter(mid).select("view", "atom_id", (F.col("atom_id") - _SHIFT).alias("master"))
    links, _ = T.merge_views(a, r, va, vr, start)
    return links.select("view", "atom_id", "is_new", F.when(~F.col("is_new"), F.col("master")).alias("master"))


# -- atoms in frames -----------------------------------------------------------------

KERNEL = A.gaussian_kernel(1.8, 1)
_K = f"kn(dx, dy, k) AS (VALUES {', '.join(f'({a}, {b}, {k!r}::DOUBLE)' for a, b, k in KERNEL)})"
_AT = "ato AS (SELECT frame_id, q AS x, r AS y, value / 2.0::DOUBLE AS weight FROM px WHERE value >= 5)"


def frame_atoms(spark, sf):
    return square(spark, sf).filter(F.col("value") >= 5).select("frame_id", "x", "y", (F.col("value") / F.lit(2.0)).alias("weight"))


@query("render_atoms", with_(PX, _K, _AT, """
ad AS (SELECT frame_id, x + dx AS x, y + dy AS y, sum(weight * k) AS m FROM ato, kn GROUP BY ALL)""", body=f"""
SELECT p.frame_id, q AS x, r AS y, {S6('0.5 + coalesce(m, 0)')} AS model FROM px p LEFT JOIN ad ON ad.frame_id = p.frame_id AND ad.x = q AND ad.y = r"""))
def render_atoms(spark, sf):
    d = A.render_atoms(square(spark, sf), frame_atoms(spark, sf), KERNEL, 8, 8, 0.5)
    return d.select("frame_id", "x", "y", r6("model").alias("model"))


@query("render_atoms_periodic", with_(PX, _K, _AT, """
ad AS (SELECT frame_id, (x + dx + 8) % 8 AS x, (y + dy + 8) % 8 AS y, sum(weight * k) AS m FROM ato, kn GROUP BY ALL)""", body=f"""
SELECT p.frame_id, q AS x, r AS y, {S6('coalesce(m, 0)')} AS model FROM px p LEFT JOIN ad ON ad.frame_id = p.frame_id AND ad.x = q AND ad.y = r"""))
def render_atoms_periodic(spark, sf):
    d = A.render_atoms(square(spark, sf), frame_atoms(spark, sf), KERNEL, 8, 8, periodic=True)
    return d.select("frame_id", "x", "y", r6("model").alias("model"))


@query("residual_peaks", with_(PX, "rs AS (SELECT frame_id, q AS x, r AS y, value - 3 AS value FROM px WHERE value < 7)", body="""
SELECT frame_id, arg_max(x, (abs(value), -y, -x)) AS x, arg_max(y, (abs(value), -y, -x)) AS y, arg_max(value, (abs(value), -y, -x)) AS value FROM rs GROUP BY frame_id"""))
def residual_peaks(spark, sf):
    p = square(spark, sf).select("frame_id", "x", "y", (F.col("value") - 3).alias("value"))
    return A.residual_peaks(p, p.filter(F.col("value") >= 4))


@query("find_atoms")
def find_atoms(spark, sf):
    atoms, _ = A.find_atoms(square(spark, sf), KERNEL, 2, 8, 8, floor=1.0, min_weight=0.5)
    return atoms


@query("nudge_atoms")
def nudge_atoms(spark, sf):
    p = square(spark, sf)
    a = frame_atoms(spark, sf)
    m = A.render_atoms(p, a, KERNEL, 8, 8)
    res = p.join(m, ["frame_id", "x", "y"]).select("frame_id", "x", "y", (F.col("value") - F.col("model")).alias("value"))
    atoms, _ = A.nudge_atoms(a, res, KERNEL, 1, 2, 8, 8)
    return atoms


_SW = [1.2, 1.8, 2.6]


def _sweep_sql():
    parts = " UNION ALL ".join(
        f"SELECT {w}::DOUBLE AS fwhm, dx, dy, k FROM (VALUES {', '.join(f'({a}, {b}, {k!r}::DOUBLE)' for a, b, k in A.gaussian_kernel(w, 1))}) t(dx, dy, k)" for w in _SW)
    return with_(PX, _AT, f"kw AS ({parts})", """
rd AS (SELECT p.frame_id, f.fwhm, p.q, p.r, p.value, coalesce(m, 0) AS model FROM px p CROSS JOIN (SELECT DISTINCT fwhm FROM kw) f LEFT JOIN
  (SELECT frame_id, fwhm, x + dx AS x, y + dy AS y, sum(weight * k) AS m FROM ato, kw GROUP BY ALL) a ON a.frame_id = p.frame_id AND a.fwhm = f.fwhm AND a.x = p.q AND a.y = p.r),
cc AS (SELECT frame_id, fwhm, coalesce(CASE WHEN stddev_pop(value) * stddev_pop(model) > 1e-12 THEN corr(value, model) END, 0) AS c FROM rd GROUP BY ALL),
bw AS (SELECT frame_id, arg_max(fwhm, (round(c, 9), -fwhm)) AS fwhm, max(c) AS corr FROM cc GROUP BY frame_id),
vv AS (SELECT frame_id, fwhm, corr, s AS scale, var_pop(value - s * model) AS v FROM rd JOIN bw USING (frame_id, fwhm), (VALUES (0.5::DOUBLE), (1.0), (1.5), (2.0)) t(s) GROUP BY ALL)""", body=f"""
SELECT frame_id, fwhm, {S6('any_value(corr)')} AS corr, arg_min(scale, (round(v, 9), scale)) AS scale, {S6('min(v)')} AS variance FROM vv GROUP BY frame_id, fwhm""")


@query("sweep_kernel", _sweep_sql())
def sweep_kernel(spark, sf):
    d = A.sweep_kernel(square(spark, sf), frame_atoms(spark, sf), _SW, 1, 8, 8, [0.5, 1.0, 1.5, 2.0])
    return d.select("frame_id", "fwhm", r6("corr").alias("corr"), "scale", r6("variance").alias("variance"))
