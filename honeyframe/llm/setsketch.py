"""Near-duplicate links of documents by SetSketch registers.

1. A document's set of word shingles becomes ``M`` registers. Register i holds
   ``1 - log_b`` of the smallest of its exponential hash values, rounded down
   and clipped to 16 bits: truncated minima with exponential spacing. Sketches
   of parts merge by the maximum of each register.
2. Documents with one and the same set are one class (equal digest of the sorted
   set) and are linked at once.
3. Registers are banded; a class meets others that agree on all registers of a
   band. In a bucket the classes meet its leader, the class that meets most
   others in all its bands. The similarity of such a pair is first estimated by
   maximum likelihood from the registers that are larger, smaller and equal;
   what is far below the limit is dropped, the rest is verified on the full sets.
4. Buckets that are not one component after this are taken whole, in blocks of
   a bounded number of classes: within a task their pairs of different components are verified
   until no pair is left, most similar first. No pair leaves the task but those
   that link two components, fewer than the classes of the bucket.
5. Components follow from the verified links.

The chance that a pair at the limit agrees on no band is (1 - J**r)**bands. Bands
are 30 of 6 registers for limits from 0.85 on (6.8e-7 at 0.85), and below as short
as keeps the chance under 1e-6 (36 of 5 for 0.80: 6.2e-7).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from honeyframe.llm.common import Written, components, few, widths
from honeyframe.llm.encoding import kept

SHINGLE = 5
M = 180
#: Largest band and chance of a missed pair at the limit.
ROWS, MISSED = 6, 1e-6
#: Base of the register spacing and rate of the hash values.
BASE, RATE = 1.001, 20.0
TOP = (1 << 16) - 1
#: Sets or sketches that a task writes.
WIDE = 2_000
#: Estimates this far below the limit are not verified: about five deviations.
SLACK = 0.14


class Shingler:
    """64-bit hashes of the word shingles of texts."""

    _MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

    def _words(self, text: bytes) -> np.ndarray:
        import xxhash

        words = text.lower().split()  # bytes: A-Z, and the six ASCII spaces
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes; one for the whole of a short text."""
        h = self._words((text or "").encode())
        if not len(h):
            return h
        k = min(len(h), SHINGLE)
        n = len(h) - k + 1
        s = np.full(n, k, np.uint64)
        for j in range(k):
            s = (s ^ (h[j : j + n] * self._MIX[j])) * self._MIX[4]
            s ^= s >> np.uint64(29)
        return np.unique(s)


def _affine() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 32, M, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, M, np.uint32)


_A, _B = _affine()


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch of a set: unsigned 16-bit registers, zeros for no element."""
    if not len(shingles):
        return np.zeros(M, np.uint16)
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    low = np.full(M, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(folded), 1024):
        x = _A[:, None] * folded[None, i : i + 1024]
        x += _B[:, None]
        np.minimum(low, x.min(axis=1), out=low)
    x = -np.log1p(-(low + 0.5) / 2.0**32) / RATE  # smallest of exponential values
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.maximum(a, b)


def estimate(na, nb, larger, smaller) -> np.ndarray:
    """Similarity of pairs by maximum likelihood: set sizes, and the number of
    registers of the first that are larger and smaller than the second's.

    The log likelihood is concave in J, so its slope is bisected.
    """
    u = na / (na + nb)
    v = 1.0 - u
    equal = M - larger - smaller
    c, log_b = (BASE - 1) / BASE, np.log(BASE)
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):
        j = (lo + hi) / 2
        xu, xv = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        pu, pv = -np.log1p(-xu * c) / log_b, -np.log1p(-xv * c) / log_b
        du, dv = -v * c / (1 - xu * c) / log_b, -u * c / (1 - xv * c) / log_b
        slope = larger * du / pu + smaller * dv / pv - equal * (du + dv) / np.maximum(1 - pu - pv, 1e-12)
        up = slope > 0
        lo, hi = np.where(up, j, lo), np.where(up, hi, j)
    return (lo + hi) / 2


def _digest(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(batches):
    s = kept(Shingler)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("sketch", pa.binary())])
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            out = []
            for d, t in zip(part.column(0).to_pylist(), part.column(1)):
                got = s.shingles(t.as_py())
                out.append((d, len(got), _digest(got), registers(got).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _sets(batches):
    s = kept(Shingler)
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            got = [s.shingles(t.as_py()) for t in b.column(1).slice(lo, 512)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(x) for x in got], pa.int64()), pa.array([x.tobytes() for x in got], pa.binary())], names=["c", "shingles"]
            )


def _near(limit: float):
    """Pairs of classes with sketches in; those worth verifying out."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n = b.num_rows
            sa, sb = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(n, M) for i in (4, 5))
            na, nb = (b.column(i).to_numpy().astype(float) for i in (2, 3))
            j = estimate(na, nb, (sa > sb).sum(axis=1), (sa < sb).sum(axis=1))
            ok = (j >= limit - SLACK) & (np.minimum(na, nb) >= limit * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return run


def _is_link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(percent: int):
    def run(batches):
        for b in batches:
            ok = [
                _is_link(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _whole_buckets(percent: int):
    """All pairs of different components in the blocks of one bucket."""
    limit = percent / 100

    def run(key, pdf):
        ids, comp = pdf["c"].to_numpy(), pdf["component"].to_numpy()
        sides, sizes = pdf["side"].to_numpy(), pdf["n"].to_numpy().astype(float)
        sketches = np.frombuffer(b"".join(pdf["sketch"]), np.uint16).reshape(len(pdf), M)
        root = {c: c for c in comp.tolist()}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        found = []
        one_block = key[-1] == key[-2]
        left = np.flatnonzero(sides == 0)
        for i in left.tolist():
            others = np.arange(i + 1, len(pdf)) if one_block else np.flatnonzero(sides == 1)
            others = others[comp[others] != comp[i]]
            if not len(others):
                continue
            a, rest = sketches[i], sketches[others]
            j = estimate(np.full(len(others), sizes[i]), sizes[others], (a > rest).sum(axis=1), (a < rest).sum(axis=1))
            near = np.flatnonzero((j >= limit - SLACK) & (np.minimum(sizes[i], sizes[others]) >= limit * np.maximum(sizes[i], sizes[others])))
            for k in near[np.argsort(-j[near])].tolist():
                o = int(others[k])
                x, y = find(comp[i]), find(comp[o])
                if x != y and _is_link(np.frombuffer(pdf["shingles"].iat[i], np.uint64), np.frombuffer(pdf["shingles"].iat[o], np.uint64), percent):
                    root[x] = y
                    found.append((ids[i], ids[o]))
        import pandas as pd

        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def band_rows(percent: int) -> int:
    """Registers of a band: the most that miss a pair at the limit rarely enough."""
    return next((r for r in range(ROWS, 1, -1) if (1 - (percent / 100) ** r) ** (M // r) <= MISSED), 1)


def _bands(size: int) -> Column:
    """Array of band values, one long each."""
    return F.array(*[F.xxhash64(F.lit(k), F.substring("sketch", 2 * size * k + 1, 2 * size)) for k in range(M // size)])


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 1000) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Documents are linked where 100 * intersection >= percent * union of their
    sets. Null, empty and wordless texts have empty sets and no link: they are
    components of their own. A row with a null id takes part like any other; its
    group is named by the other ids, and it is kept only if there are none.
    Repeated rows are linked and share an id. A very long text has a large set, held whole
    by the task that compares it. Other columns are not read; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    store = Written(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = store.write(source.mapInArrow(_sketch, "doc_id long, n long, c long, sketch binary"))
    # one class for each set, known by the digest of the set; a document of it has its text
    classes = store.write(few(rows.where("n > 0").groupBy("c").agg(
        F.min("n").alias("n"), F.min("doc_id").alias("doc_id"), F.min("sketch").alias("sketch"),
    ), rows.count(), WIDE))
    slim = classes.select("c", "n", "sketch")
    size, total = band_rows(percent), classes.count()
    placed = classes.select("c", F.posexplode(_bands(size)).alias("band", "value"))
    buckets = placed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    placed = store.write(few(placed.join(buckets, ["band", "value"]), total * (M // size)))
    popular = placed.groupBy("c").agg(F.sum("met").alias("met_all"))
    leaders = placed.join(popular, "c").groupBy("band", "value").agg(F.max_by("c", F.struct("met_all", "c")).alias("leader"))
    pairs = placed.join(leaders, ["band", "value"]).where("c <> leader").select(F.col("leader").alias("a"), F.col("c").alias("b")).distinct()
    # a place in a bucket is one pair at most
    near = store.write(
        few(pairs.join(slim.toDF("b", "nb", "sb"), "b").join(slim.toDF("a", "na", "sa"), "a"), placed.count(), 10 * WIDE)
        .select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near(percent / 100), "a long, b long")
    )
    sets = _sets_of(source, classes, near.select(F.explode(F.array("a", "b")).alias("c")), store)
    links = store.write(
        few(near.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a").select("a", "b", "x", "y"), near.count(), WIDE)
        .mapInArrow(_verify(percent), "a long, b long")
    )
    store.drop(sets)
    nodes = classes.select(F.col("c").alias("node"))
    first = store.write(components(nodes, links, store))
    more = _rest(source, classes, placed, slim, first, percent, block_rows, store)
    final = components(nodes, links.union(more), store).select(F.col("node").alias("c"), "component")
    # groups are named by their smallest document
    joined = rows.select("doc_id", "n", "c").join(final, "c", "left")
    names = classes.join(final, "c").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return (
        joined.join(names, "component", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _sets_of(source: DataFrame, classes: DataFrame, wanted: DataFrame, store: Written) -> DataFrame:
    """``c, shingles`` of the wanted classes, from the text of one document each."""
    ids = classes.join(wanted.select("c").distinct(), "c").select("doc_id", "c")
    texts = source.join(ids.select("doc_id"), source["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    sets = texts.mapInArrow(_sets, "c long, shingles binary").join(ids.select("c"), "c", "left_semi")
    return store.write(few(sets.dropDuplicates(["c"]), classes.count(), WIDE))


def _rest(
    source: DataFrame, classes: DataFrame, placed: DataFrame, slim: DataFrame, first: DataFrame, percent: int, block_rows: int, store: Written,
) -> DataFrame:
    """Links between components that share a bucket."""
    named = placed.join(first.select(F.col("node").alias("c"), "component"), "c")
    mixed = (
        named.groupBy("band", "value")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("c")).alias("who"))
        .where("lo <> hi")
    )
    # equal lists of classes in several bands need one look
    mixed = mixed.groupBy("size", "lo", "hi", "who").agg(F.min(F.struct("band", "value")).alias("at")).select("at.band", "at.value", "size")
    blocks = F.ceil(F.col("size") / block_rows).cast("int")
    inside = store.write(few(
        named.join(mixed, ["band", "value"])
        .select("band", "value", "c", "component", blocks.alias("blocks"), F.pmod(F.xxhash64("c"), blocks).cast("int").alias("block")), placed.count()
    ))
    if inside.isEmpty():
        return source.sparkSession.createDataFrame([], "a long, b long")
    sets = _sets_of(source, classes, inside.select("c"), store)
    # each block meets itself and every later one
    tasks = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band", "value", "c", "component",
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"),
    )
    full = tasks.join(slim, "c").join(sets, "c")
    return store.write(
        full.repartition(widths(source.sparkSession), "band", "value", "i", "j").groupBy("band", "value", "i", "j")
        .applyInPandas(_whole_buckets(percent), "a long, b long")
    )
