"""Packing of token pieces into sequences by a grouping genetic algorithm.

Pieces that fill a sequence stay alone. The others are dealt by a hash into
blocks of about ``BLOCK`` items, each a bin-packing problem of bounded size.
A block whose best-fit-decreasing packing meets the lower bound is done; else it
lives on several islands. An individual is a set of bins; crossover injects
whole well-filled bins of one parent into the other, drops the bins that share
an item with them, and puts the displaced items back by best fit. After each
epoch the best individual of an island moves to the next island of its block.
A block ends when it meets its bound or an epoch brings nothing.

Bins of a block that are not well filled are opened again, and their items meet
those of other blocks on the next level, until one block is left or the items no
longer get fewer.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.taskcontext import TaskContext

from honeyframe.llm.common import ROW_BITS, Written, widths
from honeyframe.llm.encoding import WordEncoder, kept

BLOCK, ISLANDS, POPULATION, GENERATIONS = 8192, 3, 4, 24
#: A bin this full is worth injecting, and is not opened again.
FULL = 0.99


class Bins:
    """Bins by their free space; best fit by the lowest set bit of a mask."""

    def __init__(self, capacity: int):
        self.mask, self.at = 0, [[] for _ in range(capacity + 1)]
        self.capacity, self.count = capacity, 0

    def add(self, bin_: int, free: int) -> None:
        if free:
            self.at[free].append(bin_)
            self.mask |= 1 << free

    def place(self, size: int) -> int:
        above = self.mask >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            slots = self.at[free]
            bin_ = slots.pop()
            if not slots:
                self.mask ^= 1 << free
        else:
            bin_, free = self.count, self.capacity
            self.count += 1
        self.add(bin_, free - size)
        return bin_


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item when the items come in ``order``."""
    bins, out = Bins(capacity), np.zeros(len(sizes), np.int32)
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        out[i] = bins.place(s)
    return out


def fitness(assign: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Bins, then minus the mean square of their filling: smaller is better."""
    fill = np.bincount(assign, sizes) / capacity
    return len(fill), -float((fill * fill).mean())


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Child of ``a`` with some whole well-filled bins of ``b``."""
    full = np.flatnonzero(np.bincount(b, sizes) >= FULL * capacity)
    if not len(full):
        return a
    chosen = rng.choice(full, size=min(len(full), 1 + int(rng.integers(0, max(1, len(full) // 20) + 1))), replace=False)
    injected = np.isin(b, chosen)
    hit = np.zeros(a.max() + 1, bool)
    hit[a[injected]] = True
    displaced = np.flatnonzero(hit[a] & ~injected)
    keep = ~hit[a]
    child = np.full(len(a), -1, np.int32)
    _, child[keep] = np.unique(a[keep], return_inverse=True)
    n = int(child.max(initial=-1)) + 1
    _, own = np.unique(b[injected], return_inverse=True)
    child[injected] = n + own
    bins = Bins(capacity)
    placed = child >= 0
    fill = np.bincount(child[placed], sizes[placed]).astype(int)
    for k, f in enumerate(fill.tolist()):
        bins.add(k, capacity - f)
    bins.count = len(fill)
    for i in displaced[np.argsort(-sizes[displaced], kind="stable")].tolist():
        child[i] = bins.place(int(sizes[i]))
    return child


def bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: by volume, and by items of over half a bin."""
    return max(-(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))


_STATE = "block long, island int, uids binary, sizes binary, people binary, best int, quality double, elite binary, done boolean"


def _rows(state: list) -> pd.DataFrame:
    return pd.DataFrame(state, columns=[c.split()[0] for c in _STATE.split(", ")])


def _seed(capacity: int):
    """First individuals of a block: one island if it is solved already."""

    def run(key, pdf):
        pdf = pdf.sort_values("uid", kind="stable")
        sizes, uids = pdf["length"].to_numpy(np.int32), pdf["uid"].to_numpy(np.int64)
        block = int(key[0])
        first = best_fit(sizes, np.argsort(-sizes, kind="stable"), capacity)
        best, quality = fitness(first, sizes, capacity)
        done = best <= bound(sizes, capacity)
        out = []
        for island in range(1 if done else ISLANDS):
            rng = np.random.default_rng([block & 0xFFFFFFFF, island])
            people = [first] if done or island == 0 else []
            while not done and len(people) < POPULATION:
                people.append(best_fit(sizes, np.argsort(-sizes * rng.uniform(0.7, 1.0, len(sizes))), capacity))
            lead = min(people, key=lambda p: fitness(p, sizes, capacity))
            best, quality = fitness(lead, sizes, capacity)
            out.append((block, island, uids.tobytes(), sizes.tobytes(), np.stack(people).tobytes(), best, quality, lead.tobytes(), done))
        return _rows(out)

    return run


def _evolve(capacity: int, epoch: int):
    """One epoch of each island, its guest included."""

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                sizes = np.frombuffer(r.sizes, np.int32)
                rng = np.random.default_rng([int(r.block) & 0xFFFFFFFF, int(r.island), epoch])
                people = list(np.frombuffer(r.people, np.int32).reshape(-1, len(sizes)))
                people.append(np.frombuffer(r.guest, np.int32))
                ranked = sorted(((fitness(p, sizes, capacity), k) for k, p in enumerate(people)))
                people = [people[k] for _, k in ranked[:POPULATION]]
                marks = [f for f, _ in ranked[:POPULATION]]
                least = bound(sizes, capacity)
                for _ in range(GENERATIONS):
                    i, j = rng.choice(len(people), 2, replace=False)
                    child = crossover(people[i], people[j], sizes, capacity, rng)
                    mark = fitness(child, sizes, capacity)
                    worst = max(range(len(people)), key=marks.__getitem__)
                    if mark < marks[worst]:
                        people[worst], marks[worst] = child, mark
                    if min(marks)[0] <= least:
                        break
                lead = min(range(len(people)), key=marks.__getitem__)
                best, quality = marks[lead]
                out.append((r.block, r.island, r.uids, r.sizes, np.stack(people).tobytes(), best, quality, people[lead].tobytes(), best <= least))
            yield _rows(out)

    return run


def _solution(capacity: int):
    def run(frames):
        for pdf in frames:
            for block, uids, sizes, elite in zip(pdf["block"], pdf["uids"], pdf["sizes"], pdf["elite"]):
                u, s, a = np.frombuffer(uids, np.int64), np.frombuffer(sizes, np.int32), np.frombuffer(elite, np.int32)
                order = np.argsort(a, kind="stable")
                a, s, u = a[order], s[order], u[order]
                ends = np.cumsum(s)
                fill = np.bincount(a, s).astype(np.int64)
                before = np.concatenate([[0], np.cumsum(fill)[:-1]])
                yield pd.DataFrame({"uid": u, "length": s, "block": block, "bin": a, "offset": ends - s - before[a], "fill": fill[a]})

    return run


def pack_items(items: DataFrame, capacity: int, store: Written) -> DataFrame:
    """``uid, length`` (below the capacity) to ``uid, sequence_id, offset``."""
    spark = items.sparkSession
    done, level = None, 0
    items = store.write(items)
    count = items.count()
    while count:
        blocks = -(-count // BLOCK)
        state = store.write(
            items.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks))).repartition(min(blocks, widths(spark)), "block")
            .groupBy("block").applyInPandas(_seed(capacity), _STATE)
        )
        solved, epoch = state.where("done"), 0
        state = state.where("not done")
        while not state.isEmpty():
            guests = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("guest"))
            was = state.groupBy("block").agg(F.min("best").alias("was"), F.min_by("quality", F.struct("best", "quality")).alias("was_quality"))
            grown = store.write(state.join(guests, ["block", "island"]).mapInPandas(_evolve(capacity, epoch), _STATE))
            now = grown.groupBy("block").agg(
                F.min("best").alias("now"), F.min_by("quality", F.struct("best", "quality")).alias("now_quality"), F.max("done").alias("met"),
            )
            # an island is stopped where no island of its block has won a bin
            ends = store.write(now.join(was, "block").select("block", (F.col("met") | (F.col("now") >= F.col("was"))).alias("ends")))
            solved = solved.unionByName(grown.join(ends.where("ends"), "block", "left_semi"))
            state = grown.join(ends.where("not ends"), "block", "left_semi")
            epoch += 1
        best = solved.groupBy("block").agg(F.min_by(F.struct("uids", "sizes", "elite"), F.struct("best", "quality", "island")).alias("s")).select("block", "s.*")
        placed = store.write(best.mapInPandas(_solution(capacity), "uid long, length int, block long, bin int, offset long, fill long"))
        again = placed.where(F.col("fill") < FULL * capacity).select("uid", "length")
        left = again.count() if blocks > 1 else 0
        if left > 0.9 * count:  # opening them again would not bring them together
            left = 0
        settled = placed if not left else placed.where(F.col("fill") >= FULL * capacity)
        numbered = settled.select("uid", (F.lit(level << 56) + F.col("block") * (1 << 16) + F.col("bin")).alias("sequence_id"), "offset")
        done = numbered if done is None else done.unionByName(numbered)
        items, count, level = again, left, level + 1
    return done if done is not None else spark.createDataFrame([], "uid long, sequence_id long, offset long")


def _pieces(tokenizer: str, capacity: int, end_id: int):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("uid", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ])

    def run(batches):
        enc = kept(WordEncoder, tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        uid = TaskContext.get().partitionId() << ROW_BITS
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                s, out = b.slice(lo, 2000), []
                for d, ids in zip(s.column(0).to_pylist(), enc.encode(s.column(1))):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        out.append((d, uid, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and the end id; only documents of more than the
    capacity are cut. A null text is the end id alone. Rows that repeat an id
    are packed one by one; null ids are kept; other columns are not read; an
    empty table gives an empty result.
    """
    store = Written(docs.sparkSession)
    pieces = store.write(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id long, uid long, piece int, start long, length long, ids_crc32 long")
    )
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = pieces.where(F.col("length") < capacity)
    packed = rest.join(pack_items(rest.select("uid", F.col("length").cast("int").alias("length")), capacity, store), "uid")
    return full.unionByName(packed).drop("uid")
