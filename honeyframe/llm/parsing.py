"""Byte strings that repeat anywhere in a corpus, by prefix-free parsing.

A place is a *trigger* if a rolling hash of the ``WIDTH`` bytes from it on is small.
A *phrase* reaches from a trigger to the end of the next trigger's bytes, so no phrase
is the beginning of another, and equal bytes are cut in equal phrases wherever
they stand. A string of ``LEAST`` bytes is the rest of a phrase up to its first
trigger, some whole phrases, and the beginning of another phrase.

1. Texts lie in written blocks. A first pass only asks which phrases occur again
   (by a digest, which may let too many pass). A string with a phrase that occurs
   once occurs once; texts in which all strings do are finished.
2. The *dictionary* is sorted: the rank of a phrase is its place among the distinct
   phrases that repeat, compared byte by byte.
3. The suffix order of the *parse* is made by prefixes that grow fourfold: ranks of
   four neighbours are ranks of 4, 16, ... phrases, as long as these fit in a string.
   A place whose phrases occur once has no rank and takes no further part.
4. Both combine into the order of the corpus: a place is ordered by the rest of its
   phrase, the ranks of the phrases that follow (up to four ranges that overlap), and
   the bytes after them. Equal neighbours in that order are places of one string.
   Triggers and text ends come first. Between two of these that both repeat and are
   no further apart than a string nothing can be added. Other places between are
   *open* and ordered too, and with them all places elsewhere that stand before the
   same phrase; of closed gaps with one text, one stands for all.

All steps send one row for a key and block, with the places of the key in it, so a
frequent phrase is at most one row for each block. Ranks come back by joins; places are
shuffled and sorted once, and equal neighbours repeat. Keys of step 4 are 128-bit digests of what is named above,
made for all places of a block at once from running sums.
Rounds end when no two neighbouring ranges fit in a string.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.taskcontext import TaskContext

from honeyframe.llm.common import ROW_BITS, Written

LEAST, WIDTH, EVERY = 400, 16, 40
STEP = 4
BLOCK = 1 << 22

_TABLE = np.random.default_rng(40).integers(0, 1 << 32, 256, dtype=np.uint32)
_BLOCK = "block long, ids array<long>, sizes binary, data binary"
_KEEP = "live boolean, block long, ids array<long>, sizes binary, data binary, alive binary"
_PARSE = "block long, ends binary, at binary, levels array<binary>"
_OUT = "doc_id long, n_bytes long, spans array<struct<start:long,length:long>>, kept binary"
_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])


def triggers(data: np.ndarray, piece: int = 1 << 15) -> np.ndarray:
    """Places whose ``WIDTH`` bytes have a small rolling hash."""
    out = [np.zeros(0, np.int64)]
    for lo in range(0, max(len(data) - WIDTH + 1, 0), piece):
        h, power, size = _TABLE[data[lo : lo + piece + WIDTH - 1]], 0x9E3779B1, 1
        while size < WIDTH:
            h = h[:-size] * np.uint32(power) + h[size:]
            power, size = power * power & 0xFFFFFFFF, 2 * size
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
        out.append(np.flatnonzero(h < np.uint32((1 << 32) // EVERY)) + lo)
    return np.concatenate(out)


_RANDOM = np.random.default_rng(41)
_BYTES = _RANDOM.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_MIX = _RANDOM.integers(0, 1 << 64, (2, STEP + 4), dtype=np.uint64) | np.uint64(1)
_BASES = [int(x) << 3 & (1 << 64) - 1 | 5 for x in _RANDOM.integers(0, 1 << 61, 2, dtype=np.uint64)]
_PIECE = 1 << 15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


_UP = [_powers(x, _PIECE) for x in _BASES]
_DOWN = [_powers(pow(x, -1, 1 << 64), _PIECE) for x in _BASES]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


class Hashes:
    """Hashes of ranges of bytes: sums of a random number for each byte times powers of an
    odd number (5 modulo 8, so that no two strings of a few hundred bytes are bound to agree)."""

    def __init__(self, data: np.ndarray, lane: int):
        self.low, base = _UP[lane], _BASES[lane]
        self.high = _powers(pow(base, _PIECE, 1 << 64), len(data) // _PIECE + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        down = pow(pow(base, -1, 1 << 64), _PIECE, 1 << 64)
        for k, lo in enumerate(range(0, len(data), _PIECE)):
            part = _BYTES[lane][data[lo : lo + _PIECE]]
            part *= _DOWN[lane][: len(part)]
            np.cumsum(part, out=part)
            part *= np.uint64(pow(down, k, 1 << 64))
            np.add(part, self.sums[lo], out=self.sums[lo + 1 : lo + 1 + len(part)])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * (self.low[begin % _PIECE] * self.high[begin // _PIECE])


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers from each ``lo`` up to its ``hi``."""
    size = np.maximum(hi - lo + 1, 0)
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Parse:
    """Triggers ``at`` of the texts that end at ``ends``, in texts long enough for a string."""

    def __init__(self, ends: np.ndarray, at: np.ndarray):
        self.ends, self.sizes = ends, np.diff(ends, prepend=0)
        self.starts = ends - self.sizes
        text = np.searchsorted(ends, at, side="right")
        fits = at + WIDTH <= ends[np.minimum(text, len(ends) - 1)] if len(at) else np.zeros(0, bool)
        fits &= self.sizes[np.minimum(text, len(ends) - 1)] >= LEAST
        self.at, self.text = at[fits], text[fits]
        #: Triggers that begin a phrase.
        self.phrases = np.flatnonzero(self.text[:-1] == self.text[1:])

    def window(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First trigger in the strings from the places ``i`` on, and how many they have."""
        first = np.searchsorted(self.at, i)
        return first, np.searchsorted(self.at, i + (LEAST - WIDTH), side="right") - first

    def gaps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of strings, cut after each trigger: the first and last of each
        piece, and the last one of its string without a whole phrase."""
        big = np.flatnonzero(self.sizes >= LEAST)
        place, text = np.r_[self.at, self.ends[big]], np.r_[self.text, big]
        inner = np.r_[np.ones(len(self.at), bool), np.zeros(len(big), bool)]
        order = np.lexsort((place, text))
        place, text, inner = place[order], text[order], inner[order]
        head = np.diff(text, prepend=-1) != 0
        lo = np.where(head, self.starts[text], np.r_[0, place[:-1]] + 1) if len(text) else place
        after = np.where(np.r_[inner[1:], False], np.r_[place[1:], 0], 1 << 62)
        hi = np.minimum(place, self.ends[text] - LEAST)
        bare = np.minimum(hi, np.where(inner, after - (LEAST - WIDTH) - 1, hi))
        some = lo <= hi
        return lo[some], hi[some], bare[some]

    def anchors(self) -> np.ndarray:
        """Triggers, and first and last places of strings."""
        big = np.flatnonzero(self.sizes >= LEAST)
        at = self.at[self.at <= self.ends[self.text] - LEAST]
        return np.unique(np.r_[at, self.starts[big], self.ends[big] - LEAST])

    def ranks(self, levels: list[np.ndarray], i: np.ndarray):
        """``first, n, names, ok``: trigger and number of triggers of the strings at ``i``,
        the ranks of their phrases (``STEP`` columns), and whether these all have ranks."""
        first, n = self.window(i)
        names, ok = np.zeros((len(i), STEP), np.int64), n < 2
        for k, level in enumerate(levels):
            size = STEP**k
            now = np.flatnonzero((n - 1 >= size) & (n - 1 < size * STEP))
            for c in range(STEP):
                names[now, c] = level[first[now] + np.minimum(c * size, n[now] - 1 - size)]
            ok[now] = (names[now] > 0).all(axis=1)
        return first, n, names, ok


class Block(Parse):
    """A parse with its bytes."""

    def __init__(self, data: bytes, sizes: np.ndarray):
        self.data = data
        super().__init__(np.cumsum(sizes), triggers(np.frombuffer(data, np.uint8)))

    @classmethod
    def read(cls, sizes, data) -> Block:
        import zstandard

        return cls(zstandard.decompress(data.as_py()), np.frombuffer(sizes.as_py(), np.int64))

    def phrase_bytes(self, u: np.ndarray):
        data = self.data
        for lo, hi in zip(self.at[u].tolist(), (self.at[u + 1] + WIDTH).tolist()):
            yield data[lo:hi]

    def hashes(self, lane: int) -> Hashes:
        return Hashes(np.frombuffer(self.data, np.uint8), lane)

    def phrase_digests(self, h: Hashes | None = None) -> np.ndarray:
        begin, end = self.at[self.phrases], self.at[self.phrases + 1] + WIDTH
        return _mixed((h or self.hashes(0)).of(begin, end) + (end - begin).astype(np.uint64) * _MIX[0][0])

    def bare(self, h: Hashes | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of strings without a whole phrase, and their digests."""
        lo, _, bare = self.gaps()
        at = _ranges(lo, bare)
        return at, _mixed((h or self.hashes(0)).of(at, at + LEAST) + _MIX[0][1])

    def digests(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = self.hashes(0)
        return self.phrase_digests(h), *self.bare(h)

    def keys(self, levels: list[np.ndarray], i: np.ndarray):
        """Places among ``i`` that may repeat (as a mask), and the keys (two longs) of their order."""
        first, n, names, ok = self.ranks(levels, i)
        i, first, n, names = i[ok], first[ok], n[ok], names[ok]
        whole = n < 2
        at = np.r_[self.at, 0]  # a place without a trigger looks at none
        cut = np.where(whole, i, at[np.minimum(first, len(self.at))])
        tail = np.where(whole, i, at[np.clip(first + n - 1, 0, len(self.at))])
        rest = [*names.T, np.where(whole, 0, n), cut - i]
        out = np.empty((len(i), 2), np.int64)
        for lane, odd in enumerate(_MIX):
            h = self.hashes(lane)
            for lo in range(0, len(i), _PIECE):
                some = slice(lo, lo + _PIECE)
                key = h.of(i[some], cut[some]) * odd[-2] + h.of(tail[some], i[some] + LEAST) * odd[-1]
                for x, y in zip(rest, odd):
                    key += x[some].astype(np.uint64) * y
                out[some, lane] = _mixed(key)
        return ok, out


def _grouped(block: int, at: np.ndarray, *keys: np.ndarray, weights: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each distinct key of a block, with its places and their weights' sum."""
    order = np.lexsort(keys[::-1])
    sorted_keys = [k[order] for k in keys]
    head = np.zeros(len(order), bool)
    head[:1] = True
    for k in sorted_keys:
        head[1:] |= k[1:] != k[:-1]
    begin = np.flatnonzero(head)
    bounds = (np.r_[begin, len(order)] * 4).astype(np.int32)
    places = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(at[order].astype(np.int32))])
    each = np.ones(len(order), np.int64) if weights is None else weights[order]
    n = np.add.reduceat(each, begin) if len(begin) else each
    return pa.RecordBatch.from_arrays(
        [*(pa.array(k[head]) for k in sorted_keys), pa.array(np.full(len(begin), block)), places, pa.array(n.astype(np.int64))],
        names=[*(f"k{i}" for i in range(len(keys))), "block", "at", "n"],
    )


_FOUR = "k0 long, k1 long, k2 long, k3 long, block long, at binary, n long"
_TWO = "k0 long, k1 long, block long, at binary, n long"


# -- tasks -----------------------------------------------------------------------------


def _blocks(block_bytes: int):
    import zstandard

    def run(batches):
        base, number = TaskContext.get().partitionId() << ROW_BITS, 0
        ids, texts, n = [], [], 0

        def row():
            sizes = np.array([len(t) for t in texts], np.int64)
            return pa.RecordBatch.from_arrays([
                pa.array([base + number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes.tobytes()]),
                pa.array([zstandard.compress(b"".join(texts), 1)]),
            ], names=["block", "ids", "sizes", "data"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(i)
                texts.append((t.as_py() or "").encode())
                n += len(texts[-1])
                if n >= block_bytes:
                    yield row()
                    ids, texts, n, number = [], [], 0, number + 1
        if ids:
            yield row()

    return run


def _digests(batches):
    for b in batches:
        for block, sizes, data in zip(*b.columns):
            s = Block.read(sizes, data)
            phrases, _, bare = s.digests()
            keys, n = np.unique(np.r_[phrases, bare], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), block.as_py())), pa.array(n)], names=["k0", "block", "n"])


def _split(batches):
    """Blocks with the digests that repeat in; texts that may repeat and the others out."""
    import zstandard

    for b in batches:
        for block, ids, sizes, data, hits in zip(*b.columns):
            s = Block.read(sizes, data)
            hit = np.array([], np.int64) if hits.values is None else hits.values.to_numpy()
            phrases, at, bare = s.digests()
            alive = np.zeros(len(s.at), bool)
            alive[s.phrases] = np.isin(phrases, hit)
            lo, hi, short = s.gaps()  # the first place with a whole phrase has the fewest of a piece
            lo = np.maximum(lo, short + 1)[short < hi]
            first, n = s.window(lo)
            dead = np.r_[0, np.cumsum(~alive)]
            last = np.minimum(first + np.maximum(n - 1, 0), len(s.at))
            found = lo[(n > 1) & (dead[last] == dead[np.minimum(first, len(s.at))])]
            live = np.zeros(len(s.ends), bool)
            live[np.searchsorted(s.ends, np.r_[found, at[np.isin(bare, hit)]], side="right")] = True
            for flag in (True, False):
                take = live == flag
                if take.any():
                    rows = np.flatnonzero(take)
                    part = b"".join(s.data[s.starts[r] : s.ends[r]] for r in rows)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([flag]), pa.array([block.as_py()]), pa.array([ids.values.take(pa.array(rows)).to_pylist()], pa.list_(pa.int64())),
                        pa.array([s.sizes[rows].tobytes()]), pa.array([zstandard.compress(part, 1)]), pa.array([alive[take[s.text]].tobytes()]),
                    ], names=["live", "block", "ids", "sizes", "data", "alive"])


def _phrases(batches):
    for b in batches:
        for block, sizes, data, alive in zip(*b.columns):
            s = Block.read(sizes, data)
            flags = np.frombuffer(alive.as_py(), bool)
            u = s.phrases[flags[s.phrases]]
            places: dict[bytes, list[int]] = {}
            for p, i in zip(s.phrase_bytes(u), u.tolist()):
                places.setdefault(p, []).append(i)
            yield pa.RecordBatch.from_arrays([
                pa.array(list(places), pa.binary()), pa.array(np.full(len(places), block.as_py())),
                pa.array([np.array(v, np.int32).tobytes() for v in places.values()], pa.binary()), pa.array([len(v) for v in places.values()], pa.int64()),
            ], names=["k0", "block", "at", "n"])


def _places(hits) -> tuple[np.ndarray, pa.Array | None]:
    """Places of a block's list of hits, and how many each hit has."""
    if hits.values is None or not len(hits.values):
        return np.zeros(0, np.int64), None
    at = hits.values.field("at") if pa.types.is_struct(hits.values.type) else hits.values
    return np.frombuffer(b"".join(at.to_pylist()), np.int32).astype(np.int64), at


def _level(size: int, hits) -> np.ndarray:
    names = np.zeros(size, np.int64)
    places, at = _places(hits)
    if at is not None:
        names[places] = np.repeat(hits.values.field("rank").to_numpy(), [len(x) // 4 for x in at.to_pylist()])
    return names


def _parse_row(block, ends, at, levels) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([block], pa.int64()), pa.array([ends]), pa.array([at]), pa.array([levels], pa.list_(pa.binary())),
    ], names=["block", "ends", "at", "levels"])


def _first_level(batches):
    for b in batches:
        for block, sizes, data, hits in zip(*b.columns):
            s = Block.read(sizes, data)
            yield _parse_row(block.as_py(), s.ends.astype(np.int64).tobytes(), s.at.astype(np.int64).tobytes(), [_level(len(s.at), hits).tobytes()])


def _arrays(ends, at, levels) -> tuple[Parse, list[np.ndarray]]:
    s = Parse(np.frombuffer(ends.as_py(), np.int64), np.frombuffer(at.as_py(), np.int64))
    return s, [np.frombuffer(x, np.int64) for x in levels.as_py()]


def _fours(batches):
    """Neighbouring ranges that fit in a string."""
    for b in batches:
        for block, ends, at, levels in zip(*b.columns):
            s, names = _arrays(ends, at, levels)
            step, name = STEP ** (len(names) - 1), names[-1]
            p = np.arange(max(len(s.at) - STEP * step, 0))
            p = p[(s.text[p] == s.text[p + STEP * step]) & (s.at[p + STEP * step] + WIDTH - s.at[p] <= LEAST)]
            p = p[(np.stack([name[p + c * step] for c in range(STEP)]) > 0).all(axis=0)]
            yield _grouped(block.as_py(), p, *(name[p + c * step] for c in range(STEP)))


def _next_level(batches):
    for b in batches:
        for block, ends, at, levels, hits in zip(*b.columns):
            yield _parse_row(block.as_py(), ends.as_py(), at.as_py(), [*levels.as_py(), _level(len(at.as_py()) // 8, hits).tobytes()])


def _names(levels) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64) for x in levels.as_py()]


def _anchor_keys(batches):
    for b in batches:
        for block, sizes, data, levels in zip(*b.columns):
            s = Block.read(sizes, data)
            at = s.anchors()
            ok, keys = s.keys(_names(levels), at)
            yield _grouped(block.as_py(), at[ok], keys[:, 0], keys[:, 1])


def gaps_between(s: Parse, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gaps between neighbouring anchors of one text as rows (from, to), those closed by
    ``repeats`` and the open ones, and all anchors that are no triggers."""
    at = s.anchors()
    hit, text = np.isin(at, repeats), np.searchsorted(s.ends, at, side="right")
    pairs = np.column_stack([at[:-1], at[1:]])
    inner = (text[:-1] == text[1:]) & (at[1:] - at[:-1] > 1)
    closed = hit[:-1] & hit[1:] & (at[1:] - at[:-1] <= LEAST)
    return pairs[inner & closed], pairs[inner & ~closed], at[~np.isin(at, s.at)]


def _inside(gaps: np.ndarray) -> np.ndarray:
    return _ranges(gaps[:, 0] + 1, gaps[:, 1] - 1)


def _needs(batches):
    """First phrases of a block, and whether an open place stands before them."""
    for b in batches:
        for block, ends, at, levels, hits in zip(*b.columns):
            s, names = _arrays(ends, at, levels)
            _, gaps, alone = gaps_between(s, _places(hits)[0])
            first, n, _, ok = s.ranks(names, np.r_[_inside(gaps), alone])
            keys = np.unique(names[0][names[0] > 0])
            need = np.isin(keys, names[0][first[ok & (n > 1)]])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), block.as_py())), pa.array(need.astype(np.int64))], names=["k0", "block", "n"])


def _gap_texts(batches):
    """Closed gaps before needed phrases, by what stands in them and in the string after them."""
    from xxhash import xxh3_128_digest as digest

    for b in batches:
        for block, sizes, data, levels, hits, needs in zip(*b.columns):
            s, names = Block.read(sizes, data), _names(levels)
            gaps, _, _ = gaps_between(s, _places(hits)[0])
            first, n = s.window(gaps[:, 1] - 1)  # the last place of a gap has the most triggers
            wanted = np.flatnonzero(n > 1)
            need = np.zeros(0, np.int64) if needs.values is None else needs.values.to_numpy()
            gaps = gaps[wanted[np.isin(names[0][first[wanted]], need)]]
            keys = np.frombuffer(b"".join(digest(s.data[x : y + LEAST]) for x, y in gaps.tolist()), "<i8").reshape(-1, 2)
            yield _grouped(block.as_py(), gaps[:, 0], keys[:, 0], keys[:, 1])


def _gap_keys(batches):
    """Open places one by one, and closed gaps that stand for all with their text."""
    for b in batches:
        for block, sizes, data, levels, hits, leads in zip(*b.columns):
            s, names = Block.read(sizes, data), _names(levels)
            closed, gaps, alone = gaps_between(s, _places(hits)[0])
            lo, _, bare = s.gaps()
            single = np.setdiff1d(np.r_[_inside(gaps), alone, _ranges(lo, bare)], s.at)
            begin, weights = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if leads.values is not None and len(leads.values):
                begin = np.array([struct.unpack_from("<i", x)[0] for x in leads.values.field("at").to_pylist()])
                weights = leads.values.field("n").to_numpy()
            rows = closed[np.searchsorted(closed[:, 0], begin)]
            inner, weights = _inside(rows), np.repeat(weights, rows[:, 1] - rows[:, 0] - 1)
            many = s.window(inner)[1] > 1  # the others are among the single ones
            at = np.r_[single, inner[many]]
            ok, keys = s.keys(names, at)
            yield _grouped(block.as_py(), at[ok], keys[:, 0], keys[:, 1], weights=np.r_[np.ones(len(single), np.int64), weights[many]][ok])


def spans_of(s: Parse, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what the strings at ``places`` cover."""
    places = np.unique(places)
    if not len(places):
        return places, places
    text = np.searchsorted(s.ends, places, side="right")
    head = np.r_[True, (places[1:] > places[:-1] + LEAST) | (text[1:] != text[:-1])]
    return places[head], places[np.r_[head[1:], True]] + LEAST


class _Whole(Parse):
    """Texts without triggers."""

    def __init__(self, data: bytes, sizes: np.ndarray):
        self.data = data
        super().__init__(np.cumsum(sizes), np.zeros(0, np.int64))

    @classmethod
    def read(cls, sizes, data) -> _Whole:
        import zstandard

        return cls(zstandard.decompress(data.as_py()), np.frombuffer(sizes.as_py(), np.int64))


def _rows(ids, s: _Whole, begin: np.ndarray, end: np.ndarray):
    text = np.searchsorted(s.ends, begin, side="right")
    bounds = np.searchsorted(text, np.arange(len(s.ends) + 1)).astype(np.int32)
    kept = []
    for k, (lo, hi) in enumerate(zip(s.starts.tolist(), s.ends.tolist())):
        parts = []
        for x, y in zip(begin[bounds[k] : bounds[k + 1]].tolist(), end[bounds[k] : bounds[k + 1]].tolist()):
            parts.append(s.data[lo:x])
            lo = y
        kept.append(b"".join([*parts, s.data[lo:hi]]))
    spans = pa.StructArray.from_arrays([pa.array(begin - s.starts[text]), pa.array(end - begin)], fields=list(_SPAN))
    out = pa.RecordBatch.from_arrays([ids.values, pa.array(s.sizes), pa.ListArray.from_arrays(pa.array(bounds), spans), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])
    for lo in range(0, out.num_rows, 256):
        yield out.slice(lo, 256)


def _cut(batches):
    for b in batches:
        for ids, sizes, data, first, second in zip(*b.columns):
            s = _Whole.read(sizes, data)
            yield from _rows(ids, s, *spans_of(s, np.r_[_places(first)[0], _places(second)[0]]))


def _whole(batches):
    none = np.zeros(0, np.int64)
    for b in batches:
        for ids, sizes, data in zip(*b.columns):
            yield from _rows(ids, _Whole.read(sizes, data), none, none)


# -- jobs ------------------------------------------------------------------------------


def _neighbours(keys: int):
    """Rows in the order of their keys in, those of keys that repeat out. The first and
    last row of a partition are edges and always come out, with ``n`` 2 if they repeat."""

    def run(batches):
        held, before, first = None, False, True  # the last row so far, and whether it equals the one before it

        def out(t: pa.Table, edge: bool):
            return t.append_column("edge", pa.array(np.full(len(t), edge))).combine_chunks().to_batches()

        def as_edge(row: pa.Table, repeats: bool):
            at = row.schema.get_field_index("n")
            return out(row.set_column(at, "n", pa.array([2], pa.int64())) if repeats else row, True)

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if held is not None:
                t = pa.concat_tables([held, t])
            same = np.ones(len(t) - 1, bool)
            for k in range(keys):
                c = t.column(k).to_numpy()
                same &= c[1:] == c[:-1]
            prev, after = np.r_[before, same], np.r_[same, False]
            repeats = prev | after | (t.column("n").to_numpy() > 1)
            if first and len(t) > 1:
                yield from as_edge(t.slice(0, 1), bool(repeats[0]))
            take = np.flatnonzero(repeats[:-1])
            if first:
                take = take[take > 0]
            if len(t) > 1:
                first = False
            if len(take):
                yield from out(t.take(pa.array(take)), False)
            held, before = t.slice(len(t) - 1), bool(prev[-1])
        if held is not None:
            yield from as_edge(held, before or held.column("n")[0].as_py() > 1)

    return run


def _repeated(rows: DataFrame, keys: list[str], what: str, store: Written) -> DataFrame:
    """``block, hits``: ``what`` the rows say whose keys repeat. All rows are shuffled and
    sorted once, on their way from the tasks that make them; equal neighbours repeat. A
    block has one row for a key, so the most frequent key is one row for each block."""
    placed = rows.repartition(*keys).sortWithinPartitions(*keys)
    hits = placed.mapInArrow(_neighbours(len(keys)), T.StructType([*rows.schema.fields, T.StructField("edge", T.BooleanType())]))
    return store.write(hits.where("not edge or n > 1").groupBy("block").agg(F.collect_list(what).alias("hits")))


def _often(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Keys whose numbers ``n`` come to ``least`` or more."""
    return rows.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(*keys)


def _hits(rows: DataFrame, keys: DataFrame, what) -> DataFrame:
    """``block, hits``: what the rows of the named keys say, for each block."""
    names = [c for c in keys.columns if c != "rank"]
    return rows.join(keys, names).groupBy("block").agg(F.collect_list(what).alias("hits"))


def _ranked(keys: DataFrame, store: Written) -> tuple[DataFrame, DataFrame]:
    """Keys numbered from 1 in their order, and the written table behind it. Range
    partitions are sorted side by side; only their sizes go to the driver."""
    order = keys.columns
    plain = store.write(keys)
    placed = store.write(
        plain.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumns({"part": F.spark_partition_id(), "inside": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    )
    store.drop(plain)
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    starts, total = [], 1
    for p in range(max(sizes, default=0) + 1):
        starts.append(F.lit(total).cast("long"))
        total += sizes.get(p, 0)
    return placed.select(*order, (F.get(F.array(*starts), F.col("part")) + F.col("inside")).alias("rank")), placed


def _with(table: DataFrame, hits: DataFrame, name: str = "hits") -> DataFrame:
    return table.join(hits.withColumnRenamed("hits", name), "block", "left")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``, a row per row: what is cut from the text and
    what is left of its UTF-8 bytes.

    A byte goes if a string of ``LEAST`` bytes over it also starts anywhere else, in
    another text or in the same one (they may overlap). Strings do not cross texts and
    are judged on the input. Spans are the maximal runs of bytes that go, with their
    starts in the text. A null text is empty; shorter texts stay whole; very long ones
    are one block each. Repeated rows are copies of each other and go both; a null id
    stays null; other columns are not read; an empty table gives an empty result.
    """
    store = Written(docs.sparkSession)
    place = F.struct("at", "rank")
    blocks = store.write(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_blocks(block_bytes), _BLOCK), "uncompressed")
    rows = blocks.select("block", "sizes", "data").mapInArrow(_digests, "k0 long, block long, n long")
    again = _repeated(rows, ["k0"], "k0", store)
    kept = store.write(_with(blocks, again).select("block", "ids", "sizes", "data", "hits").mapInArrow(_split, _KEEP), "uncompressed")
    for t in (blocks, again):
        store.drop(t)
    live = kept.where("live")

    rows = store.write(live.select("block", "sizes", "data", "alive").mapInArrow(_phrases, "k0 binary, block long, at binary, n long"))
    ranks, behind = _ranked(_often(rows, ["k0"], 2), store)
    parse = store.write(_with(live.select("block", "sizes", "data"), _hits(rows, ranks, place)).select("block", "sizes", "data", "hits").mapInArrow(_first_level, _PARSE))
    four = [f"k{c}" for c in range(STEP)]
    while True:
        store.drop(rows)
        store.drop(behind)
        rows = store.write(parse.mapInArrow(_fours, _FOUR))
        if rows.isEmpty():
            break
        ranks, behind = _ranked(_often(rows, four, 2), store)
        longer = store.write(_with(parse, _hits(rows, ranks, place)).select("block", "ends", "at", "levels", "hits").mapInArrow(_next_level, _PARSE))
        store.drop(parse)
        parse = longer
    store.drop(rows)

    both = ["k0", "k1"]
    levels = live.select("block", "sizes", "data").join(parse.select("block", "levels"), "block")
    first = _repeated(levels.mapInArrow(_anchor_keys, _TWO), both, "at", store)
    rows = store.write(_with(parse, first).select("block", "ends", "at", "levels", "hits").mapInArrow(_needs, "k0 long, block long, n long"))
    needs = store.write(_hits(rows, _often(rows, ["k0"], 1), F.col("k0")))
    store.drop(rows)
    rows = store.write(_with(_with(levels, first), needs, "needs").mapInArrow(_gap_texts, _TWO))
    lead = rows.groupBy(*both).agg(F.sum("n").alias("all"), F.min("block").alias("block"))
    leads = rows.join(lead, [*both, "block"]).groupBy("block").agg(F.collect_list(F.struct("at", F.col("all").alias("n"))).alias("hits"))
    leads = store.write(leads)
    store.drop(needs)
    store.drop(rows)
    second = _repeated(_with(_with(levels, first), leads, "leads").mapInArrow(_gap_keys, _TWO), both, "at", store)
    for t in (leads, parse):
        store.drop(t)
    cut = _with(_with(live, first, "first"), second, "second").select("ids", "sizes", "data", "first", "second").mapInArrow(_cut, _OUT)
    return cut.unionByName(kept.where("not live").select("ids", "sizes", "data").mapInArrow(_whole, _OUT))
