"""Periodic runs of words, found by a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are identical) of at least ``max(6, 4 * q)`` words, that no neighbouring
word extends.

The dictionary names, for each power of two ``L``, the ``L`` words from each place
on, from the names of the two halves. Only factors that occur again in their
document have a name; a longer factor has one only if both halves have. Where a
factor occurs again within ``2 * L`` words, the distance is a proposed period, and
neighbouring places with one distance are an arithmetic progression. Proposals
are extended to both sides by common extensions in the dictionary (longest factors
first), and equal ones are one run. With a factor of ``q`` to ``2 * q`` words the
next occurrence inside a run is exactly ``q`` away, so every run is proposed; and as
a nearer occurrence would have been found first, the distance is the smallest period.

Documents are worked in slices of words inside a task, each document as a whole. The
names of a slice take ``4 * n * log2(longest repeated factor)`` bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A run has this many words, and this many periods, at least.
LEAST, TIMES = 6, 4
SLICE = 1 << 18

_SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _ranked(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ``at`` in the order of (left, right, place), and which of them
    have the same pair as the one before."""
    width, places = int(right.max()) + 1, int(at.max()) + 1
    if (int(left.max()) + 1) * width * places < 1 << 63:
        packed = (left * width + right) * places + at
        packed.sort()
        pair, order = np.divmod(packed, places)
        return order, np.concatenate([[False], pair[1:] == pair[:-1]])
    by = np.lexsort((at, right, left))
    a, b = left[by], right[by]
    return at[by], np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])


class Factors:
    """Names of the factors of 1, 2, 4, ... words; -1 where a factor occurs once.

    ``words`` are numbers of words and ``texts`` the documents of the places, in
    ascending order. Names are numbered within documents, so equal names are in one.
    """

    def __init__(self, words: np.ndarray, texts: np.ndarray):
        self.n, self.names, self.next = len(words), [], []
        at = np.arange(self.n)
        left, right = texts.astype(np.int64), words.astype(np.int64)
        while len(at):
            order, same = _ranked(left, right, at)
            again = same.copy()
            again[:-1] |= same[1:]
            names = np.full(self.n, -1, np.int32)
            names[order[again]] = (np.cumsum(~same) - 1)[again]
            after = np.full(self.n, -1, np.int64)
            hit = np.flatnonzero(same)
            after[order[hit - 1]] = order[hit]
            self.names.append(names)
            self.next.append(after)
            size = 1 << (len(self.names) - 1)
            at = np.flatnonzero((names[: max(self.n - size, 0)] >= 0) & (names[size:] >= 0))
            left, right = names[at].astype(np.int64), names[at + size].astype(np.int64)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words are equal from the places ``a`` and ``b`` (a < b) on."""
        done = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            while True:  # the longest factor may fit more than once
                x, y = a + done, np.minimum(b + done, self.n - 1)
                same = (b + done < self.n) & (names[np.minimum(x, self.n - 1)] >= 0) & (names[np.minimum(x, self.n - 1)] == names[y])
                if not same.any():
                    break
                done[same] += 1 << k
        return done

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words are equal before the places ``a`` and ``b`` (a < b)."""
        done = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, size = self.names[k], 1 << k
            while True:
                x = a - done - size
                same = (x >= 0) & (names[np.maximum(x, 0)] >= 0) & (names[np.maximum(x, 0)] == names[np.maximum(b - done - size, 0)])
                if not same.any():
                    break
                done[same] += size
        return done

    def runs(self) -> np.ndarray:
        """Rows of (start, length, period), sorted and distinct."""
        found = [np.zeros((0, 3), np.int64)]
        for k, after in enumerate(self.next):
            size = 1 << k
            at = np.flatnonzero(after >= 0)
            gap = after[at] - at
            near = gap <= 2 * size
            at, gap = at[near], gap[near]
            if not len(at):
                continue
            head = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (gap[1:] != gap[:-1])])
            first, period = at[head], gap[head]
            left = self.backward(first, first + period)
            start = first - left
            length = period + left + self.forward(first, first + period)
            keep = length >= np.maximum(LEAST, TIMES * period)
            found.append(np.stack([start[keep], length[keep], period[keep]], axis=1))
        return np.unique(np.concatenate(found), axis=0)


def runs_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``(text, start, length, period)`` of texts given as words, in order,
    and the flags of the words (of all texts in turn) that stay."""
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return np.zeros((0, 4), np.int64), np.zeros(0, bool)
    words = pa.concat_arrays([pa.array(t, pa.binary()) for t in texts]).dictionary_encode().indices.to_numpy()
    runs = Factors(words, np.repeat(np.arange(len(texts)), sizes)).runs()
    starts = np.cumsum(sizes) - sizes
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    text = np.searchsorted(np.cumsum(sizes), runs[:, 0], side="right")
    return np.column_stack([text, runs[:, 0] - starts[text], runs[:, 1:]]), np.cumsum(edge[:-1]) == 0


def _rows(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
    runs, stay = runs_of(texts)
    bounds = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
    kept, at = [], 0
    for t in texts:
        flags = stay[at : at + len(t)]
        at += len(t)
        kept.append(b" ".join(t if flags.all() else [w for w, f in zip(t, flags) if f]))
    found = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in (1, 2, 3)], fields=list(_RUN))
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), found), pa.array(kept, pa.binary()).cast(pa.string()),
    ], names=["doc_id", "runs", "collapsed"])


def _scan(batches):
    ids, texts, n = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            words = (t.as_py() or "").encode().split()
            if texts and n + len(words) > SLICE:
                yield _rows(ids, texts)
                ids, texts, n = [], [], 0
            ids.append(i)
            texts.append(words)
            n += len(words)
    if ids:
        yield _rows(ids, texts)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, runs, collapsed``, a row per row: the runs of words in order of
    start and period, and the text without the repeats of its runs.

    Words are separated by ASCII white space. A word goes if any run has it after
    the run's first period; the others are joined by one space. Null and empty
    texts have no runs and an empty rest; a text of any length is worked as a whole
    in one task, alone if it is longer than a slice. Null ids and repeated rows
    have rows of their own; runs of one start stand in order of their periods;
    other columns are not read; an empty table gives an empty result.
    """
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_scan, _SCHEMA)
