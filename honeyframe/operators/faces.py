"""Faces of the bond graph within one range partition, for ``topology.trace_rings``.

A partition holds all bonds that leave its atoms. The bond that follows a bond around a
face is known where the partition has the atom between them, so a bond is on a face that
is closed here, or on a path that comes from other atoms and leaves to other atoms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: ``u, v`` name the face (its smallest atom and the next one), or the bond that leads to
#: the path; ``seq`` is the place from there. Paths alone have ``q, turn`` and, on their
#: first row, ``n`` bonds and the last bond ``last_u, last_v``.
SCHEMA = "view long, u long, v long, seq long, atom_id long, size long, q long, turn double, n long, last_u long, last_v long"


def _reached(nx: np.ndarray):
    """For each bond of the pointers ``nx`` (number of bonds: none): the smallest bond of
    its cycle and how far ahead it is; the last bond of its path (-1 on a cycle) and the
    bonds from here to it."""
    n = len(nx)
    jump, low, ahead = np.r_[nx, n], np.arange(n + 1), np.zeros(n + 1, np.int64)
    last = np.where(jump == n, np.arange(n + 1), -1)
    left = np.where(jump == n, 0, 1)
    span = 1
    while True:
        far = (low[jump] < low) & (jump < n)
        ahead = np.where(far, span + ahead[jump], ahead)
        low = np.where(far, low[jump], low)
        open_ = last < 0
        left = np.where(open_, left + left[jump], left)
        last = np.where(open_, last[jump], last)
        jump = jump[jump]
        span *= 2
        if span >= n:
            return low[:n], ahead[:n], last[:n], left[:n]


def partition_faces(batches):
    """Bonds (view, p, q, angle, turn) of a partition in; its inner faces and its paths out."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    view, p, q, angle, turn = (t.column(c).to_numpy() for c in ("view", "p", "q", "angle", "turn"))
    order = np.lexsort((q, angle, p, view))
    view, p, q, turn = view[order], p[order], q[order], turn[order]
    n = len(p)
    head = np.r_[True, (p[1:] != p[:-1]) | (view[1:] != view[:-1])]
    start, atom = np.flatnonzero(head), np.cumsum(head) - 1
    end = np.r_[start[1:], n]
    # the atom at the other end, where it is here: numbers of (view, id), sorted as the atoms are
    ids, code = np.unique(np.r_[p, q], return_inverse=True)
    group = np.unique(view, return_inverse=True)[1] * len(ids)
    known, far = (group + code[:n])[start], group + code[n:]
    other = np.minimum(np.searchsorted(known, far), len(known) - 1)
    here = known[other] == far
    # the bond back, and the one before it by angle
    key, back = atom * len(ids) + code[n:], other * len(ids) + code[:n]
    by_key = np.argsort(key, kind="stable")
    back = by_key[np.minimum(np.searchsorted(key[by_key], back), n - 1)]
    nx = np.where(here, np.where(back == start[atom[back]], end[atom[back]] - 1, back - 1), n)
    low, ahead, last, left = _reached(nx)

    cycle = last < 0
    c = np.flatnonzero(cycle)
    size = np.bincount(low[c], minlength=n)
    area = np.bincount(low[c], weights=turn[c], minlength=n)
    atoms = np.bincount(np.unique(low[c] * len(start) + atom[c]) // len(start), minlength=n)
    c = c[((area > 0) & (size > 2) & (atoms == size))[low[c]]]
    c = c[np.lexsort((-ahead[c], low[c]))]
    f, none = low[c], pa.nulls(len(c), pa.int64())
    yield from _rows(
        view[c], p[f], q[f], (size[f] - ahead[c]) % size[f], p[c], pa.array(size[f]), none, pa.nulls(len(c), pa.float64()), none, none, none
    )
    # paths: the bond that leads to the first one follows it by angle
    s = np.flatnonzero(~cycle)
    if not len(s):
        return
    first = np.ones(n + 1, bool)
    first[nx] = False
    begin = np.flatnonzero(first[:n] & ~cycle)
    of = np.full(n, -1)
    of[last[begin]] = begin
    b = of[last[s]]
    lead = q[np.where(b + 1 == end[atom[b]], start[atom[b]], b + 1)]
    seq, leads = left[b] - left[s], s == b
    only = lambda x: pa.array(x, mask=~leads)
    yield from _rows(
        view[s], lead, p[b], seq, p[s], pa.nulls(len(s), pa.int64()), pa.array(q[s]), pa.array(turn[s]),
        only(left[s] + 1), only(p[last[s]]), only(q[last[s]]),
    )


def _rows(*columns):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
    yield from pa.Table.from_arrays([a.cast(pa.int64()) if pa.types.is_integer(a.type) else a for a in arrays], names=names).to_batches(1 << 16)
