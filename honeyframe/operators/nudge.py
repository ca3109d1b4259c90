"""Moves of atoms within blocks of frames, for ``atoms.nudge_atoms``.

Frames never wait for each other: the rounds of a block run side by side in one task, on
flat arrays of its atoms and grids of its residuals, and a frame without a move leaves.
"""

from __future__ import annotations

import numpy as np


class Moves:
    def __init__(self, kernel, wobble: int, width: int, height: int, least_gain: float):
        self.width, self.height, self.least = width, height, least_gain
        radius = max(max(abs(a), abs(b)) for a, b, _ in kernel)
        self.reach, self.pad = 2 * radius + wobble, radius + wobble
        self.rows, self.cols = height + 2 * self.pad, width + 2 * self.pad
        reach = range(-wobble, wobble + 1)
        # on equal falls an atom stays, or takes the upper left place
        steps = sorted(((a, b) for a in reach for b in reach if a * a + b * b <= wobble * wobble), key=lambda s: (s != (0, 0), s[1], s[0]))
        self.sx, self.sy = np.array(steps).T
        self.k = np.array([float(k) for *_, k in kernel])
        self.cell = np.array([b * self.cols + a for a, b, _ in kernel])
        at = {(a, b): float(k) for a, b, k in kernel}
        #: the kernel of the atom where it is, at the cells of each step
        self.own = np.array([[at.get((sx + a, sy + b), 0.0) for a, b, _ in kernel] for sx, sy in steps])

    def place(self, f, x, y):
        return (f * self.rows + y + self.pad) * self.cols + x + self.pad

    def _tops(self, f, x, y, gain):
        """Atoms that have the largest gain of their tile and the eight around."""
        order = np.lexsort((-x, -y, gain))
        new = np.ones(len(order), bool)
        new[1:] = (gain[order][1:] != gain[order][:-1]) | (y[order][1:] != y[order][:-1]) | (x[order][1:] != x[order][:-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        f = np.unique(f, return_inverse=True)[1]
        wide, high = self.width // self.reach + 3, self.height // self.reach + 3
        tile = (f * high + y // self.reach + 1) * wide + x // self.reach + 1
        top = np.zeros((f.max() + 1) * high * wide + 1, np.int64)
        np.maximum.at(top, tile, rank)
        around = np.array([i * wide + j for i in (-1, 0, 1) for j in (-1, 0, 1)])
        return rank == top[tile[:, None] + around].max(axis=1)

    def run(self, count: int, pixels, atoms):
        """Atoms (frame, x, y, weight) and what they add to the residual (frame, x, y,
        value) at the end, from pixels (frame, x, y, value) and atoms of ``count`` frames."""
        f, x, y, v = pixels
        ok = (x >= 0) & (x < self.width) & (y >= 0) & (y < self.height)
        at, v = self.place(f[ok], x[ok], y[ok]), v[ok]
        size, known = count * self.rows * self.cols, ~np.isnan(v)
        n = np.bincount(at, minlength=size).astype(float)  # pixels may come twice, or without a value
        nn = np.bincount(at[known], minlength=size).astype(float)
        total = np.bincount(at[known], weights=v[known], minlength=size)
        added, kk0 = np.zeros(size), (self.k * self.k).sum()
        f, x, y, w = atoms
        ended, first = [], True
        while len(f):
            same, times = np.unique(np.column_stack([f, x, y, w]), axis=0, return_counts=True)
            af, ax, ay = (same[:, c].astype(np.int64) for c in range(3))
            aw = same[:, 3]
            tx, ty = ax[:, None] + self.sx, ay[:, None] + self.sy
            inside = (tx >= 0) & (tx < self.width) & (ty >= 0) & (ty < self.height)
            cells = np.where(inside, self.place(af[:, None], tx, ty), self.place(0, 0, 0))[:, :, None] + self.cell
            has = nn[cells]
            kr = (self.k * total[cells]).sum(axis=2) + aw[:, None] * (self.k * self.own * has).sum(axis=2)
            kk = (self.k * self.k * n[cells]).sum(axis=2)
            with np.errstate(all="ignore"):
                weight = kr / kk
                fall = times[:, None] * kr * weight
                fall = np.where(inside & (has.sum(axis=2) > 0) & (kk > 0), fall, np.nan)
                row, pick = np.arange(len(af)), np.argmax(np.where(np.isnan(fall), -np.inf, np.round(fall, 9)), axis=1)
                best = weight[row, pick]
                gain = fall[row, pick] - (fall[:, 0] - kk0 * (aw - weight[:, 0]) ** 2)
                go = np.flatnonzero((gain > self.least) & (best > 0))
            move = np.zeros(len(af), bool)
            if len(go):
                move[go[self._tops(af[go], ax[go], ay[go], np.round(gain[go], 9))]] = True
            m = np.flatnonzero(move)
            gone, came = self.place(af[m], ax[m], ay[m]), self.place(af[m], tx[m, pick[m]], ty[m, pick[m]])
            for places, amount in ((gone, aw[m]), (came, -best[m])):
                around, change = places[:, None] + self.cell, amount[:, None] * self.k
                np.add.at(added, around, change)
                np.add.at(total, around, nn[around] * change)
            # atoms that come to one place are one atom
            here = self.place(f, x, y)
            stay = ~np.isin(here, gone)
            here = np.concatenate([here[stay], came])
            here, which = np.unique(here, return_inverse=True)
            w = np.bincount(which, weights=np.concatenate([w[stay], best[m]]), minlength=len(here))
            f, rest = np.divmod(here, self.rows * self.cols)
            y, x = np.divmod(rest, self.cols)
            x, y = x - self.pad, y - self.pad
            going = np.zeros(count, bool)
            going[af[m]] = True
            out = ~(going | first)[f]
            ended.append((f[out], x[out], y[out], w[out]))
            f, x, y, w = f[~out], x[~out], y[~out], w[~out]
            first = False
        done = tuple(np.concatenate(c) for c in zip(*ended)) if ended else atoms
        at = np.flatnonzero(added)
        f, rest = np.divmod(at, self.rows * self.cols)
        y, x = np.divmod(rest, self.cols)
        return done, (f, x - self.pad, y - self.pad, added[at])
