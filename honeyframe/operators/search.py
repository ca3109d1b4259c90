"""The scores of lattices on frames, for searches that run within a frame.

A search asks for one score after another, each from all pixels of its frame. Frames are
spread by Spark and never wait for each other; a task scores all trials of a block of
frames side by side, and frames that have ended leave the block. The numbers are those of
``lattice.score_candidates``, which scores many candidates of all frames in one job.
"""

from __future__ import annotations

import math

import numpy as np

from honeyframe.operators.pixels import gaussian_template

GEOMETRY = ("hel", "tilt", "excent", "phi", "off_x", "off_y")


def cell_vectors(hel, tilt, excent, phi, bond: int):
    """The distorted unit-cell vectors (ux, uy), (vx, vy) of arrays of lattices."""
    c, s = np.cos(phi), np.sin(phi)
    out = []
    for angle in (-tilt - math.pi / 6, -tilt + math.pi / 6):
        dx, dy = 3 * bond * hel * np.cos(angle), 3 * bond * hel * np.sin(angle)
        along, across = dx * c - dy * s, (-dx * s - dy * c) * excent
        out.append((along * c - across * s, -along * s - across * c))
    return out


class CellScores:
    """Scores of lattices on the pixels of a block of frames, each (x, y, value, mask)."""

    def __init__(self, frames: list, bond: int, res: int, width: int, height: int, sub: int = 1, shape: bool = True):
        part = (np.arange(sub) + 0.5) / sub
        n = max((len(f[0]) for f in frames), default=0)

        def padded(k, kind):
            out = np.zeros((len(frames), n), kind)
            for row, f in zip(out, frames):
                row[: len(f[k])] = f[k]
            return np.repeat(out, sub * sub, axis=1)

        self.x = padded(0, float) + np.tile(np.repeat(part, sub), n)
        self.y = padded(1, float) + np.tile(part, sub * n)
        self.value = padded(2, float) / (sub * sub)
        self.dirty = padded(3, float) != 1
        self.real = np.repeat(np.arange(n) < np.array([len(f[0]) for f in frames], int)[:, None], sub * sub, axis=1)
        self.bond, self.res, self.width, self.height, self.shape = bond, res, width, height, shape
        t = np.array(gaussian_template(res)).reshape(res, res)  # [j, i]
        #: one row for each shift (sx, sy): the template with its origin there
        self.rolled = np.array([np.roll(t, (sy, sx), (0, 1)).ravel() for sx in range(res) for sy in range(res)])
        self.sums = t.sum(), (t * t).sum()

    def cells(self, rows: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For lattices p (parameter, frame, trial) of the frames ``rows``: sums of the clean
        cells at the places of the unit cell, one row for each lattice, and whether it has any."""
        hel, tilt, excent, phi, ox, oy = (v[:, :, None] for v in p)
        (ux, uy), (vx, vy) = cell_vectors(hel, tilt, excent, phi, self.bond)
        dx, dy = self.x[rows][:, None, :] - ox, self.y[rows][:, None, :] - oy
        det = ux * vy - uy * vx
        f1, f2 = (dx * vy - dy * vx) / det, (dy * ux - dx * uy) / det
        c1, c2 = np.floor(f1), np.floor(f2)
        inside = np.broadcast_to(self.real[rows][:, None, :], f1.shape).copy()
        for a, b, off, size in ((ux, vx, ox, self.width), (uy, vy, oy, self.height)):
            # all four corners of the cell are in the frame
            (a0, a1), (b0, b1) = (c1 * a, (c1 + 1) * a), (c2 * b, (c2 + 1) * b)
            inside &= (np.minimum(a0, a1) + np.minimum(b0, b1) + off >= 0) & (np.maximum(a0, a1) + np.maximum(b0, b1) + off < size)
        # a number for each cell of each lattice
        low = [np.min(c, axis=2, initial=np.inf, where=inside).ravel() for c in (c1, c2)]
        high = [np.max(c, axis=2, initial=-np.inf, where=inside).ravel() for c in (c1, c2)]
        span = [np.maximum(h - b + 1, 0.0) for b, h in zip(low, high)]
        first = np.concatenate([[0.0], np.cumsum(span[0] * span[1])])
        n, bins = len(span[0]), self.res**2
        at = np.flatnonzero(inside)
        pair = at // max(f1.shape[2], 1)
        pixel = at % max(f1.shape[2], 1), rows[pair // f1.shape[1]]
        c1, c2, f1, f2 = (v.ravel()[at] for v in (c1, c2, f1, f2))
        name = (first[pair] + (c1 - low[0][pair]) * span[1][pair] + c2 - low[1][pair]).astype(np.int64)
        bad = np.zeros(int(first[-1]), bool)
        bad[name[self.dirty[pixel[1], pixel[0]]]] = True
        good = ~bad[name]
        pair, value = pair[good], self.value[pixel[1], pixel[0]][good]
        i, j = (np.minimum(np.floor((f[good] - c[good]) * self.res).astype(np.int64), self.res - 1) for f, c in ((f1, c1), (f2, c2)))
        some = np.zeros(n, bool)
        some[pair] = True
        return np.bincount((pair * self.res + j) * self.res + i, weights=value, minlength=n * bins).reshape(n, bins), some

    def _position(self, v: np.ndarray) -> np.ndarray:
        """Sharpness of the place of the template in the cells; 0 where there is none."""
        res, s = self.res, v.sum(axis=1)
        low = v.min(axis=1)
        amp = v.max(axis=1) - low
        fit = v @ self.rolled.T
        rest = (v * v).sum(axis=1) - 2 * low * s + res * res * low * low + 2 * amp * low * self.sums[0] + amp * amp * self.sums[1]
        residual = 1000 * np.sqrt(np.maximum(rest[:, None] - 2 * amp[:, None] * fit, 0)) / s[:, None]
        worst, best = residual.max(axis=1), residual.min(axis=1)
        w = (worst[:, None] - residual) / (worst - best)[:, None] - 0.5
        w = np.where(w > 0, w, 0.0)
        where, half, place = np.argmin(np.round(residual, 9), axis=1), res // 2, np.arange(res * res)
        var, total = 0.0, w.sum(axis=1)
        for shift, top in ((place // res, where // res), (place % res, where % res)):
            d = ((shift - top[:, None] + half) % res - half) / res
            var = var + np.abs((w * d * d).sum(axis=1) / total - ((w * d).sum(axis=1) / total) ** 2)
        return np.where((s == 0) | (worst - best <= 1e-7) | (var == 0), 0.0, 1 / (30 * var))

    def score(self, rows: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Contrast of the folded cell times the sharpness, (frame, trial); 0 where there is none."""
        with np.errstate(all="ignore"):
            v, some = self.cells(rows, p)
            mean = v.mean(axis=1)
            score = 500 * v.std(axis=1) / mean
            if self.shape:
                score = score * self._position(v)
            return np.where(some & (mean != 0), score, 0.0).reshape(p.shape[1:])

    def best(self, rows: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best trial of each frame and its score, the first one on a tie. A first trial
        without a number stays."""
        scores = self.score(rows, p)
        rank = np.round(scores, 9)
        k = np.where(np.isnan(rank[:, 0]), 0, np.argmax(np.where(np.isnan(rank), -np.inf, rank), axis=1))
        return k, scores[np.arange(len(k)), k]

    def refine(self, p: np.ndarray, fine: float, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Steps along one axis at a time, halved where none gains, down to ``least``:
        lattices (parameter, frame) and their scores."""
        # Step of each parameter in units of the fineness, hel in edge lengths
        steps = {"off_x": ("hel", 1.0), "off_y": ("hel", 1.0), "tilt": (None, 0.1), "hel": ("hel", 0.1), "phi": (None, 0.3), "excent": (None, 0.05)}
        p, score = p.copy(), np.zeros(p.shape[1])
        fine, rows = np.full(p.shape[1], fine), np.arange(p.shape[1])
        while len(rows):
            now = p[:, rows]
            trials = np.repeat(now[:, :, None], 1 + 2 * len(steps), axis=2)
            for k, (axis, (unit, size)) in enumerate(steps.items()):
                step = fine[rows] * size * (now[GEOMETRY.index(unit)] if unit else 1.0)
                trials[GEOMETRY.index(axis), :, 1 + 2 * k] += step
                trials[GEOMETRY.index(axis), :, 2 + 2 * k] -= step
            k, score[rows] = self.best(rows, trials)
            p[:, rows] = trials[:, np.arange(len(rows)), k]
            fine[rows[k == 0]] /= 2
            rows = rows[fine[rows] > least]
        return p, score

    def zoom(self, p: np.ndarray, widths, stability: int, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Boxes around the best point that halve, cycle after cycle while a cycle gains more
        than one percent; also whether a best point was on the rim of a first box."""
        p, score, at_edge = p.copy(), np.zeros(p.shape[1]), np.zeros(p.shape[1], bool)
        rows, cycle = np.arange(p.shape[1]), 0
        box = [(0, 0)] + [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        i, j = np.array(box).T
        while len(rows):
            before = score[rows]
            rel, angle = widths[max(stability - cycle, 0)]
            for a, b in (("hel", "tilt"), ("excent", "phi")):
                for level in range(levels):
                    scale = 0.5**level
                    trials = np.repeat(p[:, rows][:, :, None], len(box), axis=2)
                    trials[GEOMETRY.index(a)] *= 1 + rel * scale * i
                    trials[GEOMETRY.index(b)] += angle * scale * j
                    k, score[rows] = self.best(rows, trials)
                    p[:, rows] = trials[:, np.arange(len(rows)), k]
                    if level == 0:
                        at_edge[rows] |= (i[k] != 0) | (j[k] != 0)
            now = score[rows]
            with np.errstate(all="ignore"):
                rows = rows[(now != 0) & ((now - before) / now > 0.01)]
            cycle += 1
        return p, score, at_edge


class CellScore:
    """Scores of lattices on the pixels of one frame."""

    def __init__(self, x, y, value, mask, bond: int, res: int, width: int, height: int, sub: int = 1, shape: bool = True):
        self.block = CellScores([(x, y, value, mask)], bond, res, width, height, sub, shape)

    def score(self, p: dict[str, float]) -> float:
        return float(self.block.score(np.zeros(1, int), _column(p)[:, :, None])[0, 0])


def _column(p: dict[str, float]) -> np.ndarray:
    return np.array([[p[g]] for g in GEOMETRY], float)


def refine(frame: CellScore, p: dict[str, float], fine: float, least: float) -> tuple[dict[str, float], float]:
    """``CellScores.refine`` of one frame."""
    found, score = frame.block.refine(_column(p), fine, least)
    return p | dict(zip(GEOMETRY, found[:, 0].tolist())), float(score[0])
