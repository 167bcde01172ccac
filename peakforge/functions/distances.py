"""Distance kernels on two bounded blocks of vectors (NumPy, inside a task)."""

from __future__ import annotations

import math
import threading

import numpy as np

# Entries of a distance block held at once (8 bytes each): what stays near the processor.
CELLS = 262_144


class _Held(threading.local):
    """Arrays of one thread, which stay behind when the code is sent to a task."""

    def __reduce__(self):
        return _Held, ()


_held = _Held()


def scratch(name: str, shape: tuple[int, ...], kind) -> np.ndarray:
    """An array of the task's own, used again and again: fresh memory costs more, page by page, than the arithmetic done in it."""
    n = math.prod(shape) * np.dtype(kind).itemsize
    held = _held.__dict__.get(name)
    if held is None or len(held) < n:
        held = _held.__dict__[name] = np.empty(n, np.uint8)
    return held[:n].view(kind).reshape(shape)


def chunks(n_rows: int, n_columns: int, depth: int = 1):
    step = max(1, CELLS // max(1, n_columns * depth))
    for lo in range(0, n_rows, step):
        yield slice(lo, min(lo + step, n_rows))


def full(q: np.ndarray, s: np.ndarray, metric: str) -> np.ndarray:
    """All distances of a block pair; the Euclidean form is the matrix product, so it is rounded near zero."""
    if metric == "euclidean":
        square = (-2.0 * q) @ s.T
        square += (s * s).sum(1)[None, :]
        square += (q * q).sum(1)[:, None]
        np.maximum(square, 0.0, out=square)
        return np.sqrt(square, out=square)
    out = np.empty((len(q), len(s)))
    for part in chunks(len(q), len(s), q.shape[1]):
        out[part] = np.abs(q[part, None, :] - s[None, :, :]).sum(2)
    return out


class Sums:
    """Weighted sums of the distances to the rows of s, for the columns of ``weights`` (rows of s x sums), in parts of bounded size."""
    rows, columns = 256, 512

    def __init__(self, s: np.ndarray, weights: np.ndarray, metric: str):
        self.metric, self.weights, self.s = metric, weights, s
        if metric == "euclidean":
            self.s = np.ascontiguousarray(np.concatenate([s, (s * s).sum(1)[:, None], np.ones((len(s), 1))], axis=1).T)

    def of(self, q: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), self.weights.shape[1]))
        if self.metric == "euclidean":
            q = np.concatenate([-2.0 * q, np.ones((len(q), 1)), (q * q).sum(1)[:, None]], axis=1)
        for rows in (slice(i, i + self.rows) for i in range(0, len(q), self.rows)):
            for columns in (slice(i, i + self.columns) for i in range(0, len(self.weights), self.columns)):
                if self.metric == "euclidean":
                    a, b = q[rows], self.s[:, columns]
                    d = np.matmul(a, b, out=scratch("distances", (len(a), b.shape[1]), np.float64))
                    np.maximum(d, 0.0, out=d)
                    np.sqrt(d, out=d)
                else:
                    d = full(q[rows], self.s[columns], self.metric)
                out[rows] += d @ self.weights[columns]
        return out


def exact(q: np.ndarray, s: np.ndarray, metric: str) -> np.ndarray:
    """Distances of paired rows from their differences."""
    gap = q - s
    return np.sqrt(np.einsum("ij,ij->i", gap, gap)) if metric == "euclidean" else np.abs(gap).sum(1)


def _ranked(q, s, k, metric):
    """``nearest`` on full distances: for vectors with values that are no numbers."""
    rows, cols, dist = [], [], []
    size = np.sqrt((s * s).sum(1).max())
    for part in chunks(len(q), len(s)):
        block = q[part]
        d = full(block, s, metric)
        kth = np.partition(d, k - 1, axis=1)[:, k - 1]
        if metric == "euclidean":
            scale = (np.sqrt((block * block).sum(1)) + size) ** 2
            limit = np.sqrt(kth * kth + 1e-9 * scale)
        else:
            limit = kth * (1 + 1e-9)
        i, j = np.nonzero(d <= limit[:, None])
        e = exact(block[i], s[j], metric)
        order = np.lexsort((j, e, i))
        i, j, e = i[order], j[order], e[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
        rows.append(i[keep] + part.start)
        cols.append(j[keep])
        dist.append(e[keep])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)


def _bounded(x: np.ndarray) -> bool:
    """Whether all values are numbers with a square that is one."""
    return bool(x.max(initial=0.0) < 1e150 and x.min(initial=0.0) > -1e150)


class _Squares:
    """Rough squared distances in single precision by matrix product, less the row's own square; vectors moved to the middle of s and scaled."""
    rows, columns = 512, 1024

    def __init__(self, s):
        self.middle = s.mean(0)
        s = s - self.middle
        own = np.einsum("ij,ij->i", s, s)
        self.size = np.sqrt(own.max()) or 1.0
        self.s = np.empty((s.shape[1] + 1, len(s)), np.float32)
        self.s[:-1] = s.T / self.size
        self.s[-1] = own / self.size ** 2
        # No entry of a vector is above 1 and no rough value above 4.
        self.error = 16.0 * (s.shape[1] + 8) * 2.0 ** -24

    def ask(self, q):
        q = np.subtract(q, self.middle, out=scratch("moved", q.shape, np.float64))
        own = np.einsum("ij,ij->i", q, q)
        self.unit = max(np.sqrt(own.max()), self.size)
        self.own = own / self.unit ** 2
        self.q = scratch("left", (len(q), q.shape[1] + 1), np.float32)
        np.multiply(q, -2.0 * (self.size / self.unit) / self.unit, out=self.q[:, :-1], casting="same_kind")
        self.q[:, -1] = (self.size / self.unit) ** 2

    def rough(self, rows, cols):
        q, s = self.q[rows], self.s[:, cols]
        return np.matmul(q, s, out=scratch("rough", (len(q), s.shape[1]), np.float32))

    def bound(self, rows, reach):
        """Rough value up to which an exact distance of ``reach`` may have come out."""
        return (reach / self.unit) ** 2 - self.own[rows] + self.error


class _Sums:
    """Rough sums of differences in small whole numbers; vectors moved to the middle of s and scaled by its range.

    A value of q outside the range of s is cut to it: what is cut off is part of the distance to every row of s.
    """
    rows, columns = 64, 4096

    def __init__(self, s):
        d = max(s.shape[1], 1)
        self.low, self.high = s.min(0), s.max(0)
        self.middle = self.low / 2 + self.high / 2
        self.kind, most = (np.int16, 16_000 // d) if d <= 1000 else (np.int32, 1_000_000_000 // d)
        self.unit = (np.abs(self.high / 2 - self.low / 2).max(initial=0.0) / most) or 1.0
        self.s = np.ascontiguousarray(self._whole(s).T)
        self.error = d + 2.0  # half a unit of each value

    def _whole(self, x):
        return np.rint((x - self.middle) / self.unit).astype(self.kind)

    def ask(self, q):
        inside = np.clip(q, self.low, self.high)
        self.q, self.own = self._whole(inside), np.abs(q - inside).sum(1)

    def rough(self, rows, cols):
        q, s = self.q[rows], self.s[:, cols]
        out, one = (scratch(name, (len(q), s.shape[1]), s.dtype) for name in ("rough", "one"))
        out.fill(0)
        for j in range(q.shape[1]):
            np.subtract(s[j], q[:, j, None], out=one)
            np.abs(one, out=one)
            np.add(out, one, out=out)
        return out

    def bound(self, rows, reach):
        return np.clip((reach - self.own[rows]) / self.unit + self.error, -1.0, np.iinfo(self.s.dtype).max)


class Side:
    """Rows to be searched, made ready once for many calls of ``nearest``."""

    def __init__(self, s: np.ndarray, metric: str = "euclidean"):
        self.s, self.metric = s, metric
        self.sketch = (_Squares if metric == "euclidean" else _Sums)(s) if len(s) and _bounded(s) else None


def nearest(q: np.ndarray, side: np.ndarray | Side, k: int, metric: str = "euclidean", limit: np.ndarray | None = None):
    """For each row of q its k nearest rows of a side, ties to the earlier row: (row, column, distance), sorted.

    ``limit``: only columns up to that distance of a row are wanted. Rough distances with a bound of their error shortlist every
    column that can be among the k, in parts: what a row has found in one part limits the next. The shortlist is ranked on
    exact distances.
    """
    if not isinstance(side, Side):
        side = Side(side, metric)
    s, sketch = side.s, side.sketch
    k = min(k, len(s))
    if k == 0 or len(q) == 0:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    if sketch is None or not _bounded(q):  # NaN or infinite, or squares would be
        return _ranked(q, s, k, side.metric)
    sketch.ask(q)
    rows, cols, dist = [], [], []
    for lo in range(0, len(q), sketch.rows):
        part = slice(lo, min(lo + sketch.rows, len(q)))
        block, n = q[part], part.stop - lo
        reach = np.full(n, np.inf) if limit is None else np.array(limit[part], dtype=np.float64)
        best, found = np.full((n, k), np.inf), []
        for left in range(0, len(s), sketch.columns):
            rough = sketch.rough(part, slice(left, left + sketch.columns))
            top = sketch.bound(part, reach)
            free = np.flatnonzero(np.isinf(reach))
            if len(free) and k <= rough.shape[1]:
                # twice the error: once for the k that are nearest by rough value, once for all that may be nearer
                top[free] = np.partition(rough[free], k - 1, axis=1)[:, k - 1] + 2 * sketch.error
            # rounded up to the kind of the rough values
            top = np.ceil(np.minimum(top, np.iinfo(rough.dtype).max)) if rough.dtype.kind == "i" else np.nextafter(top.astype(rough.dtype), np.float32(np.inf))
            near = np.less_equal(rough, top.astype(rough.dtype)[:, None], out=scratch("near", rough.shape, np.bool_))
            i, j = np.divmod(np.flatnonzero(near), rough.shape[1])
            if not len(i):
                continue
            j += left
            e = exact(block[i], s[j], side.metric)
            found.append((i, j, e))
            order = np.lexsort((e, i))
            i, e = i[order], e[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i, side="left")
            some, at = np.unique(i, return_inverse=True)
            wider = np.full((len(some), k), np.inf)
            wider[at[rank < k], rank[rank < k]] = e[rank < k]
            best[some] = np.partition(np.concatenate([best[some], wider], axis=1), k - 1, axis=1)[:, :k]
            reach[some] = np.minimum(reach[some], best[some].max(1) * (1 + 1e-9))
        if not found:
            continue
        i, j, e = (np.concatenate(c) for c in zip(*found))
        keep = e <= reach[i]
        i, j, e = i[keep], j[keep], e[keep]
        order = np.lexsort((j, e, i))
        i, j, e = i[order], j[order], e[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
        rows.append(i[keep] + lo)
        cols.append(j[keep])
        dist.append(e[keep])
    if not rows:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)
