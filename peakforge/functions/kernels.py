"""NumPy stencils and solvers for Arrow batches.

Each kernel works on a (rows x points) block, so a batch of equally long spectra is one vectorised call. They hold no
state and see only what Spark hands to the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


# ---- Arrow <-> NumPy ------------------------------------------------------------------------------------------------

def split_lists(column: pa.ListArray):
    """Flat float values and the offsets of each list."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat, offsets


def to_matrix(column: pa.ListArray) -> np.ndarray:
    flat, offsets = split_lists(column)
    n = len(column)
    return flat[offsets[0]:offsets[-1]].reshape(n, -1) if n else np.zeros((0, 0))


def from_matrix(block: np.ndarray) -> pa.ListArray:
    n, d = block.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * d)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(block, dtype=np.float64).ravel()))


def from_rows(rows) -> pa.ListArray:
    """List column from one array per row; None stays NULL."""
    sizes = np.array([0 if r is None else len(r) for r in rows], dtype=np.int32)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    parts = [np.asarray(r, dtype=np.float64) for r in rows if r is not None]
    flat = pa.array(np.concatenate(parts) if parts else np.zeros(0))
    mask = pa.array([r is None for r in rows], type=pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=mask)


def by_length(column: pa.ListArray, kernel) -> pa.ListArray:
    """Apply a block kernel to a ragged list column, one call per distinct length."""
    flat, offsets = split_lists(column)
    sizes = np.diff(offsets)
    null = column.is_null().to_numpy(zero_copy_only=False)
    rows = [None] * len(column)
    for size in np.unique(sizes[~null]):
        where = np.flatnonzero((sizes == size) & ~null)
        block = flat[offsets[where][:, None] + np.arange(size)]
        done = kernel(block)
        if done is not None:
            for i, row in zip(where, done):
                rows[i] = row
    return from_rows(rows)


# ---- smoothing and baselines ----------------------------------------------------------------------------------------

def smoother_matrix(halfwindow: int = 10, order: int = 3) -> np.ndarray:
    """Least-squares polynomial projection of a window: row p holds the taps that give the fitted value at p."""
    x = np.arange(-halfwindow, halfwindow + 1, dtype=np.float64) / max(halfwindow, 1)
    powers = np.vander(x, order + 1)
    q, _ = np.linalg.qr(powers)
    return q @ q.T


def smooth(y: np.ndarray, halfwindow: int = 10, order: int = 3):
    """Savitzky-Golay; the ends take the polynomial fitted to the first and last window. NULL below one window."""
    width = 2 * halfwindow + 1
    if y.shape[1] < width:
        return None
    taps = smoother_matrix(halfwindow, order)
    out = np.empty_like(y)
    inner = np.lib.stride_tricks.sliding_window_view(y, width, axis=1)
    out[:, halfwindow:y.shape[1] - halfwindow] = inner @ taps[halfwindow]
    out[:, :halfwindow] = y[:, :width] @ taps[:halfwindow].T
    out[:, y.shape[1] - halfwindow:] = y[:, -width:] @ taps[halfwindow + 1:].T
    return np.maximum(out, 0.0)


def snip_baseline(y: np.ndarray, iterations: int = 10) -> np.ndarray:
    """Clipped-peak baseline on the doubly logarithmic scale, windows widening from 1 to ``iterations``."""
    n = y.shape[1]
    v = np.log(np.log(np.sqrt(y + 1.0) + 1.0) + 1.0)
    at = np.arange(n)
    for reach in range(1, iterations + 1):
        left, right = np.maximum(at - reach, 0), np.minimum(at + reach, n - 1)
        v = np.minimum(v, (v[:, left] + v[:, right]) / 2.0)
    return np.square(np.exp(np.exp(v) - 1.0) - 1.0) - 1.0


def solve_smooth(weights: np.ndarray, target: np.ndarray, lam: float) -> np.ndarray:
    """Solve (diag(w) + lam * D D') z = w * y for every row at once; D' takes second differences.

    The matrix has five diagonals, so one LDL' sweep down and one sweep back, each vectorised over the rows.
    """
    rows, n = target.shape
    main, near, far = np.zeros(n), np.zeros(n), np.zeros(n)
    for offset, c in enumerate((1.0, -2.0, 1.0)):
        main[offset:n - 2 + offset] += lam * c * c
    near[:n - 2] += lam * -2.0
    near[1:n - 1] += lam * -2.0
    far[:n - 2] += lam
    w, y = weights.T.copy(), target.T
    d, l1, l2 = np.empty((n, rows)), np.zeros((n, rows)), np.zeros((n, rows))
    z = w * y
    for i in range(n):
        pivot = w[i] + main[i]
        if i >= 1:
            pivot = pivot - d[i - 1] * l1[i - 1] ** 2
            z[i] -= l1[i - 1] * z[i - 1]
        if i >= 2:
            pivot = pivot - d[i - 2] * l2[i - 2] ** 2
            z[i] -= l2[i - 2] * z[i - 2]
        d[i] = pivot
        if i + 1 < n:
            l1[i] = (near[i] - (l2[i - 1] * d[i - 1] * l1[i - 1] if i >= 1 else 0.0)) / pivot
        if i + 2 < n:
            l2[i] = far[i] / pivot
    z /= d
    for i in range(n - 2, -1, -1):
        z[i] -= l1[i] * z[i + 1]
        if i + 2 < n:
            z[i] -= l2[i] * z[i + 2]
    return z.T


def ls_baseline(y: np.ndarray, kind: str = "ALS", lam: float = 1e8, p: float = 0.01, max_iter: int = 10,
                tol: float = 1e-6) -> np.ndarray:
    """Re-weighted least-squares baseline; every row stops on its own once its weights settle."""
    z, w = np.zeros_like(y), np.ones_like(y)
    live = np.arange(len(y))
    for _ in range(max_iter + 1):
        base = solve_smooth(w[live], y[live], lam)
        z[live] = base
        gap = y[live] - base
        if kind == "ALS":
            new = p * (gap > 0) + (1.0 - p) * (gap < 0)
        else:
            below = gap < 0
            count = np.maximum(below.sum(1), 1)
            mean = np.where(below, gap, 0.0).sum(1) / count
            std = np.sqrt(np.where(below, (gap - mean[:, None]) ** 2, 0.0).sum(1) / count)
            std = np.where(std == 0, np.finfo(float).tiny, std)
            new = 1.0 / (1.0 + np.exp(np.minimum(2.0 * (gap - (2.0 * std - mean)[:, None]) / std[:, None], 70.0)))
        moved = np.linalg.norm(new - w[live], axis=1) / np.linalg.norm(w[live], axis=1)
        w[live] = new
        live = live[moved > tol]
        if not len(live):
            break
    return z


# ---- peaks, grids, bins ---------------------------------------------------------------------------------------------

def persistence(y: np.ndarray) -> np.ndarray:
    """Persistence of each local maximum when the level sinks from the top; other points get 0.

    A peak ends where its component meets a higher one (of equal ones the left lasts); the highest lasts down to the minimum. A flat top
    counts at its first point. Only tops and the valleys between them are looked at: in each round every top ends whose higher valley
    leads to a higher top, and its lower valley goes on between the neighbours.
    """
    out = np.zeros(len(y))
    if not len(y):
        return out
    at = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
    rising = np.r_[True, y[at][1:] > y[at][:-1], False]
    top = at[rising[:-1] & ~rising[1:]]
    low = np.minimum.reduceat(y, top)[:-1]
    while len(top) > 1:
        height = y[top]
        left, right = np.r_[-np.inf, low], np.r_[low, -np.inf]
        over_left = (left >= right) & np.r_[False, height[:-1] >= height[1:]]
        over_right = ~over_left & (right >= left) & np.r_[height[1:] > height[:-1], False]
        ends = over_left | over_right
        if not ends.any():
            break
        out[top[ends]] = (height - np.maximum(left, right))[ends]
        low = low[~(over_right[:-1] | over_left[1:])]
        top = top[~ends]
    out[top[0]] = y[top[0]] - y.min()
    return out


def resample(mz: np.ndarray, y: np.ndarray, n: int = 1000):
    grid = np.linspace(mz.min(), mz.max(), n)
    return grid, np.interp(grid, mz, y)


def equal_edges(start=2000, stop=20000, step=3) -> np.ndarray:
    return np.arange(start, stop + 1e-8, step, dtype=np.float64)


def log_edges(start=2000, stop=20000, n=100) -> np.ndarray:
    return np.logspace(np.log10(start), np.log10(stop), n + 1)


def locate(mz: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin of each point, half-open with the last bin closed; -1 outside."""
    at = np.searchsorted(edges, mz, side="right") - 1
    at[mz == edges[-1]] = len(edges) - 2
    at[(mz < edges[0]) | (mz > edges[-1])] = -1
    return at


def bin_values(mz: np.ndarray, y: np.ndarray, edges: np.ndarray, agg: str = "sum") -> np.ndarray:
    at = locate(mz, edges)
    keep = at >= 0
    at, y, n = at[keep], y[keep], len(edges) - 1
    count = np.bincount(at, minlength=n).astype(np.float64)
    if agg == "count":
        return count
    with np.errstate(divide="ignore", invalid="ignore"):
        if agg in ("sum", "mean", "std"):
            out = np.bincount(at, weights=y, minlength=n)
            if agg != "sum":
                out = out / count
            if agg == "std":
                out = np.sqrt(np.bincount(at, weights=(y - out[at]) ** 2, minlength=n) / count)
        else:
            out = np.full(n, np.nan)
            order = np.lexsort((y, at))
            at, y = at[order], y[order]
            used, first = np.unique(at, return_index=True)
            last = np.append(first[1:], len(at)) - 1
            out[used] = {"min": lambda: y[first], "max": lambda: y[last],
                         "median": lambda: (y[(first + last) // 2] + y[(first + last + 1) // 2]) / 2.0}[agg]()
    return np.nan_to_num(out)


def bin_ranges(mz: np.ndarray, y: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum per closed range of the rounded m/z; a point on a shared boundary counts in both ranges."""
    order = np.argsort(mz, kind="stable")
    r, sums = np.round(mz[order]), np.concatenate([[0.0], np.cumsum(y[order])])
    lo, hi = np.searchsorted(r, starts, side="left"), np.searchsorted(r, ends, side="right")
    return np.where(hi > lo, sums[hi] - sums[np.minimum(lo, hi)], 0.0)
