"""Scan-line spans: the pixels of shapes as rows (row, from, to), ends included, each pixel once."""

from __future__ import annotations

import numpy as np


def _united(spans: np.ndarray, width: np.ndarray) -> np.ndarray:
    """merged() for spans (ring, row, from, to) of many rings, with the width of each ring's picture."""
    ring, row, a, b = spans[:, 0], spans[:, 1], np.maximum(spans[:, 2], 0), np.minimum(spans[:, 3], width[spans[:, 0]] - 1)
    keep = a <= b
    ring, row, a, b = ring[keep], row[keep], a[keep], b[keep]
    if not len(row):
        return np.zeros((0, 4), np.int64)
    order = np.lexsort((a, row, ring))
    ring, row, a, b = ring[order], row[order], a[order], b[order]
    line = np.cumsum(np.r_[0, (row[1:] != row[:-1]) | (ring[1:] != ring[:-1])])
    base = line * (int(width.max()) + 2)  # rows end to end, with room between them
    reach = np.maximum.accumulate(base + b)
    first = np.flatnonzero(np.r_[True, base[1:] + a[1:] > reach[:-1] + 1])
    last = np.r_[first[1:] - 1, len(row) - 1]
    return np.column_stack([ring[first], row[first], a[first], reach[last] - base[last]])


def merged(spans: np.ndarray, width: int) -> np.ndarray:
    """The same pixels with spans that meet or touch put together, by row and place; pixels left or right of the picture go."""
    spans = np.asarray(spans, np.int64).reshape(-1, 3)
    return _united(np.column_stack([np.zeros(len(spans), np.int64), spans]), np.array([width]))[:, 1:]


def filled_rings(x: np.ndarray, y: np.ndarray, bounds: np.ndarray, width: np.ndarray, height: np.ndarray) -> np.ndarray:
    """Spans (ring, row, from, to) of many polygons: pixels whose centre is in them by the even-odd rule or on their border, each pixel of a ring once.

    A ring's vertices lie between neighbouring bounds; widths and heights are of each ring's picture. Rings of fewer than three vertices are empty.
    """
    size, found = np.diff(bounds), []
    # boxes need no edges
    four = np.flatnonzero(size == 4)
    (p, q, r, t), (i, j, k, m) = (np.moveaxis(v[bounds[four][:, None] + np.arange(4)], 1, 0) for v in (x, y))
    box = ((p == t) & (q == r) & (i == j) & (k == m)) | ((p == q) & (r == t) & (j == k) & (i == m))
    four, xa, xb, ya, yb = four[box], np.minimum(p, r)[box], np.maximum(p, r)[box], np.minimum(i, k)[box], np.maximum(i, k)[box]
    first, last = np.maximum(np.ceil(ya), 0).astype(np.int64), np.minimum(np.floor(yb), height[four] - 1).astype(np.int64)
    a, b = np.maximum(np.ceil(xa), 0).astype(np.int64), np.minimum(np.floor(xb), width[four] - 1).astype(np.int64)
    n = np.where((a <= b) & (ya < yb), np.maximum(last - first + 1, 0), 0)
    each = np.repeat(np.arange(len(four)), n)
    boxes = np.column_stack([four[each], first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n), a[each], b[each]])
    # other polygons by their edges
    other = size >= 3
    other[four] = False
    if not other.any():
        return boxes
    following = np.arange(1, len(x) + 1)
    following[bounds[1:][size > 0] - 1] = bounds[:-1][size > 0]
    ring = np.repeat(np.arange(len(size)), size)
    use = other[ring]
    following, ring = following[use], ring[use]
    x, y, xn, yn = x[use], y[use], x[following], y[following]
    low, high = np.minimum(y, yn), np.maximum(y, yn)
    # an edge holds its lower end in the first pass and its upper end in the second, so that borders of both sides are met
    for first, last in ((np.ceil(low), np.ceil(high) - 1), (np.floor(low) + 1, np.floor(high))):
        first, last = np.maximum(first, 0).astype(np.int64), np.minimum(last, height[ring] - 1).astype(np.int64)
        n = np.maximum(last - first + 1, 0)
        edge = np.repeat(np.arange(len(x)), n)
        row = first[edge] + np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n)
        at = x[edge] + (row - y[edge]) / (yn[edge] - y[edge]) * (xn[edge] - x[edge])
        order = np.lexsort((at, row, ring[edge]))
        found.append(np.column_stack([ring[edge][order][::2], row[order][::2], np.ceil(at[order][::2]), np.floor(at[order][1::2])]).astype(np.int64))
    return np.concatenate([boxes, _united(np.concatenate(found), width)])


def filled(ring: np.ndarray, width: int, height: int) -> np.ndarray:
    """Spans of one polygon (n x 2 of x, y), by row and place."""
    if len(ring) < 3:
        return np.zeros((0, 3), np.int64)
    x, y = np.asarray(ring, float).T
    return filled_rings(x, y, np.array([0, len(x)]), np.array([width]), np.array([height]))[:, 1:]


def line(p: np.ndarray, q: np.ndarray, thickness: float, height: int) -> np.ndarray:
    """Spans of the pixels within half the thickness of the segment from p to q; not cut at the picture's sides."""
    r = thickness / 2
    (px, py), (qx, qy) = map(tuple, np.asarray([p, q], float))
    row = np.arange(max(0, int(np.ceil(min(py, qy) - r))), min(height - 1, int(np.floor(max(py, qy) + r))) + 1, dtype=float)
    low, high = np.full(len(row), np.inf), np.full(len(row), -np.inf)
    with np.errstate(invalid="ignore"):
        for x, y in ((px, py), (qx, qy)):  # round ends
            half = np.sqrt(r * r - (row - y) ** 2)
            low, high = np.fmin(low, x - half), np.fmax(high, x + half)
    length = np.hypot(qx - px, qy - py)
    if length:
        dx, dy = (qx - px) / length, (qy - py) / length
        # between the ends: 0 <= t <= length along the line, -r <= s <= r across it; both go in proportion with x
        a, b = np.full(len(row), -np.inf), np.full(len(row), np.inf)
        for slope, fixed, least, most in ((dx, (row - py) * dy, 0.0, length), (-dy, (row - py) * dx, -r, r)):
            if slope:
                u, v = (least - fixed) / slope + px, (most - fixed) / slope + px
                a, b = np.maximum(a, np.minimum(u, v)), np.minimum(b, np.maximum(u, v))
            else:
                out = (fixed < least) | (fixed > most)
                a, b = np.where(out, np.inf, a), np.where(out, -np.inf, b)
        inside = a <= b
        low, high = np.where(inside, np.minimum(low, a), low), np.where(inside, np.maximum(high, b), high)
    some = low <= high
    tidy = 1e-9  # so that pixels exactly at the edge count on both sides
    return np.column_stack([row[some], np.ceil(low[some] - tidy), np.floor(high[some] + tidy)]).astype(np.int64)


def outline(ring: np.ndarray, thickness: float, width: int, height: int) -> np.ndarray:
    """Spans of a closed line through the ring's vertices."""
    ring = np.asarray(ring, float)
    parts = [line(ring[k - 1], ring[k], thickness, height) for k in range(len(ring))]
    return merged(np.concatenate(parts) if parts else np.zeros((0, 3)), width)
