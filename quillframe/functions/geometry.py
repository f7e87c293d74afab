"""Boxes as column expressions, polygons as numpy kernels for grouped work."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x1", "y1", "width", "height")


def has_box(prefix: str = "") -> Column:
    out = F.col(prefix + "x1").isNotNull()
    for c in BOX[1:]:
        out = out & F.col(prefix + c).isNotNull()
    return out


def overlap_area(a: str, b: str) -> Column:
    """Area of the intersection of two boxes whose columns have these prefixes."""
    c = lambda p, n: F.col(p + n)
    width = F.least(c(a, "x1") + c(a, "width"), c(b, "x1") + c(b, "width")) - F.greatest(c(a, "x1"), c(b, "x1"))
    height = F.least(c(a, "y1") + c(a, "height"), c(b, "y1") + c(b, "height")) - F.greatest(c(a, "y1"), c(b, "y1"))
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def iou(a: str, b: str) -> Column:
    both = overlap_area(a, b)
    union = F.col(a + "width") * F.col(a + "height") + F.col(b + "width") * F.col(b + "height") - both
    return F.when(union > 0, both / union).otherwise(0.0)


def box_corners(x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """The four corners, clockwise from the first, as array of (x, y)."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(x1, y1), corner(x1 + width, y1), corner(x1 + width, y1 + height), corner(x1, y1 + height))


def in_ring(ring: str, x: str, y: str) -> Column:
    """Whether a point is in a polygon (an array of structs with x and y) or on its border; false for an empty ring."""
    px, py = F.col(x), F.col(y)
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    edges = F.arrays_zip(F.col(ring).alias("p"), following.alias("q"))

    def on_line(e: Column) -> Column:
        ax, ay, bx, by = (e[k][c] for k, c in (("p", "x"), ("p", "y"), ("q", "x"), ("q", "y")))
        return ((bx - ax) * (py - ay) == (by - ay) * (px - ax)) & (F.least(ax, bx) <= px) & (px <= F.greatest(ax, bx)) & (F.least(ay, by) <= py) & (py <= F.greatest(ay, by))

    def crossed(e: Column) -> Column:
        ax, ay, bx, by = (e[k][c] for k, c in (("p", "x"), ("p", "y"), ("q", "x"), ("q", "y")))
        return ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / F.nullif(by - ay, F.lit(0)) + ax)

    return F.exists(edges, on_line) | (F.size(F.filter(edges, crossed)) % 2 == 1)


def slab_areas(rings: list[np.ndarray]) -> tuple[float, float]:
    """Areas of the intersection and of the union of polygons (n x 2 arrays of x, y; even-odd inside each), exact for straight edges.

    The plane is cut into horizontal slabs at every vertex and every crossing of two edges. Within a slab no edges cross, so inside it
    each polygon is a set of trapezoids between neighbouring edges.
    """
    edges = np.concatenate([np.hstack([r, np.roll(r, -1, 0), np.full((len(r), 1), k)]) for k, r in enumerate(rings)])
    edges = edges[edges[:, 1] != edges[:, 3]]
    if not len(edges):
        return 0.0, 0.0
    x1, y1, x2, y2, owner = edges.T
    dx, dy = x2 - x1, y2 - y1
    cross = dx[:, None] * dy[None] - dy[:, None] * dx[None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((x1[None] - x1[:, None]) * dy[None] - (y1[None] - y1[:, None]) * dx[None]) / cross
        u = ((x1[None] - x1[:, None]) * dy[:, None] - (y1[None] - y1[:, None]) * dx[:, None]) / cross
    ok = (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    levels = np.unique(np.concatenate([y1, y2, (y1[:, None] + t * dy[:, None])[ok]]))
    low, high = np.minimum(y1, y2), np.maximum(y1, y2)
    common = union = 0.0
    for a, b in zip(levels[:-1], levels[1:], strict=True):
        mid = (a + b) / 2
        inside = np.flatnonzero((low <= mid) & (high >= mid) & (low < high))
        if not len(inside) or b <= a:
            continue
        x = x1[inside] + (mid - y1[inside]) / dy[inside] * dx[inside]
        order = np.argsort(x, kind="stable")
        parity = np.zeros(len(rings), bool)
        before = None
        for k in order:
            if before is not None:
                width = (x[k] - before) * (b - a)
                common += width * parity.all()
                union += width * parity.any()
            parity[int(owner[inside[k]])] ^= True
            before = x[k]
    return float(common), float(union)


def overlap_bound(rings: list[np.ndarray]) -> float:
    """No less than the share of the union that all polygons have in common: the boxes' common area over the largest polygon's."""
    sides = np.min([r.max(0) for r in rings], axis=0) - np.max([r.min(0) for r in rings], axis=0)
    if (sides <= 0).any():
        return 0.0
    largest = max(map(ring_area, rings))
    return float(sides.prod()) / largest if largest else 1.0


def polygon_iou(a: np.ndarray, b: np.ndarray) -> float:
    common, union = slab_areas([a, b])
    return common / union if union else 0.0


def _cut(ring: np.ndarray, axis: int, limit: float, sign: int) -> list[np.ndarray]:
    """The rings of a polygon on one side of a line: sign * (coordinate - limit) > 0.

    What is left of the outline are chains between crossings of the line. Along the line, the polygon lies between the first and the second crossing, the third
    and the fourth, and so on; each chain goes on from where it meets the line to the other end of that stretch.
    """
    inside = sign * (ring[:, axis] - limit) > 0
    if inside.all() or not inside.any():
        return [ring] if inside.all() else []
    n = len(ring)
    enters = np.flatnonzero(inside & ~np.roll(inside, 1))  # first vertex of each chain
    chains, ends = [], []  # ends: where a chain begins and stops on the line
    for first in enters:
        last = first
        while inside[(last + 1) % n]:
            last += 1
        points = ring[np.arange(first, last + 1) % n]
        crossed = []
        for p, q in ((ring[first - 1], points[0]), (ring[(last + 1) % n], points[-1])):
            cut = p + (limit - p[axis]) / (q[axis] - p[axis]) * (q - p)
            cut[axis] = limit
            crossed.append(cut)
        chains.append(np.vstack([crossed[0], points, crossed[1]]))
        ends += [crossed[0][1 - axis], crossed[1][1 - axis]]
    order = np.argsort(ends, kind="stable")
    partner = np.empty(len(ends), np.int64)
    partner[order[::2]], partner[order[1::2]] = order[1::2], order[::2]
    out, left = [], set(range(len(chains)))
    while left:
        start = now = min(left)
        forward, parts = True, []
        while now in left:
            left.remove(now)
            parts.append(chains[now] if forward else chains[now][::-1])
            other = int(partner[2 * now + forward])  # the end that the chain stops at goes on to its partner
            now, forward = other // 2, other % 2 == 0
        out.append(np.vstack(parts))
    return out


def ring_area(ring: np.ndarray) -> float:
    return abs(float(np.dot(ring[:, 0], np.roll(ring[:, 1], -1)) - np.dot(np.roll(ring[:, 0], -1), ring[:, 1]))) / 2 if len(ring) else 0.0


def clip_ring(ring: np.ndarray, width: float, height: float) -> list[np.ndarray]:
    """The rings of the part of a polygon within [0, width] x [0, height]: several where it leaves and comes back, none if nothing of it has an area inside."""
    rings = [np.asarray(ring, float).reshape(-1, 2)]
    for axis, limit, sign in ((0, 0.0, 1), (0, width, -1), (1, 0.0, 1), (1, height, -1)):
        rings = [part for r in rings if len(r) for part in _cut(r, axis, limit, sign)]
    tidy = (r[(r != np.roll(r, 1, 0)).any(1)] for r in rings)
    return [r for r in tidy if len(r) > 2 and ring_area(r) > 0]


def fill(ring: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels whose centre is in the polygon (even-odd) or that a vertex or an edge passes through at whole coordinates."""
    mask = np.zeros((height, width), bool)
    if len(ring) < 3:
        return mask
    x, y = ring[:, 0], ring[:, 1]
    xn, yn = np.roll(x, -1), np.roll(y, -1)
    for row in range(max(0, int(np.ceil(y.min()))), min(height - 1, int(np.floor(y.max()))) + 1):
        for cond in ((y <= row) != (yn <= row), (y < row) != (yn < row)):
            cuts = np.sort(x[cond] + (row - y[cond]) / (yn[cond] - y[cond]) * (xn[cond] - x[cond]))
            for a, b in zip(cuts[::2], cuts[1::2], strict=False):
                mask[row, max(0, int(np.ceil(a))) : max(0, int(np.floor(b)) + 1)] = True
    return mask
