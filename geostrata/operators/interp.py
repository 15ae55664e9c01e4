"""Interpolation and geometry of small neighbourhoods in numpy, run by tile or cell in grouped Arrow functions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import tiles


def basis(x: np.ndarray, knots: np.ndarray, degree: int = 3) -> np.ndarray:
    """Values of all B-splines of a degree at each x (Cox and de Boor); x outside the knots' span is taken at its end."""
    t = np.asarray(knots, float)
    n = len(t) - degree - 1
    x = np.clip(np.asarray(x, float), t[degree], t[n])
    b = np.zeros((len(x), len(t) - 1))
    at = np.clip(np.searchsorted(t, x, "right") - 1, degree, n - 1)
    b[np.arange(len(x)), at] = 1.0
    for k in range(1, degree + 1):
        new = np.zeros((len(x), len(t) - 1 - k))
        for i in range(len(t) - 1 - k):
            left, right = t[i + k] - t[i], t[i + k + 1] - t[i + 1]
            if left > 0:
                new[:, i] += (x - t[i]) / left * b[:, i]
            if right > 0:
                new[:, i] += (t[i + k + 1] - x) / right * b[:, i + 1]
        b = new
    return b


def knots_for(x: np.ndarray, inner: int, degree: int = 3) -> np.ndarray:
    low, high = float(np.min(x)), float(np.max(x))
    if high <= low:
        high = low + 1.0
    return np.r_[[low] * degree, np.linspace(low, high, inner + 2), [high] * degree]


def _penalty(n: int) -> np.ndarray:
    d = np.diff(np.eye(n), 2, axis=0) if n > 2 else np.zeros((0, n))
    return d.T @ d


class Spline1:
    """Smoothing spline of one variable: the smoothest least-squares fit whose weighted residual is at most s.

    Weights default to 1 / deviation of z and s to the number of points. The penalty on second differences of the
    coefficients is bisected until the residual meets s; a residual that even no penalty brings below s is left there.
    """

    def __init__(self, x: np.ndarray, z: np.ndarray, w: np.ndarray | None = None, s: float | None = None, inner: int | None = None):
        x, z = np.asarray(x, float), np.asarray(z, float)
        spread = float(np.std(z))
        w = np.full(len(z), 1 / spread if spread > 0 else 1.0) if w is None else np.asarray(w, float)
        s = float(len(z)) if s is None else s
        self.knots = knots_for(x, min(max(len(np.unique(x)) - 4, 0), 30) if inner is None else inner)
        self.coefficients = _fit(basis(x, self.knots) * w[:, None], z * w, _penalty(len(self.knots) - 4), s)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return basis(np.atleast_1d(x), self.knots) @ self.coefficients


    def derivative(self, x: np.ndarray, order: int = 1) -> np.ndarray:
        knots, c, degree = self.knots, self.coefficients, 3
        for _ in range(min(order, 4)):
            if degree == 0:
                return np.zeros(len(np.atleast_1d(x)))
            width = knots[degree + 1 : degree + len(c)] - knots[1 : len(c)]
            c, knots, degree = degree * np.diff(c) / np.where(width > 0, width, 1.0), knots[1:-1], degree - 1
        return basis(np.atleast_1d(x), knots, degree) @ c

    def integral(self, a: float, b: float) -> float:
        """Exact: each piece between knots is a cubic, for which three Gauss points are enough."""
        ends = np.unique(np.clip(self.knots, min(a, b), max(a, b)))
        node, weight = np.polynomial.legendre.leggauss(3)
        half = np.diff(ends) / 2
        at = (ends[:-1] + half)[:, None] + half[:, None] * node[None, :]
        return float((self(at.ravel()).reshape(at.shape) * weight * half[:, None]).sum()) * (1.0 if b >= a else -1.0)

    def zeros(self, steps: int = 20) -> np.ndarray:
        """Places where the spline changes its sign, by bisection of a grid between the knots."""
        inner = np.unique(self.knots)
        grid = np.unique(np.concatenate([np.linspace(p, q, steps) for p, q in zip(inner[:-1], inner[1:], strict=True)]))
        low, high = grid[:-1], grid[1:]
        crossing = np.sign(self(low)) != np.sign(self(high))
        low, high = low[crossing], high[crossing]
        for _ in range(60):
            middle = (low + high) / 2
            left = np.sign(self(middle)) == np.sign(self(low)) if len(low) else np.zeros(0, bool)
            low, high = np.where(left, middle, low), np.where(left, high, middle)
        return np.unique(np.round((low + high) / 2, 12))


class Curve:
    """Smoothing spline curve through points of any number of dimensions, over the length along them; closed if the first point is to follow the last."""

    def __init__(self, points: np.ndarray, s: float | None = None, closed: bool = False):
        held = np.asarray(points, float)
        if closed:
            held = np.vstack([held, held[:1]])
        self.at = np.r_[0.0, np.cumsum(np.sqrt((np.diff(held, axis=0) ** 2).sum(1)))]
        self.at /= self.at[-1] if self.at[-1] > 0 else 1.0
        self.closed = closed
        # a closed curve is fitted with its ends laid on again, so that they meet smoothly
        n = min(len(held) - 1, 6) if closed else 0
        at = np.r_[self.at[-1 - n : -1] - 1, self.at, self.at[1 : 1 + n] + 1]
        held = np.vstack([held[-1 - n : -1], held, held[1 : 1 + n]])
        self.axes = [Spline1(at, held[:, d], np.ones(len(at)), (0.0 if s is None else s), min(max(len(at) - 4, 0), 40)) for d in range(held.shape[1])]

    def __call__(self, u: np.ndarray) -> np.ndarray:
        u = np.atleast_1d(np.asarray(u, float))
        return np.column_stack([a(u % 1.0 if self.closed else u) for a in self.axes])


def _fit(a: np.ndarray, b: np.ndarray, penalty: np.ndarray, s: float) -> np.ndarray:
    gram, right = a.T @ a, a.T @ b
    scale = max(float(np.trace(gram)) / max(len(gram), 1), 1e-12)
    tiny = 1e-10 * scale * np.eye(len(gram))
    solve = lambda p: np.linalg.solve(gram + p * scale * penalty + tiny, right)
    residual = lambda c: float(((a @ c - b) ** 2).sum())
    low, high = -8.0, 8.0
    if residual(solve(10**high)) <= s:
        return solve(10**high)
    if residual(solve(10**low)) > s:
        return solve(10**low)
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if residual(solve(10**middle)) <= s else (low, middle)
    return solve(10**low)


class Spline2:
    """Smoothing spline surface of cubic by cubic B-splines over scattered points; as Spline1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, w: np.ndarray | None = None, s: float | None = None, inner: int | None = None):
        x, y, z = (np.asarray(v, float) for v in (x, y, z))
        spread = float(np.std(z))
        w = np.full(len(z), 1 / spread if spread > 0 else 1.0) if w is None else np.asarray(w, float)
        s = float(len(z)) if s is None else s
        inner = min(max(int(math.sqrt(len(z))) - 4, 0), 8) if inner is None else inner
        self.x_knots, self.y_knots = knots_for(x, inner), knots_for(y, inner)
        n, m = len(self.x_knots) - 4, len(self.y_knots) - 4
        penalty = np.kron(_penalty(n), np.eye(m)) + np.kron(np.eye(n), _penalty(m))
        self.coefficients = _fit(self._rows(x, y) * w[:, None], z * w, penalty, s)

    def _rows(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        bx, by = basis(x, self.x_knots), basis(y, self.y_knots)
        return (bx[:, :, None] * by[:, None, :]).reshape(len(x), -1)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self._rows(np.atleast_1d(x), np.atleast_1d(y)) @ self.coefficients

    def grid(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Values on the lattice of x and y (len(x) x len(y))."""
        c = self.coefficients.reshape(len(self.x_knots) - 4, len(self.y_knots) - 4)
        return basis(np.atleast_1d(x), self.x_knots) @ c @ basis(np.atleast_1d(y), self.y_knots).T

    def profile(self, x: float) -> Spline1:
        """The cross-section at an x, as a spline of y."""
        section = Spline1.__new__(Spline1)
        section.knots = self.y_knots
        section.coefficients = (basis(np.array([x]), self.x_knots) @ self.coefficients.reshape(len(self.x_knots) - 4, -1))[0]
        return section

    def integral(self, x0: float, x1: float, y0: float, y1: float) -> float:
        ends = np.unique(np.clip(self.x_knots, min(x0, x1), max(x0, x1)))
        node, weight = np.polynomial.legendre.leggauss(3)
        half = np.diff(ends) / 2
        total = sum(float(h * w * self.profile(m + h * t).integral(y0, y1)) for m, h in zip(ends[:-1] + half, half, strict=True) for t, w in zip(node, weight, strict=True))
        return total * (1.0 if x1 >= x0 else -1.0)


def smooth_tiles(raster: DataFrame, smoothing: float, tile: int, halo: int) -> DataFrame:
    """(band, row, col, value): each cell with data as its tile's smoothing spline has it. A tile is fitted with its halo."""

    def smooth(cells: pa.Table) -> pa.Table:
        r, c, v = (cells.column(n).to_numpy().astype(float) for n in ("row", "col", "value"))
        own = cells.column("own").to_numpy()
        fitted = Spline2(c, r, v, s=smoothing * len(v))(c[own], r[own]) if own.any() else np.zeros(0)
        held = cells.filter(pa.array(own))
        return pa.table({"band": held.column("band"), "row": held.column("row"), "col": held.column("col"), "value": fitted})

    spread = tiles(raster.where(F.col("value").isNotNull()).select("band", "row", "col", F.col("value").cast("double").alias("value")), tile, halo)
    return spread.groupBy("band", "tile_row", "tile_col").applyInArrow(smooth, "band int, row int, col int, value double")


KERNELS = {
    "multiquadric": lambda r, c, g: np.sqrt(r * r + c * c),
    "inverse_multiquadric": lambda r, c, g: 1 / np.sqrt(r * r + c * c),
    "thin_plate": lambda r, c, g: np.where(r > 0, r * r * c * c * np.log(np.where(r > 0, c * r, 1.0)), 0.0),
    "thin_plate_alt": lambda r, c, g: (c * c + r * r) * np.log(c * c + r * r),
    "gaussian": lambda r, c, g: np.exp(-r * r / (2 * g * g)) / (g * math.sqrt(2 * math.pi)),
}


class Rbf:
    """Radial basis interpolator: distance over range into a kernel, with a constant term; 0 beyond 3 ranges of the nearest point."""

    def __init__(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, kernel: str = "multiquadric", span: float = 1.0, clamp: float = 1.0, sigma: float = 1.0):
        self.at = np.column_stack([x, y]).astype(float)
        self.kernel, self.span, self.clamp, self.sigma = KERNELS[kernel], span, clamp, sigma
        n = len(self.at)
        a = np.ones((n + 1, n + 1))
        a[:n, :n] = self._phi(self.at)
        a[n, n] = 0.0
        self.weights = np.linalg.lstsq(a, np.r_[np.asarray(z, float), 0.0], rcond=None)[0]

    def _distance(self, at: np.ndarray) -> np.ndarray:
        return np.sqrt(((at[:, None, :] - self.at[None, :, :]) ** 2).sum(2))

    def _phi(self, at: np.ndarray) -> np.ndarray:
        return self.kernel(self._distance(at) / self.span, self.clamp, self.sigma)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.column_stack([np.atleast_1d(x), np.atleast_1d(y)]).astype(float)
        value = self._phi(at) @ self.weights[:-1] + self.weights[-1]
        return np.where(self._distance(at).min(1) > 3 * self.span, 0.0, value)


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counterclockwise."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(ordered: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in ordered:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    lower, upper = half(p), half(p[::-1])
    return np.array(lower[:-1] + upper[:-1])


def polygon_area(corners: np.ndarray) -> float:
    if len(corners) < 3:
        return 0.0
    x, y = corners[:, 0], corners[:, 1]
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def triangle_area(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Heron's formula for arrays of corners."""
    u, v, w = (np.sqrt(((p - q) ** 2).sum(-1)) for p, q in ((a, b), (b, c), (c, a)))
    s = (u + v + w) / 2
    return np.sqrt(np.maximum(s * (s - u) * (s - v) * (s - w), 0))


#: Up to so many points, testing all triples at once is faster than inserting point by point.
FEW_POINTS = 30


@lru_cache(maxsize=FEW_POINTS + 1)
def _triples(n: int) -> np.ndarray:
    return np.array(list(combinations(range(n), 3)), np.int64)


#: Twice the area, of the extent as a square, under which a triangle is a sliver along the hull and no face.
_SLIVER = 1e-6


def _apart(p: np.ndarray) -> np.ndarray:
    """Points moved by a ten-millionth of the extent, so that no four lie on a circle and no three on a line."""
    i = np.arange(len(p))
    return (p - p.mean(0)) / max(float(np.ptp(p, axis=0).max()), 1e-9) + 1e-7 * np.column_stack([np.sin(i * 12.9898), np.cos(i * 78.233)])


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Twice the signed area of triangles, positive if their corners run counterclockwise."""
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def _few_triangles(q: np.ndarray) -> np.ndarray:
    """All triples whose circumcircle holds no other point."""
    t = _triples(len(q))
    a, b, c = q[t[:, 0]], q[t[:, 1]], q[t[:, 2]]
    d = 2 * _turn(a, b, c)
    wide = np.abs(d) > 2 * _SLIVER
    t, a, b, c, d = t[wide], a[wide], b[wide], c[wide], d[wide]
    far = (q * q).sum(1)
    fa, fb, fc = far[t[:, 0]], far[t[:, 1]], far[t[:, 2]]
    x = (fa * (b[:, 1] - c[:, 1]) + fb * (c[:, 1] - a[:, 1]) + fc * (a[:, 1] - b[:, 1])) / d
    y = (fa * (c[:, 0] - b[:, 0]) + fb * (a[:, 0] - c[:, 0]) + fc * (b[:, 0] - a[:, 0])) / d
    power = far[None, :] - 2 * (x[:, None] * q[None, :, 0] + y[:, None] * q[None, :, 1])
    own = fa - 2 * (x * a[:, 0] + y * a[:, 1])
    return t[(power >= (own - 1e-12 * np.maximum(1, np.abs(own)))[:, None]).all(1)]


def _inserted_triangles(q: np.ndarray) -> np.ndarray:
    """The same by inserting point after point. Each edge of the hull has a triangle on its outer side, whose third corner n is nowhere; its circle is the half plane out there."""
    n = len(q)
    i1 = int(np.argmax(((q - q[0]) ** 2).sum(1)))
    i2 = int(np.argmax(np.abs(_turn(q[0], q[i1], q))))
    a, b, c = (0, i1, i2) if _turn(q[0], q[i1], q[i2]) > 0 else (0, i2, i1)
    triangles = np.array([[a, b, c], [b, a, n], [c, b, n], [a, c, n]])
    held = np.vstack([q, [[0.0, 0.0]]])
    for i in range(1, n):
        if i in (i1, i2):
            continue
        u, v, w = (held[triangles[:, k]] - q[i] for k in range(3))
        uu, vv, ww = (u * u).sum(1), (v * v).sum(1), (w * w).sum(1)
        inside = u[:, 0] * (v[:, 1] * ww - w[:, 1] * vv) - u[:, 1] * (v[:, 0] * ww - w[:, 0] * vv) + uu * (v[:, 0] * w[:, 1] - v[:, 1] * w[:, 0])
        outer = triangles[:, 2] == n
        bad = np.where(outer, u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0], inside) > 0
        gone = triangles[bad]
        edges = np.vstack([gone[:, [0, 1]], gone[:, [1, 2]], gone[:, [2, 0]]])
        code, back = edges[:, 0] * (n + 1) + edges[:, 1], edges[:, 1] * (n + 1) + edges[:, 0]
        rim = edges[~(code[:, None] == back[None, :]).any(1)]  # a point takes few triangles away
        new = np.column_stack([rim, np.full(len(rim), i)])
        new[rim[:, 0] == n] = new[rim[:, 0] == n][:, [1, 2, 0]]
        new[rim[:, 1] == n] = new[rim[:, 1] == n][:, [2, 0, 1]]
        triangles = np.vstack([triangles[~bad], new])
    found = triangles[triangles[:, 2] < n]
    return found[np.abs(_turn(q[found[:, 0]], q[found[:, 1]], q[found[:, 2]])) > _SLIVER]


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (index triples) of plane points: of a few by testing all triples, of more by insertion; the faces are the same."""
    p = np.asarray(points, float)
    if len(p) < 3:
        return np.zeros((0, 3), int)
    q = _apart(p)
    return _few_triangles(q) if len(p) <= FEW_POINTS else _inserted_triangles(q)


def plane_normal(points: np.ndarray) -> np.ndarray:
    """Unit normal of the best-fitting plane."""
    return np.linalg.svd(points - points.mean(0), full_matrices=False)[2][-1]


#: Density correction of the rugosity index: constants of its published regression.
_RUGOSITY = (2.49127261, 9.01659384, 32.65748276)


def rugosity(points: np.ndarray, density: float) -> float:
    """Area of the triangulated surface over the area of its hull on the best-fitting plane, corrected for density; NaN for fewer than three points or no area."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return math.nan
    t = delaunay(p[:, :2])
    surface = float(triangle_area(p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]).sum()) if len(t) else 0.0
    corners = hull(p[:, :2])
    if len(corners) < 3:
        return math.nan
    at = {tuple(q[:2]): q for q in p}
    normal = plane_normal(np.array([at[tuple(c)] for c in corners]))
    # the hull of the points in plan, lifted onto the plane that fits its corners best
    planar = polygon_area(corners) / max(abs(float(normal[2])), 1e-12)
    if planar <= 0 or surface <= 0:
        return math.nan
    return surface / planar / (_RUGOSITY[0] + _RUGOSITY[1] * math.sqrt(density * _RUGOSITY[2]))


def cell_rugosity(cells: DataFrame, key: str, radius: float) -> DataFrame:
    """(key, rugosity) of the points (x, y, z) of each cell, whose key is a number; a cell is a bounded piece of ground.

    Cells are many and small, so they are not groups of their own: rows come sorted by cell, and a batch is cut where the
    key changes. What a batch leaves unfinished goes on in the next.
    """

    def value(part: np.ndarray) -> float | None:
        found = rugosity(part, len(part) / (math.pi * radius * radius))
        return None if math.isnan(found) else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_keys, left = np.zeros(0, np.int64), np.zeros((0, 3))
        for batch in batches:
            keys = np.concatenate([left_keys, batch.column(0).to_numpy(zero_copy_only=False)])
            held = np.vstack([left, np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)])])
            starts = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0] if len(keys) else np.zeros(0, np.int64)
            done = [value(held[i:j]) for i, j in zip(starts[:-1], starts[1:], strict=True)]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(keys[starts[:-1]]), pa.array(done, pa.float64())], names=[key, "rugosity"])
            last = starts[-1] if len(starts) else 0
            left_keys, left = keys[last:], held[last:]
        if len(left_keys):
            yield pa.RecordBatch.from_arrays([pa.array(left_keys[:1]), pa.array([value(left)], pa.float64())], names=[key, "rugosity"])

    held = cells.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    return held.repartition(key).sortWithinPartitions(key).mapInArrow(run, f"{key} long, rugosity double")


def group_models(points: DataFrame, key: str, model: str, value: str = "z", steps: int = 5, **options) -> DataFrame:
    """(key, x, y, value) of a surface model ('spline' or 'rbf') of each group, on a steps x steps lattice over its box.

    A group is a bounded set of points, such as a cell or tile; a group of fewer than four has none.
    """
    kind = dict(points.dtypes)[key]

    def one(held: pa.Table) -> pa.Table:
        x, y, z = (held.column(c).to_numpy().astype(float) for c in ("x", "y", "_v"))
        order = np.lexsort((z, y, x))
        x, y, z = x[order], y[order], z[order]
        _, first = np.unique(np.column_stack([x, y]), axis=0, return_index=True)
        x, y, z = x[first], y[first], z[first]
        if len(x) < 4:
            return pa.table({key: held.column(key).slice(0, 0), "x": pa.array([], pa.float64()), "y": pa.array([], pa.float64()), "value": pa.array([], pa.float64())})
        gx, gy = (g.ravel() for g in np.meshgrid(np.linspace(x.min(), x.max(), steps), np.linspace(y.min(), y.max(), steps)))
        surface = Spline2(x, y, z, **options) if model == "spline" else Rbf(x, y, z, **options)
        return pa.table({key: pa.chunked_array([held.column(key).combine_chunks().slice(0, 1).take(pa.array(np.zeros(len(gx), np.int64)))]), "x": gx, "y": gy, "value": surface(gx, gy)})

    return points.select(key, "x", "y", F.col(value).cast("double").alias("_v")).groupBy(key).applyInArrow(one, f"{key} {kind}, x double, y double, value double")
