"""Polygons out of WKT, however it is spelled, and points inside them."""

from __future__ import annotations

import re

import numpy as np

_TOKEN = re.compile(r"[()]|,|[^\s(),]+")


def parse_polygons(wkt: str | None) -> list[list[np.ndarray]]:
    """Polygons as lists of closed rings (n x 2). Null, empty or unreadable text and other shapes give no polygon."""
    if not wkt:
        return []
    head = re.match(r"\s*(?:SRID\s*=\s*\d+\s*;)?\s*(MULTI)?POLYGON\s*(?:ZM|Z|M)?\s*(?=\()", wkt, re.IGNORECASE)
    if not head:
        return []
    nested = 3 if head.group(1) else 2
    polygons: list[list[np.ndarray]] = []
    rings: list[np.ndarray] = []
    ring: list[tuple[float, float]] = []
    numbers: list[float] = []
    level = 0

    def close_point() -> None:
        if len(numbers) >= 2:
            ring.append((numbers[0], numbers[1]))
        numbers.clear()

    try:
        for token in _TOKEN.findall(wkt[head.end() :]):
            if token == "(":
                level += 1
            elif token == ",":
                close_point()
            elif token == ")":
                close_point()
                if level == nested and len(ring) >= 3:
                    points = np.array(ring)
                    rings.append(points if (points[0] == points[-1]).all() else np.vstack([points, points[:1]]))
                if level == nested:
                    ring.clear()
                elif level == nested - 1 and rings:
                    polygons.append(rings)
                    rings = []
                level -= 1
            elif token.upper() != "EMPTY":
                numbers.append(float(token))
    except ValueError:
        return []
    return polygons


def bounds(polygons: list[list[np.ndarray]]) -> tuple[float, float, float, float] | None:
    if not polygons:
        return None
    held = np.concatenate([ring for polygon in polygons for ring in polygon])
    return float(held[:, 0].min()), float(held[:, 1].min()), float(held[:, 0].max()), float(held[:, 1].max())


def sweep_inside(polygons: list[list[np.ndarray]], xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Whether each point lies in a polygon and not in a hole. xs is sorted: the sweep line meets the points in this order.

    An edge is on the sweep line from its smaller to its larger x, so it meets one slice of the points; those above
    the edge change sides. Points exactly on an edge may count either way.
    """
    inside = np.zeros(len(xs), bool)
    for polygon in polygons:
        a = np.concatenate([ring[:-1] for ring in polygon])
        b = np.concatenate([ring[1:] for ring in polygon])
        turned = a[:, 0] > b[:, 0]
        a, b = np.where(turned[:, None], b, a), np.where(turned[:, None], a, b)
        enter, leave = np.searchsorted(xs, a[:, 0], "left"), np.searchsorted(xs, b[:, 0], "left")
        met = leave - enter
        edge = np.repeat(np.arange(len(a)), met)
        point = np.arange(met.sum()) - np.repeat(np.cumsum(met) - met, met) + np.repeat(enter, met)
        slope = (b[edge, 1] - a[edge, 1]) / (b[edge, 0] - a[edge, 0])
        above = ys[point] > a[edge, 1] + (xs[point] - a[edge, 0]) * slope
        inside |= np.bincount(point[above], minlength=len(xs)) % 2 == 1
    return inside
