"""Scalar functions as column expressions, and their plain Python twins where files and names are meant."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The smallest positive and the largest double.
SMALLEST_POSITIVE, LARGEST = 2.2250738585072014e-308, 1.7976931348623157e308

FILE_TYPES = ("GTiff", "ENVI", "ROI", "SHP", "CSV", "SQLITE", "Unknown")
NORM_METHODS = ("ConvexHull", "LongestSeg", "Line")


def sq(x: Column) -> Column:
    return x * x


def point_line_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from the line through two points; from the first if the two are one."""
    dx, dy = x2 - x1, y2 - y1
    length = F.sqrt(dx * dx + dy * dy)
    return F.when(length > 0, F.abs(dy * x - dx * y + x2 * y1 - y2 * x1) / F.when(length > 0, length)).otherwise(F.sqrt(sq(x - x1) + sq(y - y1)))


def distance2(a: Column, b: Column) -> Column:
    """Squared distance of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def minkowski(a: Column, b: Column, p: float) -> Column:
    """L-p distance of two arrays; p of infinity is the largest difference."""
    steps = F.zip_with(a, b, lambda u, v: F.abs(u.cast("double") - v.cast("double")))
    if math.isinf(p):
        return F.array_max(steps)
    return F.pow(F.aggregate(F.transform(steps, lambda s: F.pow(s, F.lit(float(p)))), F.lit(0.0), lambda s, v: s + v), F.lit(1 / p))


def combinations(n: Column, k: int) -> Column:
    """C(n, k) as a double, 0 for k > n."""
    product = F.lit(1.0)
    for i in range(k):
        product = product * (n - i) / (i + 1)
    return F.when(n >= k, product).otherwise(0.0)


RBF = {
    "multiquadric": lambda r, c, g: F.sqrt(r * r + c * c),
    "inverse_multiquadric": lambda r, c, g: 1 / F.sqrt(r * r + c * c),
    "thin_plate": lambda r, c, g: F.when(r > 0, r * r * c * c * F.log(F.when(r > 0, c * r))).otherwise(0.0),
    "thin_plate_alt": lambda r, c, g: (c * c + r * r) * F.log(c * c + r * r),
    "gaussian": lambda r, c, g: F.exp(-r * r / (2 * g * g)) / (g * math.sqrt(2 * math.pi)),
}


def split(text: Column, delimiter: str) -> Column:
    return F.split(text, f"\\Q{delimiter}\\E")


def join(parts: Column, delimiter: str) -> Column:
    return F.array_join(parts, delimiter)


def sanitize(text: Column) -> Column:
    """Runs of anything but ASCII letters and digits as one underscore."""
    return F.regexp_replace(text, "[^0-9A-Za-z]+", "_")


def basename(path: Column) -> Column:
    """Last part of a path without what follows its last dot."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.when(F.instr(name, ".") > 0, F.regexp_replace(name, "\\.[^.]*$", "")).otherwise(name)


def extension(path: Column) -> Column:
    """What follows the last dot; the whole path without a dot."""
    return F.substring_index(path, ".", -1)


def parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def join_path(a: Column, b: Column) -> Column:
    return F.concat(F.regexp_replace(a, "/+$", ""), F.lit("/"), F.regexp_replace(b, "^/+", ""))


def clock(seconds: Column) -> Column:
    """HH:MM:SS of seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def is_int(text: Column) -> Column:
    return text.rlike(r"^\s*[+-]?\d+\s*$")


def is_double(text: Column) -> Column:
    return text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")


def bounds_text(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.concat_ws(",", *[c.cast("string") for c in (minx, miny, maxx, maxy)])


def parse_bounds(text: Column) -> Column:
    """A struct of four or, with heights, six numbers; null for another count."""
    parts = F.transform(F.split(text, ","), lambda p: p.try_cast("double"))
    n = F.size(parts)
    at = lambda four, six: F.when(n == 4, F.get(parts, F.lit(four))).when(n == 6, F.get(parts, F.lit(six)))
    held = F.struct(at(0, 0).alias("minx"), at(1, 1).alias("miny"), at(2, 3).alias("maxx"), at(3, 4).alias("maxy"), F.when(n == 6, F.get(parts, F.lit(2))).alias("minz"), F.when(n == 6, F.get(parts, F.lit(5))).alias("maxz"))
    return F.when((n == 4) | (n == 6), held)
