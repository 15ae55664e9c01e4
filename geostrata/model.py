"""Schemas, and the frame of a raster."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "point_id long, x double, y double, z double, intensity double, scan_angle double, cls int, return_num int, num_returns int, is_edge boolean"
RASTER = "band int, row int, col int, value double"

TYPE_SIZES = {"Float64": 8, "Float32": 4, "UInt32": 4, "UInt16": 2, "Byte": 1, "Int32": 4, "Int16": 2, "None": 0}
#: Spark has no unsigned types, so they are widened.
SPARK_TYPES = {"Float64": "double", "Float32": "float", "UInt32": "bigint", "UInt16": "int", "Byte": "smallint", "Int32": "int", "Int16": "smallint"}
INTERLEAVES = ("BIL", "BSQ", "BIP")


@dataclass(frozen=True)
class Box:
    """A plane box. Contains is half-open, and touching boxes intersect."""

    minx: float
    miny: float
    maxx: float
    maxy: float

    @property
    def width(self) -> float:
        return self.maxx - self.minx

    @property
    def height(self) -> float:
        return self.maxy - self.miny

    def contains(self, x: Column, y: Column) -> Column:
        return (x >= self.minx) & (x < self.maxx) & (y >= self.miny) & (y < self.maxy)

    def near(self, x: Column, y: Column, radius: float) -> Column:
        """Closed box grown by a radius."""
        return x.between(self.minx - radius, self.maxx + radius) & y.between(self.miny - radius, self.maxy + radius)

    def intersects(self, other: Box) -> bool:
        return self.minx <= other.maxx and self.maxx >= other.minx and self.miny <= other.maxy and self.maxy >= other.miny

    def intersection(self, other: Box) -> Box | None:
        return Box(max(self.minx, other.minx), max(self.miny, other.miny), min(self.maxx, other.maxx), min(self.maxy, other.maxy)) if self.intersects(other) else None

    def union(self, other: Box) -> Box:
        return Box(min(self.minx, other.minx), min(self.miny, other.miny), max(self.maxx, other.maxx), max(self.maxy, other.maxy))

    def snap(self, res: float) -> Box:
        """Grown outward to multiples of the resolution."""
        r = abs(res)
        return Box(math.floor(self.minx / r) * r, math.floor(self.miny / r) * r, math.ceil(self.maxx / r) * r, math.ceil(self.maxy / r) * r)

    def align(self, x: float, y: float, xres: float, yres: float) -> Box:
        """Grown outward to whole steps of the resolutions from an origin."""
        xr, yr = abs(xres), abs(yres)
        return Box(x + math.floor((self.minx - x) / xr) * xr, y + math.floor((self.miny - y) / yr) * yr, x + math.ceil((self.maxx - x) / xr) * xr, y + math.ceil((self.maxy - y) / yr) * yr)

    def cube(self) -> Box:
        """Squared up around its middle."""
        half = max(self.width, self.height) / 2
        x, y = (self.minx + self.maxx) / 2, (self.miny + self.maxy) / 2
        return Box(x - half, y - half, x + half, y + half)

    def pad(self, by: float) -> Box:
        return Box(self.minx - by, self.miny - by, self.maxx + by, self.maxy + by)

    @staticmethod
    def parse(text: str) -> Box:
        parts = [float(p) for p in text.split(",")]
        if len(parts) not in (4, 6):
            raise ValueError("bounds have four or six parts")
        return Box(parts[0], parts[1], parts[len(parts) // 2], parts[len(parts) // 2 + 1])

    def text(self) -> str:
        return f"{self.minx},{self.miny},{self.maxx},{self.maxy}"


@dataclass(frozen=True)
class GridSpec:
    """A raster's frame: top left corner, signed resolutions, size, nodata sentinel of files, type, interleave and projection.

    Cell indexes are truncated toward zero, as (x - tlx) / res_x. Inside the engine nodata is null.
    """

    tlx: float
    tly: float
    res_x: float
    res_y: float
    cols: int
    rows: int
    bands: int = 1
    nodata: float = -9999.0
    kind: str = "Float64"
    interleave: str = "BIL"
    projection: str = ""
    labels: tuple[str, ...] = field(default=())

    @staticmethod
    def from_bounds(box: Box, res_x: float, res_y: float) -> GridSpec:
        """Size by ceil(width / |res|); the origin is the edge that the signs of the resolutions say."""
        return GridSpec(box.minx if res_x > 0 else box.maxx, box.miny if res_y > 0 else box.maxy, res_x, res_y, math.ceil(box.width / abs(res_x)), math.ceil(box.height / abs(res_y)))

    @staticmethod
    def gridding(box: Box, res_x: float, res_y: float, easting: float | None = None, northing: float | None = None) -> GridSpec:
        """Extent aligned for gridding: whole cells and one more around without an origin, else whole steps from the origin."""
        if easting is None or northing is None:
            box = box.snap(res_x) if abs(res_x) == abs(res_y) else box.align(0, 0, res_x, res_y)
            box = Box(box.minx - abs(res_x), box.miny - abs(res_y), box.maxx + abs(res_x), box.maxy + abs(res_y))
        else:
            box = box.align(easting, northing, res_x, res_y)
        return GridSpec.from_bounds(box, res_x, res_y)

    @property
    def bounds(self) -> Box:
        x, y = self.tlx + self.cols * self.res_x, self.tly + self.rows * self.res_y
        return Box(min(self.tlx, x), min(self.tly, y), max(self.tlx, x), max(self.tly, y))

    @property
    def half_diagonal(self) -> float:
        return math.sqrt(2 * (self.res_x / 2) ** 2)

    def col(self, x: Column) -> Column:
        return ((x - self.tlx) / self.res_x).cast("int")

    def row(self, y: Column) -> Column:
        return ((y - self.tly) / self.res_y).cast("int")

    def x(self, col: Column) -> Column:
        return F.lit(self.tlx) + col * self.res_x + 0.5 * self.res_x

    def y(self, row: Column) -> Column:
        return F.lit(self.tly) + row * self.res_y + 0.5 * self.res_y

    def has(self, col: Column, row: Column) -> Column:
        return (col >= 0) & (col < self.cols) & (row >= 0) & (row < self.rows)

    def index(self, col: Column, row: Column, band: Column | int = 0, interleave: str | None = None) -> Column:
        """Linear place of a cell under an interleave."""
        kind = interleave or self.interleave
        band, col, row = F.lit(band) if isinstance(band, int) else band, col.cast("long"), row.cast("long")
        if kind == "BIL":
            return row * (self.cols * self.bands) + band * self.cols + col
        if kind == "BSQ":
            return band * (self.cols * self.rows) + row * self.cols + col
        if kind == "BIP":
            return row * (self.cols * self.bands) + col * self.bands + band
        raise ValueError(f"no interleave {kind!r}")

    def with_res(self, factor: float) -> GridSpec:
        return replace(self, res_x=self.res_x / factor, res_y=self.res_y / factor, cols=int(self.cols * factor), rows=int(self.rows * factor))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> GridSpec:
        held = json.loads(text)
        return GridSpec(**(held | {"labels": tuple(held.get("labels", ()))}))


def pack_cell(col: Column, row: Column) -> Column:
    """Column and row in one long."""
    return F.shiftleft(col.cast("long"), 32).bitwiseOR(row.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def unpack_cell(cell: Column) -> tuple[Column, Column]:
    return F.shiftright(cell, 32).cast("int"), F.shiftright(F.shiftleft(cell, 32), 32).cast("int")
