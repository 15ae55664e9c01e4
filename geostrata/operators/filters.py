"""Point filters as boolean columns, and their grammar. A null in a tested column is not kept."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_class(classes: Iterable[int]) -> Column:
    return F.col("cls").isin(list(classes))


def z_range(low: float, high: float) -> Column:
    return F.col("z").between(low, high)


def intensity_range(low: float, high: float) -> Column:
    return F.col("intensity").between(low, high)


def angle_range(low: float, high: float) -> Column:
    return F.col("scan_angle").between(low, high)


def first_returns() -> Column:
    return F.col("return_num") == 1


def last_returns() -> Column:
    return F.col("return_num") == F.col("num_returns")


def no_edges(keep: bool = False) -> Column:
    return F.lit(True) if keep else ~F.col("is_edge")


def all_of(filters: Iterable[Column]) -> Column:
    """Kept by every filter; without any, everything is kept."""
    return reduce(lambda a, b: a & b, filters, F.lit(True))


@dataclass(frozen=True)
class FilterSpec:
    """A parsed filter. Ranges are closed; a side that is not given is open."""

    classes: tuple[int, ...] = ()
    first: bool = False
    last: bool = False
    edges: bool = True
    z: tuple[float | None, float | None] = (None, None)
    intensity: tuple[float | None, float | None] = (None, None)
    angle: tuple[float | None, float | None] = (None, None)
    method: str | None = field(default=None, compare=False)

    def column(self) -> Column:
        parts = []
        if self.classes:
            parts.append(in_class(self.classes))
        if self.first:
            parts.append(first_returns())
        if self.last:
            parts.append(last_returns())
        if not self.edges:
            parts.append(no_edges())
        for name, (low, high) in (("z", self.z), ("intensity", self.intensity), ("scan_angle", self.angle)):
            if low is not None:
                parts.append(F.col(name) >= low)
            if high is not None:
                parts.append(F.col(name) <= high)
        return all_of(parts)

    def z_bounds(self, low: float = float("-inf"), high: float = float("inf")) -> tuple[float, float]:
        """The z range that the filter leaves, or the defaults."""
        return (low if self.z[0] is None else self.z[0]), (high if self.z[1] is None else self.z[1])


def parse(text: str) -> FilterSpec:
    """name=value parts joined by ';': c=2,5 l f e minz= maxz= z=a,b mini= maxi= i=a,b mina= maxa= a=a,b. '-f:<method>:' may lead."""
    method = None
    if text.startswith("-f:"):
        _, method, text = text.split(":", 2)
    elif text.startswith("-p:"):
        text = text[3:]
    held: dict = {"method": method}
    ranges: dict[str, list[float | None]] = {"z": [None, None], "i": [None, None], "a": [None, None]}
    for part in filter(None, (p.strip() for p in text.split(";"))):
        name, _, value = part.partition("=")
        if name == "c":
            held["classes"] = tuple(int(v) for v in value.split(","))
        elif name in ("f", "l"):
            held["first" if name == "f" else "last"] = True
        elif name == "e":
            held["edges"] = False
        elif name in ranges:
            ranges[name] = [float(v) for v in value.split(",")]
        elif name[:3] in ("min", "max") and name[3:] in ranges:
            ranges[name[3:]][name[:3] == "max"] = float(value)
        else:
            raise ValueError(f"no filter {name!r}")
    return FilterSpec(**held, z=tuple(ranges["z"]), intensity=tuple(ranges["i"]), angle=tuple(ranges["a"]))
