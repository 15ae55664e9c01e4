"""Moving windows over rasters: shifted copies of the cells meet their targets by key, or a tile with halo is filtered whole."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import tiles

#: The base of the exponential in the kernel, as the results to be matched have it.
KERNEL_E = 2.71828
TILE = 256


def gaussian_kernel(size: int, sigma: float) -> np.ndarray:
    """Square weights 1 / (2 pi s^2) E^(-(x^2 + y^2) / (2 s^2)). size is at least 3, an even one is taken one larger."""
    if size < 3 or sigma <= 0:
        raise ValueError("size is at least 3 and sigma positive")
    size += size % 2 == 0
    at = np.arange(size) - size // 2
    return KERNEL_E ** (-(at[:, None] ** 2 + at[None, :] ** 2) / (2 * sigma * sigma)) / (2 * math.pi * sigma * sigma)


def gaussian_smooth(raster: DataFrame, size: int, sigma: float, tile: int = TILE) -> DataFrame:
    """(band, row, col, value): each cell as the mean of its window, weighted by the kernel over the cells that have data.

    A nodata cell within reach of data is filled; cells with a negative row or column do not exist. Tiles of cells with a
    halo of half a window are convolved as arrays, so a cell moves once and not once for each place of the kernel.
    """
    kernel = gaussian_kernel(size, sigma)
    half = len(kernel) // 2

    def smooth(held: pa.Table) -> pa.Table:
        tr, tc, band = (held.column(n)[0].as_py() for n in ("tile_row", "tile_col", "band"))
        r0, c0 = tr * tile - half, tc * tile - half
        n = tile + 2 * half
        values, there = np.zeros((n, n)), np.zeros((n, n))
        r, c = held.column("row").to_numpy() - r0, held.column("col").to_numpy() - c0
        values[r, c], there[r, c] = held.column("value").to_numpy(), 1.0
        total, weight = np.zeros((tile, tile)), np.zeros((tile, tile))
        for i in range(2 * half + 1):
            for j in range(2 * half + 1):
                total += kernel[i, j] * values[i : i + tile, j : j + tile]
                weight += kernel[i, j] * there[i : i + tile, j : j + tile]
        rr, cc = np.nonzero(weight > 0)
        return pa.table({"band": np.full(len(rr), band, np.int32), "row": (rr + tr * tile).astype(np.int32), "col": (cc + tc * tile).astype(np.int32), "value": total[rr, cc] / weight[rr, cc]})

    spread = tiles(raster.where(F.col("value").isNotNull()).select("band", "row", "col", F.col("value").cast("double").alias("value")), tile, half)
    return spread.groupBy("band", "tile_row", "tile_col").applyInArrow(smooth, "band int, row int, col int, value double")
