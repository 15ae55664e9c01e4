"""Lloyd's k-means in the plane, on DataFrames: a round is one pass whose sums, k rows, are all that reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import nearest_mean


def lloyd_step(points: DataFrame, means: list[tuple[float, ...]], columns: list[str]) -> DataFrame:
    """(cluster, n, columns): size and mean of the points nearest to each mean."""
    return points.withColumn("cluster", nearest_mean(points, means, columns)).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])


def kmeans(points: DataFrame, k: int, columns: list[str], key: str = "point_id", rounds: int = 100, seed: int = 0, starts: list[tuple[float, ...]] | None = None, stable: int = 50, share: float = 0.01) -> tuple[list[tuple[float, ...]], DataFrame]:
    """(means, points with cluster). Starts from k points chosen by a hash of their keys, or from starts; ends when
    no mean moves, when for stable rounds in a row less than a share of the points has changed its mean, or after rounds.

    A mean without points stays where it is. Points that lack a coordinate take no part.
    """
    held = points
    for c in columns:
        held = held.where(F.col(c).isNotNull() & ~F.isnan(c))
    means = list(starts or ())
    if not means:
        start = held.select(*columns, F.xxhash64(F.lit(seed), key).alias("_h")).orderBy("_h", *columns).limit(k).collect()
        means = [tuple(float(r[c]) for c in columns) for r in start]
    calm, before = 0, None
    for _ in range(rounds if means else 0):
        moved, changed, total = list(means), 0, 0
        step = held.withColumns({"_now": nearest_mean(held, means, columns), "_was": nearest_mean(held, before or means, columns)})
        for r in step.groupBy("_now").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_now") != F.col("_was")).alias("_moved"), *[F.avg(c).alias(c) for c in columns]).collect():
            moved[r["_now"]] = tuple(float(r[c]) for c in columns)
            changed, total = changed + r["_moved"], total + r["_n"]
        calm = calm + 1 if before and changed < share * total else 0
        if moved == means or calm >= stable:
            break
        before, means = means, moved
    return means, held.withColumn("cluster", nearest_mean(held, means, columns)) if means else held.withColumn("cluster", F.lit(None).cast("int"))
