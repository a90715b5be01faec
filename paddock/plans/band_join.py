"""Join each target with all points within a distance, and add the points up."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def banded(targets: DataFrame, points: DataFrame, keys: list[str], target: str, point: str, half_width: int) -> DataFrame:
    """Every pair of a target and a point of its keys within ``half_width`` of it, inclusive.

    The line is cut into buckets as wide as the half width.  A target is sent to its
    own bucket and both neighbours, so an equi-join on keys and bucket finds every
    candidate and the distance test keeps the right ones.
    """
    bucket = F.floor(F.col(target) / half_width)
    spread = targets.withColumn("bucket", F.explode(F.sequence(bucket - 1, bucket + 1)))
    placed = points.withColumn("bucket", F.floor(F.col(point) / half_width))
    near = F.abs(F.col(target) - F.col(point)) <= half_width
    return spread.join(placed, [*keys, "bucket"]).filter(near).drop("bucket")


def band_sums(
    targets: DataFrame,
    points: DataFrame,
    keys: list[str],
    target: str,
    point: str,
    half_width: int,
    measures: list[str],
) -> DataFrame:
    """Sum ``measures`` of the points within ``half_width`` of each target, inclusive.

    Both inputs should be distinct (targets) or already summed (points), which bounds the
    candidates by the number of different values and not of rows.
    """
    return (
        banded(targets, points, keys, target, point, half_width)
        .groupBy(*keys, target)
        .agg(*[F.sum(name).alias(name) for name in measures])
    )
