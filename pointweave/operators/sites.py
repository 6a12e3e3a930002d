"""Distinct positions ("sites") of a cloud.

Copies of one position have the same neighbours, so neighbourhood work runs
once per site. However many rows share a position, they cost one row in every
join; only the final lookup touches all of them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Row, functions as F

from pointweave.functions.vector import is_valid
from pointweave.session import cut

XYZ = ["x", "y", "z"]


def without_position(points: DataFrame, **values) -> DataFrame:
    """The rows left out of ``Sites``, with the values that a point without neighbours has."""
    valid = F.coalesce(is_valid(*[F.col(c) for c in XYZ]), F.lit(False))
    return points.where(~valid).select("point_id", *[v.alias(k) for k, v in values.items()])


class Sites:
    """``table`` has columns site (smallest point_id), x, y, z, n (copies)."""

    def __init__(self, points: DataFrame):
        self.points = points.where(is_valid(*[F.col(c) for c in XYZ]))
        self.table = cut(
            self.points.groupBy(*XYZ).agg(F.min("point_id").alias("site"), F.count("*").alias("n")),
            key="site",
        )

    @cached_property
    def stats(self) -> Row:
        ends = [f(c).alias(f"{f.__name__}_{c}") for c in XYZ for f in (F.min, F.max)]
        return self.table.agg(
            *ends,
            F.count("*").alias("sites"),
            F.max("n").alias("max_n"),
            F.sum("n").alias("rows"),
        ).first()

    @property
    def unique(self) -> bool:
        return (self.stats.max_n or 1) == 1

    def spread(self, per_site: DataFrame) -> DataFrame:
        """Give every point the values of its site; ``per_site`` is keyed by site."""
        if self.unique:
            return per_site.withColumnRenamed("site", "point_id")
        keyed = self.table.select("site", *XYZ).join(per_site.select("site", *_values(per_site)), "site")
        return self.points.select("point_id", *XYZ).join(keyed.drop("site"), XYZ).drop(*XYZ)

    def copies(self, k: int) -> DataFrame:
        """Points as neighbour candidates (n_id, x, y, z): no position needs more
        than its k smallest ids, since a tie in distance is broken by id."""
        if self.unique:
            return self.table.select(F.col("site").alias("n_id"), *XYZ)
        from pyspark.sql import Window

        order = F.row_number().over(Window.partitionBy(*XYZ).orderBy("point_id"))
        return (
            self.points.select("point_id", *XYZ)
            .withColumn("copy", order)
            .where(F.col("copy") <= k)
            .select(F.col("point_id").alias("n_id"), *XYZ)
        )


def _values(per_site: DataFrame) -> list[str]:
    return [c for c in per_site.columns if c not in ("site", *XYZ)]
