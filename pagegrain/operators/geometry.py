"""Lines: least squares, interpolation between samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fit_lines(points: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """keys, slope, intercept, n of least squares; one x alone gives slope 0 and the mean; a single point raises."""
    fitted = points.groupBy(*keys).agg(
        F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_intercept(y, x), F.avg(y)).alias("intercept"), F.count("*").alias("n")
    )
    ok = F.assert_true(F.col("n") >= 2, F.lit("a line needs two points")).isNull()
    return fitted.filter(ok)


def interpolate(samples: DataFrame, keys: list[str], at: str, value: str, low: int, spans: DataFrame) -> DataFrame:
    """keys, at, value at every whole place from ``low`` to the key's top: linear between samples, flat beyond them.

    ``spans`` has keys and top.  Each place finds the samples around it with
    last and first non-null values over one window: no join of places with samples.
    """
    spine = spans.select(*keys, F.explode(F.sequence(F.lit(low).cast("long"), F.col("top").cast("long"))).alias(at))
    joined = spine.join(samples.select(*keys, F.col(at).cast("long").alias(at), F.col(value).cast("double").alias("v")), [*keys, at], "left")
    order = Window.partitionBy(*keys).orderBy(at)
    here = F.when(F.col("v").isNotNull(), F.col(at))
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    told = joined.select(
        *keys, at, F.last("v", True).over(back).alias("v0"), F.last(here, True).over(back).alias("p0"),
        F.first("v", True).over(ahead).alias("v1"), F.first(here, True).over(ahead).alias("p1"),
    )
    share = (F.col(at) - F.col("p0")) / F.nullif(F.col("p1") - F.col("p0"), F.lit(0))
    inside = F.col("v0") + F.coalesce(share, F.lit(0.0)) * (F.col("v1") - F.col("v0"))
    return told.select(*keys, at, F.coalesce(inside, "v0", "v1").alias(value))
