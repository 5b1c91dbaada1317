"""Gaussian kernel densities of the churn and no-churn rows on a grid.

Evaluating the kernel of every row at every grid point would make rows x points pairs. The
rows are folded into boxes of half a bandwidth instead. With u the distance of a grid point
from the box centre and t that of a row, both in bandwidths, the kernel is

    exp(-(u - t)^2 / 2) = exp(-u^2 / 2) * sum over k of u^k * [exp(-t^2 / 2) * t^k / k!]

so the sums of the bracket over the rows of a box are all the grid needs. As |t| <= 1/4, 16
terms leave less than 5e-17 of the kernel's peak: the result is the exact density up to
rounding. The sums are ordinary aggregates with map-side combine. A grid point lies within
reach of at most 157 boxes, so the number of (box, point) pairs does not grow with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwatt.functions import evenly_spaced
from keepwatt.operators.profiling import long_values, number_sql

TERMS = 16
BOX = 0.5       # box width in bandwidths
REACH = 39.0    # exp(-39^2 / 2) is zero in double precision
CLASSES = {1: "churn", 0: "no_churn"}


def _class_statistics(df: DataFrame, grids: Mapping[str, tuple[float, float] | None],
                      churn: str) -> DataFrame:
    """(column, churn, n, h, lo, hi): size, Scott bandwidth and grid bounds of every class.

    One row per column and class, also for classes without rows. A ``None`` grid spans the
    column's own range.
    """
    wide = []
    for c, bounds in grids.items():
        value = number_sql(c)
        for flag, name in CLASSES.items():
            only = f"FILTER (WHERE `{churn}` = {flag})"
            wide += [f"count({value}) {only} AS `{c}__n_{name}`",
                     f"stddev_samp({value}) {only} AS `{c}__s_{name}`"]
        if bounds is None:
            wide += [f"min({value}) AS `{c}__lo`", f"max({value}) AS `{c}__hi`"]
        else:
            lo, hi = (float(bound) for bound in bounds)
            wide += [f"any_value({lo!r}D) AS `{c}__lo`", f"any_value({hi!r}D) AS `{c}__hi`"]
    # both classes come out of the one aggregated row
    parts = ", ".join(
        f"struct('{c}' AS column, {flag} AS churn, `{c}__n_{name}` AS n, `{c}__s_{name}` AS s, "
        f"`{c}__lo` AS lo, `{c}__hi` AS hi)"
        for c in grids for flag, name in CLASSES.items())
    row = df.agg(*[F.expr(measure) for measure in wide])
    flags = row.select(F.expr(f"inline(array({parts}))"))
    usable = (F.col("n") >= 2) & (F.col("s") > 0)
    bandwidth = F.when(usable, F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    return flags.select(
        "column", "churn", "n", bandwidth.alias("h"), "lo", "hi")


def churn_kde(df: DataFrame, grids: Mapping[str, tuple[float, float] | None],
              points: int = 1000, churn: str = "churn") -> DataFrame:
    """Density of each class at ``points`` evenly spaced values of each column.

    ``grids`` maps a column to the (min, max) of its grid, or to None for the column's range.
    A class with fewer than two values or without spread has no density: NULL.
    """
    stats = _class_statistics(df, grids, churn)
    margin = f"{REACH + 1} * h"
    boxed = (
        long_values(df, list(grids), churn)
        # two rows per profiled column
        .join(F.broadcast(stats.where("h IS NOT NULL")), ["column", "churn"])
        .where(f"value BETWEEN lo - {margin} AND hi + {margin}")
        .selectExpr("*", f"floor((value - lo) / (h * {BOX})) AS box")
        .selectExpr("*", f"(value - lo) / h - (box + 0.5D) * {BOX}D AS t")
        .selectExpr("*", "exp(-t * t / 2) AS w")
    )
    sums = [F.expr(f"sum(w{' * t' * k}) / {math.factorial(k)}D AS m{k}") for k in range(TERMS)]
    boxes = boxed.groupBy("column", "churn", "box", "h", "lo", "hi").agg(*sums)

    last_point = points - 1
    step = f"((hi - lo) / {max(last_point, 1)})"
    first = f"CAST(greatest(ceil((centre - {REACH} * h - lo) / {step}), 0) AS INT)"
    last = f"CAST(least(floor((centre + {REACH} * h - lo) / {step}), {last_point}) AS INT)"
    # a grid without extent has all its points in one place
    touched = (f"CASE WHEN {step} <= 0 THEN sequence(0, {last_point}) "
               f"WHEN {first} <= {last} THEN sequence({first}, {last}) END")
    polynomial = f"m{TERMS - 1}"
    for k in range(TERMS - 2, -1, -1):
        polynomial = f"({polynomial}) * u + m{k}"
    x = evenly_spaced(F.col("point"), F.col("lo"), F.col("hi"), points)
    kernels = (
        boxes.selectExpr("*", f"lo + (box + 0.5D) * {BOX}D * h AS centre")
        .selectExpr("*", f"explode({touched}) AS point")
        .withColumn("u", (x - F.col("centre")) / F.col("h"))
        .groupBy("column", "churn", "point")
        .agg(F.expr(f"sum(exp(-u * u / 2) * ({polynomial})) AS kernel_sum"))
    )
    grid = stats.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    h = F.col("h")
    density = F.coalesce(F.col("kernel_sum"), F.lit(0.0)) / (
        F.col("n") * h * math.sqrt(2 * math.pi))
    return grid.join(kernels, ["column", "churn", "point"], "left").select(
        "column", "churn", "point", x.alias("x"),
        F.when(h.isNotNull(), density).alias("density"),
    )
