"""Distributions of vertex values and their fits.  ``values`` tables have ``graph_id``, ``kind`` and ``x``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distribution(values: DataFrame) -> DataFrame:
    """``n`` rows of each value, its probability ``p`` and ``ccdf`` = P(X >= x).  Null values don't count."""
    counts = values.where("x is not null").groupBy("graph_id", "kind", "x").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("graph_id", "kind")
    down = whole.orderBy(F.col("x").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(whole)
    return counts.withColumn("p", F.col("n") / total).withColumn("ccdf", F.sum("n").over(down) / total)


def loglog_fit(dist: DataFrame, head: float = 0.1, keep_head: bool = True) -> DataFrame:
    """Least squares of log10(n) on log10(x): ``slope``, ``intercept``, ``r2`` and the ``points`` used.

    Points with x and n above 0 ascend; ``keep_head`` fits the first ``int(head * points)``, else those are left out.  Null fit below three points."""
    by = Window.partitionBy("graph_id", "kind")
    rows = dist.where("x > 0 and n > 0").withColumn("r", F.row_number().over(by.orderBy("x"))).withColumn("cut", F.floor(F.lit(head) * F.count(F.lit(1)).over(by)))
    used = rows.where((F.col("r") <= F.col("cut")) == F.lit(keep_head))
    y, x = F.log10("n"), F.log10("x")
    fits = used.groupBy("graph_id", "kind").agg(F.count(F.lit(1)).alias("points"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    enough = F.col("points") >= 3
    return fits.select("graph_id", "kind", "points", *[F.when(enough, F.col(c)).alias(c) for c in ("slope", "intercept", "r2")])


def power_law_fit(dist: DataFrame) -> DataFrame:
    """Unweighted least squares of p = a * x^b: ``a``, ``b``, ``r2`` in linear space; null where there are fewer than two points.

    Given b the best a is closed form, so b is searched in one dimension, on a grid that is widened until the best is inside (up to some ten thousand); a task holds the distinct values of one series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf[(pdf["x"] > 0) & (pdf["p"] > 0)]
        x, y = pdf["x"].to_numpy(float), pdf["p"].to_numpy(float)
        out = {"graph_id": None, "kind": None, "points": len(x), "a": None, "b": None, "r2": None}
        if len(x) >= 2:

            def fit(b: float) -> tuple[float, float]:
                z = np.exp(np.clip(b * np.log(x), -700, 300))
                a = float((y * z).sum() / max((z * z).sum(), 1e-300))
                return float(((y - a * z) ** 2).sum()), a

            grid = np.linspace(-12, 4, 321)
            at = int(np.argmin([fit(b)[0] for b in grid]))
            while at in (0, len(grid) - 1) and abs(grid[at]) < 1e4:  # further out as long as the best is at an end
                grid = np.linspace(grid[at] * 4, grid[at] / 2, 321) if at == 0 else np.linspace(grid[at] / 2, grid[at] * 4, 321)
                at = int(np.argmin([fit(b)[0] for b in grid]))
            low, high = grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)]
            for _ in range(80):  # golden section
                p, q = high - (high - low) * 0.6180339887, low + (high - low) * 0.6180339887
                low, high = (low, q) if fit(p)[0] <= fit(q)[0] else (p, high)
            b = (low + high) / 2
            rest, a = fit(b)
            spread = float(((y - y.mean()) ** 2).sum())
            out |= {"a": a, "b": float(b), "r2": 1 - rest / spread if spread else None}
        return pd.DataFrame([out])

    kinds = dict(dist.dtypes)

    def keyed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf).assign(graph_id=key[0], kind=key[1])

    return dist.groupBy("graph_id", "kind").applyInPandas(keyed, f"graph_id {kinds['graph_id']}, kind string, points bigint, a double, b double, r2 double")


def fitted_curve(fits: DataFrame, low: float, high: float, points: int = 100) -> DataFrame:
    """``points`` log-spaced samples of each power law between ``low`` and ``high``."""
    i = F.col("i") / (points - 1)
    x = F.pow(F.lit(10.0), F.log10(F.lit(low)) + i * (F.log10(F.lit(high)) - F.log10(F.lit(low))))
    return fits.where("a is not null").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select("graph_id", "kind", "i", x.alias("x"), (F.col("a") * F.pow(x, F.col("b"))).alias("y"))


def summary(values: DataFrame) -> DataFrame:
    """Mean, least, most and population deviation of each series."""
    return values.groupBy("graph_id", "kind").agg(F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"), F.stddev_pop("x").alias("deviation"))


def community_sizes(members: DataFrame) -> DataFrame:
    """Communities of each graph, the largest, the smallest, the mean size and its population deviation."""
    size = members.groupBy("graph_id", "community").agg(F.count(F.lit(1)).alias("size"))
    return size.groupBy("graph_id").agg(F.count(F.lit(1)).alias("communities"), F.max("size").alias("most"), F.min("size").alias("least"), F.avg("size").alias("mean"), F.stddev_pop("size").alias("deviation"))


def largest_sizes(members: DataFrame, top: int = 15) -> DataFrame:
    """The ``top`` largest communities of each graph: ``rank``, ``community``, ``size``; ties by community."""
    size = members.groupBy("graph_id", "community").agg(F.count(F.lit(1)).alias("size"))
    by = Window.partitionBy("graph_id").orderBy(F.col("size").desc(), "community")
    return size.withColumn("rank", F.row_number().over(by).cast("bigint")).where(F.col("rank") <= top)
