"""Session-count reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def tidy_type(c: Column) -> Column:
    """Null as ``UNKNOWN``, trimmed, upper case."""
    return F.upper(F.trim(F.coalesce(c, F.lit("Unknown"))))


def count_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions by source, type and year; a null type is a type."""
    return sessions.groupBy("fonte", "tipo", "ano").agg(F.count(F.lit(1)).alias("contador"))


def pivot_years(counts: DataFrame, years: list[int], agg: str = "avg") -> DataFrame:
    """Source and type by year (``y<year>``), 0 where there is nothing; ``avg`` (the default) or ``sum`` of the counts; rows without a type vanish."""
    wide = counts.where("tipo is not null").groupBy("fonte", "tipo").pivot("ano", years).agg({"contador": agg})
    return wide.select("fonte", "tipo", *[F.coalesce(F.col(f"`{y}`").cast("double"), F.lit(0.0)).alias(f"y{y}") for y in years])


def combine(*parts: DataFrame) -> DataFrame:
    """Union by name; a missing column is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def top_types(counts: DataFrame, top: int = 6) -> DataFrame:
    """The ``top`` types by sessions, ties by name."""
    return counts.groupBy("tipo").agg(F.sum("contador").alias("total")).orderBy(F.col("total").desc(), "tipo").limit(top)


def recode_rest(counts: DataFrame, top: int = 6, rest: str = "OUTROS") -> DataFrame:
    """Types outside the ``top`` become ``rest``; the top table has ``top`` rows, so it is broadcast."""
    kept = F.broadcast(top_types(counts, top).select("tipo", F.col("tipo").alias("kept")))
    return counts.join(kept, "tipo", "left").withColumn("tipo_grouped", F.coalesce("kept", F.lit(rest))).drop("kept")


def sum_by(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("contador").alias("total"))


def preview(docs: DataFrame, key: str, text: str, top: int = 20, chars: int = 500) -> DataFrame:
    """The beginning of the first ``top`` documents by key."""
    return docs.orderBy(key).limit(top).select(key, F.substring(text, 1, chars).alias("preview"))


def timed_write(df: DataFrame, path: str) -> dict[str, float]:
    """Writes a table and tells its ``rows``, the ``seconds`` it took and the ``seconds_per_row``, counted on the way."""
    import time

    seen, began = Observation(), time.monotonic()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    seconds, rows = time.monotonic() - began, seen.get["rows"]
    return {"rows": rows, "seconds": seconds, "seconds_per_row": seconds / rows if rows else 0.0}
