"""Mention weights over a stream of speech mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_weights(stream: DataFrame, length: str = "1 day", late: str = "30 days") -> DataFrame:
    """Speeches that name a person, by window of ``seen_at``: ``graph_id``, ``word``, ``window_start``, ``speeches``, ``weight``.

    ``stream`` has ``speech_id``, ``graph_id``, ``word``, ``weight``, ``seen_at``.  Repeats of (speech, word) inside the watermark count once; rows later
    than ``late`` are dropped, as are rows with a null key or time; a null weight adds nothing.  State is bounded by the watermark."""
    rows = stream.where("speech_id is not null and word is not null and graph_id is not null and seen_at is not null").withWatermark("seen_at", late)
    once = rows.dropDuplicatesWithinWatermark(["graph_id", "speech_id", "word"])
    out = once.groupBy("graph_id", "word", F.window("seen_at", length)).agg(F.count(F.lit(1)).alias("speeches"), F.sum(F.coalesce("weight", F.lit(0))).alias("weight"))
    return out.select("graph_id", "word", F.col("window.start").alias("window_start"), "speeches", "weight")
