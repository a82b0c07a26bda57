"""Chunks, speeches and inline tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_CUT = "\x01"
_INTRO = r"[OA]\s+SRA?\.\s+[A-Za-zÀ-ÖØ-öø-ÿ]"


def chunk_windows(docs: DataFrame, key: str, text: str, window: int = 1000, overlap: int = 200) -> DataFrame:
    """Sliding windows: ``key``, ``chunk``, ``start``, ``end``, ``piece``.  Windows are at most ``window`` long and share ``overlap``; null and empty texts have none."""
    n = F.length(text)
    size = F.least(F.lit(window), n)
    shared = F.least(F.lit(overlap), size - 1)
    count = F.ceil(F.greatest(F.lit(1), n - shared) / (size - shared)).cast("int")
    rows = docs.where(n > 0).select(key, text, n.alias("n"), size.alias("w"), (size - shared).alias("step"), F.posexplode(F.sequence(F.lit(0), count - 1)).alias("chunk", "_i"))
    start = F.col("chunk") * F.col("step")
    end = F.least(start + F.col("w"), F.col("n"))
    return rows.select(key, F.col("chunk").cast("bigint").alias("chunk"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), F.substring(F.col(text), start + 1, end - start).alias("piece"))


def split_speeches(docs: DataFrame, key: str, text: str, faithful: bool = False) -> DataFrame:
    """Speeches: ``key``, ``speech_no`` (from 0), ``speech``.  A speech begins at ``O SR. X`` / ``A SRA. X``, in any case.

    By default a person tag right before the article belongs to the new speech; ``faithful`` cuts between the two.  Blank pieces are dropped."""
    tag = "" if faithful else "(?:<PESSOA:[^>]+>)?"
    marked = F.regexp_replace(text, rf"(?i)(^|[^\p{{L}}\p{{N}}_])({tag}{_INTRO})", f"$1{_CUT}$2")
    pieces = F.filter(F.transform(F.split(marked, _CUT), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(pieces).alias("speech_no", "speech")).withColumn("speech_no", F.col("speech_no").cast("bigint"))


def insert_tags(docs: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``annotated``: ``<PESSOA:name>`` / ``</PESSOA>`` put around the spans (``key``, ``name``, ``start``, ``end``).

    At one position closing tags come before opening ones, opening ones in name order; crossing spans give crossing tags.
    Spans out of bounds are dropped, texts without spans stay as they are, null texts stay null."""
    inside = spans.join(docs.select(key, F.length(text).alias("n")), key).where("start >= 0 and start < `end` and `end` <= n").select(key, "name", "start", "end").distinct()
    points = inside.select(key, F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("opens"), "name"), F.struct(F.col("end").alias("pos"), F.lit(0).alias("opens"), "name"))).alias("p")).groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("points"))
    both = docs.select(key, text).join(points, key, "left")
    before = F.transform(F.sequence(F.lit(0), F.size("points") - 1), lambda i: F.struct(F.when(i == 0, 0).otherwise(F.get("points", i - 1)["pos"]).alias("from"), F.get("points", i).alias("p")))
    piece = F.transform(before, lambda b: F.concat(F.substring(F.col(text), b["from"] + 1, b["p"]["pos"] - b["from"]), F.when(b["p"]["opens"] == 1, F.concat(F.lit("<PESSOA:"), b["p"]["name"], F.lit(">"))).otherwise("</PESSOA>")))
    tail = F.substring(F.col(text), F.element_at("points", -1)["pos"] + 1, F.length(text))
    return both.select(key, F.when(F.col("points").isNull(), F.col(text)).otherwise(F.concat(F.array_join(piece, ""), tail)).alias("annotated"))


def extract_tags(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Entities of gold texts (``<surface>``): ``key``, ``tag_no`` (from 0), ``surface``, ``start``, ``end`` by the text without tags.  A lone ``<`` is text."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)<[^<>]+>|[^<>]+|[<>]"), F.lit(0))
    rows = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(parts).alias("i", "part"))
    tagged = (F.length("part") > 2) & F.col("part").startswith("<")
    plain = F.when(tagged, F.substring(F.col("part"), F.lit(2), F.length("part") - 2)).otherwise(F.col("part"))
    order = Window.partitionBy(key).orderBy("i")
    rows = rows.withColumn("tagged", tagged).withColumn("plain", plain).withColumn("end", F.sum(F.length("plain")).over(order)).withColumn("start", F.col("end") - F.length("plain"))
    rows = rows.where("tagged").withColumn("tag_no", F.row_number().over(order) - 1)
    return rows.select(key, F.col("tag_no").cast("bigint").alias("tag_no"), F.col("plain").alias("surface"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


def tag_names(speeches: DataFrame, text: str) -> DataFrame:
    """Adds ``names``: the person tags of a speech in order."""
    return speeches.withColumn("names", F.regexp_extract_all(text, F.lit("<PESSOA:([^>]+)>"), F.lit(1)))
