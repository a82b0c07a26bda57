"""The logical relations of the registered queries over the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import entities, graph
from ..operators import text as texts
from ..session import table


_FIELDS = ("fonte", "ano", "titulo", "data_str", "tipo", "text")


def _first_capture(t: DataFrame) -> DataFrame:
    """One row a session, whole from one capture: the earliest, ties by the fields."""
    first = t.groupBy("doc_id").agg(F.min(F.struct("captured_at", *_FIELDS)).alias("c"))
    return first.select("doc_id", *[F.col(f"c.{c}").alias(c) for c in _FIELDS])


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that have a text."""
    return _first_capture(table(spark, d, "transcript").where("text is not null"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """All sessions."""
    t = table(spark, d, "transcript")
    first = t.groupBy("doc_id").agg(F.min(F.struct("captured_at", "fonte", "ano", "titulo", "data_str", "tipo")).alias("c"))
    return first.select("doc_id", *[F.col(f"c.{c}").alias(c) for c in ("fonte", "ano", "titulo", "tipo")])


def persons(spark: SparkSession, d: str) -> DataFrame:
    """Person mentions with sound spans, one a span."""
    m = table(spark, d, "entity_mention").where("entity_group = 'PESSOA' and word is not null and start < `end`").select("doc_id", "start", "end", "word", "score", "mention_id")
    return entities.dedup_spans(m, "doc_id", "mention_id")


def annotated(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts with person tags around the mentions."""
    spans = persons(spark, d).select("doc_id", F.regexp_replace("word", "[<>]", "").alias("name"), "start", "end")
    return texts.insert_tags(transcripts(spark, d).select("doc_id", "text"), spans, "doc_id", "text")


def speeches(spark: SparkSession, d: str, faithful: bool = False) -> DataFrame:
    """Tagged speeches: ``graph_id`` (house and year), ``doc_id``, ``speech_no``, ``speech``, ``names``."""
    s = texts.tag_names(texts.split_speeches(annotated(spark, d), "doc_id", "annotated", faithful), "speech")
    return s.withColumn("graph_id", F.concat_ws("_", F.split_part("doc_id", F.lit("/"), F.lit(1)), F.split_part("doc_id", F.lit("/"), F.lit(2))))


def mention_rows(spark: SparkSession, d: str, faithful: bool = False) -> DataFrame:
    return graph.mention_rows(speeches(spark, d, faithful), ["graph_id", "doc_id", "speech_no"])


def speech_edges(spark: SparkSession, d: str) -> DataFrame:
    """A dense mention graph from ``speech_mention``: the person a speech names most (ties: the least label) against each other one of the speech.

    One shuffle by speech serves both the aggregation and the window; only edge counts are shuffled again."""
    m = table(spark, d, "speech_mention").where("speech_id is not null and word is not null and graph_id is not null").select("graph_id", "speech_id", "word", "weight")
    m = m.repartition("graph_id", "speech_id").groupBy("graph_id", "speech_id", "word").agg(F.coalesce(F.max("weight"), F.lit(0)).alias("w"))
    first = F.first("word").over(Window.partitionBy("graph_id", "speech_id").orderBy(F.col("w").desc(), "word"))
    pairs = m.select("graph_id", "speech_id", first.alias("src"), F.col("word").alias("dst")).where("src <> dst")
    return pairs.groupBy("graph_id", "src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def nation_edges(spark: SparkSession, d: str) -> DataFrame:
    """A small dense digraph: customer nation to supplier nation, weighted by order lines."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    both = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).where("src <> dst")
    return both.groupBy(F.lit("n").alias("graph_id"), "src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def nation_regions(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select(F.lit("n").alias("graph_id"), F.col("n_nationkey").alias("vertex"), F.col("n_regionkey").alias("community"))


def gold(spark: SparkSession, d: str) -> DataFrame:
    """Gold spans, one a place: the row of the least ``cmp_id``."""
    g = table(spark, d, "compare_outputs").where("manual_start is not null")
    first = g.groupBy("doc_id", F.col("manual_start").alias("start"), F.col("manual_end").alias("end")).agg(F.min(F.struct("cmp_id", "manual_canon", "manual_raw")).alias("c"))
    return first.select("doc_id", "start", "end", F.col("c.cmp_id").alias("gold_id"), F.col("c.manual_canon").alias("canon"), F.col("c.manual_raw").alias("raw"))


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """Predicted spans, one a place: the row of the least ``cmp_id``."""
    p = table(spark, d, "compare_outputs").where("algo_start is not null")
    first = p.groupBy("doc_id", F.col("algo_start").alias("start"), F.col("algo_end").alias("end")).agg(F.min(F.struct("cmp_id", "algo_canon", "raw_text")).alias("c"))
    return first.select("doc_id", "start", "end", F.col("c.cmp_id").alias("pred_id"), F.col("c.algo_canon").alias("p_canon"), F.col("c.raw_text").alias("p_raw"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Raw pages in the form the houses publish, made from the whole transcripts.  They hold stray end tags, elements left open, a link outside the
    agenda and an agenda of three cells: one that counts, one of a kind left out, one without a category."""
    t = transcripts(spark, d)
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    title = esc(F.coalesce("titulo", F.lit("sem título")))
    kind = esc(F.coalesce("tipo", F.lit("x")))
    cell = lambda name, code: F.concat(F.lit('<td><span class="g-agenda__categoria"> '), name, F.lit(' </span><a href="/evento/'), code, F.lit('">ver</a></td>'))
    code = F.element_at(F.split("doc_id", "/"), -1)
    agenda = F.concat(F.lit('<table><tr><td><a href="/outro/0">sem categoria</a></td>'), cell(F.lit("Outros eventos"), F.lit("1")), cell(F.concat(kind, F.lit(" geral")), code), F.lit("</tr></table>"))
    html = F.concat(
        F.lit("<html><head><title>"), title, F.lit('</title></head><body><h1>'), title, F.lit('</h1></i><a href="/notas/'), F.col("doc_id"), F.lit('/">x</a><br>'), agenda,
        F.lit('<p><b>O SR. PRESIDENTE</b></em><b>Nota</b><span class="fala x">'), esc(F.col("text")), F.lit("</span></body></html>"),
    )
    return t.select("doc_id", html.alias("html"))


def captures(spark: SparkSession, d: str) -> DataFrame:
    """Every capture of a session with a status: one that brought no text counts as a failure of the server."""
    blank = F.coalesce(F.trim("text") == "", F.lit(True))
    return table(spark, d, "transcript").select("doc_id", "fonte", "tipo", "codigo", F.when(blank, 500).otherwise(200).alias("status"))
