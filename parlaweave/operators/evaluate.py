"""Span-level evaluation of recognised mentions against gold ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Strict: spans that only touch don't overlap."""
    return F.greatest(s1, s2) < F.least(e1, e2)


def first_overlap(gold: DataFrame, pred: DataFrame, key: str, bucket: int = 4096) -> DataFrame:
    """Each gold span (``key``, ``gold_id``, ``start``, ``end``) with the first predicted span (``pred_id`` order) that overlaps it.

    An interval join: both sides are spread over position buckets of a document, so a document with very many spans is no single task, and a pair
    is counted in the bucket in which the later of the two starts."""
    g = gold.where("start < `end`").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))))
    p = pred.where("start < `end`").select(key, "pred_id", F.col("start").alias("p_start"), F.col("end").alias("p_end"), *[c for c in pred.columns if c not in (key, "pred_id", "start", "end")])
    p = p.withColumn("_b", F.explode(F.sequence(F.floor(F.col("p_start") / bucket), F.floor((F.col("p_end") - 1) / bucket))))
    pairs = g.join(p, [key, "_b"]).where(overlaps(F.col("start"), F.col("end"), F.col("p_start"), F.col("p_end")) & (F.floor(F.greatest("start", "p_start") / bucket) == F.col("_b")))
    first = Window.partitionBy(key, "gold_id").orderBy("pred_id")
    return pairs.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_b")


def missed(gold: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    """Gold spans that nothing overlaps (FN)."""
    return gold.join(matched.select(key, "gold_id"), [key, "gold_id"], "left_anti")


def spurious(pred: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    """Predicted spans that no gold span chose (FP)."""
    return pred.join(matched.select(key, "pred_id").distinct(), [key, "pred_id"], "left_anti")


def names_agree(canon: Column, raw: Column, p_canon: Column, p_raw: Column) -> Column:
    """Any of the four names of one side equals one of the other, whatever the case."""
    a, b, c, d = (F.lower(x) for x in (canon, raw, p_canon, p_raw))
    return F.coalesce(a == c, F.lit(False)) | F.coalesce(a == d, F.lit(False)) | F.coalesce(b == c, F.lit(False)) | F.coalesce(b == d, F.lit(False))


def outcomes(matched: DataFrame, gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """``outcome`` (TP, DM) and ``reason`` of matched spans that bring ``canon``, ``raw`` of both sides (``p_canon``, ``p_raw``).

    TP asks for names that agree and groups that share a surface; else DM for ``name_mismatch`` or ``concept_mismatch``."""
    surfaces = lambda df, c, r: df.groupBy(F.col(key).alias(f"_k_{c}"), F.col(c).alias(f"_{c}")).agg(F.collect_set(r).alias(f"_{r}s"))
    g, p = surfaces(gold, "canon", "raw"), surfaces(pred, "p_canon", "p_raw")
    m = matched.join(g, (F.col(key) == F.col("_k_canon")) & (F.col("canon") == F.col("_canon")), "left")
    m = m.join(p, (F.col(key) == F.col("_k_p_canon")) & (F.col("p_canon") == F.col("_p_canon")), "left")
    name, concept = names_agree(F.col("canon"), F.col("raw"), F.col("p_canon"), F.col("p_raw")), F.coalesce(F.arrays_overlap("_raws", "_p_raws"), F.lit(False))
    return m.withColumn("outcome", F.when(name & concept, "TP").otherwise("DM")).withColumn("reason", F.when(~name, "name_mismatch").when(~concept, "concept_mismatch")).drop("_k_canon", "_k_p_canon", "_canon", "_p_canon", "_raws", "_p_raws")


def all_outcomes(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """The whole evaluation as one table: ``key``, ``outcome`` (TP, DM, FN, FP), ``reason``, gold side (``canon``, ``raw``, ``start``, ``end``) and predicted side (``p_canon``, ``p_raw``, ``p_start``, ``p_end``).

    ``gold`` has ``gold_id``, ``start``, ``end``, ``canon``, ``raw``, ``pred`` ``pred_id``, ``start``, ``end``, ``p_canon``, ``p_raw``.  A gold span takes the first predicted one
    that overlaps it; the predicted spans none took are FP.  With nothing on one side everything of the other is FN or FP."""
    matched = first_overlap(gold, pred, key)
    told = outcomes(matched, gold, pred, key).select(key, "outcome", "reason", "canon", "raw", "start", "end", "p_canon", "p_raw", "p_start", "p_end")
    fn = missed(gold, matched, key).select(key, F.lit("FN").alias("outcome"), "canon", "raw", "start", "end")
    fp = spurious(pred, matched, key).select(key, F.lit("FP").alias("outcome"), "p_canon", "p_raw", F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    return told.unionByName(fn, allowMissingColumns=True).unionByName(fp, allowMissingColumns=True)


def totals(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Gold and predicted occurrences of each ``key``, 0 where one side has none."""
    g = gold.groupBy(key).agg(F.count(F.lit(1)).alias("gold_total"))
    return g.join(pred.groupBy(key).agg(F.count(F.lit(1)).alias("pred_total")), key, "full").na.fill(0, ["gold_total", "pred_total"])


def report_lines(rows: DataFrame) -> DataFrame:
    """The report of an evaluation, line by line: ``part`` (0 measures, then 1 to 4 the details of TP, DM, FN, FP), ``name``, ``at`` and ``line``; sorted by these four it is a markdown text.

    ``rows`` are outcomes over all documents that belong together (``all_outcomes``).  Details go by canonical name, start, then the line; a part without details has a line that says so."""
    c = scores(rows, "outcome")
    number = lambda label, x, fmt="%d": F.format_string(f"- {label}: {fmt}", x)
    lines = [F.lit("## NER comparison"), number("gold occurrences", F.col("tp") + F.col("dm") + F.col("fn")), *[number(k.upper(), F.col(k)) for k in ("tp", "dm", "fn", "fp")]]
    lines += [number(f"{k} ({how})", F.col(f"{k}_{how}"), "%.4f") for how in ("strict", "lenient") for k in ("precision", "recall", "f1")]
    head = c.select(F.lit(0).alias("part"), F.lit("").alias("name"), F.posexplode(F.array(*lines)).alias("at", "line"))
    kinds = {"TP": 1, "DM": 2, "FN": 3, "FP": 4}
    titles = c.select(F.explode(F.array(*[F.struct(F.lit(n).alias("part"), F.concat(F.lit(f"### {k}"), F.when(F.col(k.lower()) == 0, "\n- none").otherwise("")).alias("line")) for k, n in kinds.items()])).alias("x")).select("x.part", F.lit("").alias("name"), F.lit(-1).alias("at"), "x.line")
    part = F.coalesce(*[F.when(F.col("outcome") == k, F.lit(n)) for k, n in kinds.items()])
    side = lambda name, canon, raw, a, b: F.when(F.col(a).isNotNull(), F.format_string(f"{name}: %s | %s @ (%d, %d)", canon, raw, a, b))
    text = F.concat_ws(" | ", side("gold", "canon", "raw", "start", "end"), side("found", "p_canon", "p_raw", "p_start", "p_end"), F.col("reason"))
    told = rows.select(part.alias("part"), F.coalesce("canon", "p_canon").alias("name"), F.coalesce("start", "p_start").alias("at"), F.concat(F.lit("- "), text).alias("line"))
    return head.unionByName(titles).unionByName(told)


def scores(rows: DataFrame, outcome: str, by: list[str] | None = None) -> DataFrame:
    """Counts of TP, DM, FN, FP and strict and lenient precision, recall and F1; 0 where a denominator is."""
    n = {k: F.count(F.when(F.col(outcome) == k.upper(), 1)) for k in ("tp", "dm", "fn", "fp")}
    c = rows.groupBy(*(by or [])).agg(*[v.alias(k) for k, v in n.items()])
    tp, dm, fn, fp = (F.col(k) for k in ("tp", "dm", "fn", "fp"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    out = c.withColumns({"precision_strict": ratio(tp, tp + fp + dm), "recall_strict": ratio(tp, tp + fn + dm), "precision_lenient": ratio(tp + dm, tp + dm + fp), "recall_lenient": ratio(tp + dm, tp + dm + fn)})
    f1 = lambda k: ratio(2 * F.col(f"precision_{k}") * F.col(f"recall_{k}"), F.col(f"precision_{k}") + F.col(f"recall_{k}"))
    return out.withColumns({"f1_strict": f1("strict"), "f1_lenient": f1("lenient")})
