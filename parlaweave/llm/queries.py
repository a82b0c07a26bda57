"""Registered queries of this subpackage; ``oracle`` has their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint, table
from . import components, cooccurrence, garbled, leakage, lookalikes, mixing, splitting, turns, variants


def p1_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns.speaker_turns(table(spark, d, "transcript"), table(spark, d, "session_speaker"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_turns(spark, d).select("doc_id", "turn_no", "speaker_no")


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    mentions = table(spark, d, "entity_mention").select(F.lit("entity_mention").alias("src_table"), F.col("mention_id").alias("row_id"), F.col("word").alias("text"))
    outputs = table(spark, d, "compare_outputs").select(F.lit("compare_outputs").alias("src_table"), F.col("cmp_id").alias("row_id"), F.col("raw_text").alias("text"))
    return lookalikes.plain_rows(mentions.unionByName(outputs), "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_forms(spark, d).where("is_case").select("src_table", "row_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.link_names(table(spark, d, "name_record"), table(spark, d, "name_entry"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.pair_lift(table(spark, d, "speech_mention"), "speech_id", "word").select("word_a", "word_b")


def p4_pair_lift(spark: SparkSession, d: str) -> DataFrame:
    out = cooccurrence.pair_lift(table(spark, d, "speech_mention"), "speech_id", "word")
    return out.withColumn("lift", F.round("lift", 6))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(table(spark, d, "transcript"), "doc_id", "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.hard_starts(p5_pieces(spark, d), "doc_id")


def p5_pieces_sound(spark: SparkSession, d: str) -> DataFrame:
    return splitting.soundness(p5_pieces(spark, d), table(spark, d, "transcript"), "doc_id", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return components.connected_groups(table(spark, d, "name_match"), "original_key", "canonical_key")


def p6_levels(spark: SparkSession, d: str) -> DataFrame:
    """The same groups by way of several levels: a task may hold a thousandth of the edges it usually may."""
    return components.connected_groups(table(spark, d, "name_match"), "original_key", "canonical_key", components.TASK_EDGES // 1000)


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_passage"), "item_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Verbatim passages only: windows that the edit matching returns with no edit."""
    return p7_leaks(spark, d).where("edits = 0").select("doc_id", "item_id")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return checkpoint(mixing.count_tokens(table(spark, d, "documents").select("doc_id", "source", "text"), "text"))


def p8_mix_copies(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_target"), "doc_id", "source", "n_tokens")


def p8_mix_shares(spark: SparkSession, d: str) -> DataFrame:
    """Actual shares of the mix beside their targets."""
    sized, targets = _sized(spark, d), table(spark, d, "mix_target")
    mixed = checkpoint(mixing.mix(sized, targets, "doc_id", "source", "n_tokens"))
    return mixing.shares(mixed, sized, targets, "source", "n_tokens")


def p8_mix_shares_met(spark: SparkSession, d: str) -> DataFrame:
    """Per target source, what was there and whether share and cap are kept."""
    rows = p8_mix_shares(spark, d).where("target_share is not null")
    met = (F.abs(F.col("actual_share") - F.col("target_share")) < 0.001).alias("share_met")
    return rows.select("source", "target_share", "max_repeat", "n_docs", met, (F.col("most_copies") <= F.col("max_repeat")).alias("cap_kept"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.find_garbled(table(spark, d, "documents"), "doc_id", "text").select("doc_id").distinct()


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.restore(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = globals()
    return {k: own[k] for k in sorted(own) if k[:1] == "p" and k[1:2].isdigit()}
