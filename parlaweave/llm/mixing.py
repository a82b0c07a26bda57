"""Mixing sources to target weights (problem 8).

Entropy balancing.  The rates closest to taking every document once, in relative entropy, that give each source its
share of all tokens are exponentially tilted in the document's size, ``rate = min(cap, exp(m * size / mean size))`` with one
multiplier ``m`` a source.  The multipliers solve a convex dual: a pass over the size histogram of all documents brackets each of
them on a geometric grid, safeguarded Newton steps finish it; gradient and curvature are aggregates over the histogram.
Rates are then rounded into whole copies by a hash of the document, with a threshold a source under which the realised tokens meet the target.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: A public byte-level BPE vocabulary (``tiktoken`` format: a token in base 64 and its rank a line) and how it cuts text into words.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the word pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Cells of a level of the rounding threshold; the driver holds sources x cells numbers.  More sources than this are refused.
CELLS, MOST_SOURCES = 2048, 5_000


def count_tokens(docs: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` without ``text``, with ``n_tokens``: the tokens of the public tokenizer; 0 for null and empty texts.

    The vocabulary (a file of fixed size) is read by the driver and sent to the executors."""
    keep = [c for c in docs.columns if c != text]
    sent = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, sent.value.splitlines())}
        coder = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in frames:
            yield pdf[keep].assign(n_tokens=[len(coder.encode_ordinary(t)) if t else 0 for t in pdf[text]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    return docs.mapInPandas(run, schema + ", n_tokens bigint")


def _sums(histogram: DataFrame, points: list[tuple[str, float, float, float]]) -> list:
    """Tokens ``g`` and their derivative ``h`` at each (source, multiplier, cap, mean size)."""
    now = histogram.sparkSession.createDataFrame(points, "source string, m double, cap double, mean double")
    size = F.col("n_tokens") / F.col("mean")
    rate = F.least(F.col("cap"), F.exp(F.least(F.col("m") * size, F.lit(700.0))))
    free = F.when(rate < F.col("cap"), rate * size).otherwise(0.0)
    weight = F.col("n_tokens") * F.col("n")
    return histogram.join(F.broadcast(now), "source").groupBy("source", "m").agg(F.sum(rate * weight).alias("g"), F.sum(free * weight).alias("h")).collect()  # a row a point


def solve(histogram: DataFrame, goals: dict[str, tuple[float, int]], means: dict[str, float], steps: int = 100, tolerance: float = 1e-7) -> dict[str, float]:
    """The multiplier of each source; ``goals`` has its tokens wanted (more than 0, less than cap times all it has) and its cap, ``histogram`` (source, n_tokens, n).

    A source's sizes count in units of its own mean.  Brackets are widened until they hold the solution, which always exists; a source
    that isn't met after ``steps`` passes is an error."""
    bracket = {s: [-math.inf, math.inf] for s in goals}
    at: dict[str, float] = {}
    open_, exponent = set(goals), 0
    for _ in range(steps):
        if not open_:
            return at
        wide = [s for s in open_ if math.isinf(bracket[s][0]) or math.isinf(bracket[s][1])]
        points = [(s, at[s], float(goals[s][1]), means[s]) for s in open_ if s in at]
        for s in wide:  # a geometric grid, further out each time
            grid = [0.0] * (not exponent) + [sign * 2.0**e for e in range(exponent - 6 if not exponent else exponent, exponent + 14) for sign in (-1, 1)]
            points += [(s, m, float(goals[s][1]), means[s]) for m in grid]
        exponent += 14 * bool(wide)
        by_source: dict[str, list] = {}
        for r in _sums(histogram, points):
            by_source.setdefault(r.source, []).append(r)
        for s, rows in by_source.items():
            want = goals[s][0]
            best = min(rows, key=lambda r: abs(r.g - want))
            if abs(best.g - want) <= tolerance * want:
                at[s] = best.m
                open_.discard(s)
                continue
            low, high = bracket[s]
            low, high = max([low, *(r.m for r in rows if r.g < want)]), min([high, *(r.m for r in rows if r.g > want)])
            bracket[s] = [low, high]
            if math.isinf(low) or math.isinf(high):
                continue
            step = best.m + (want - best.g) / best.h if best.h > 0 else math.nan
            at[s] = step if low < step < high else (low + high) / 2
    if open_:
        raise RuntimeError(f"no multiplier after {steps} passes for the sources {sorted(open_)}")
    return at


def mix(docs: DataFrame, targets: DataFrame, key: str, source: str, size: str, total: float | None = None, seed: int = 7) -> DataFrame:
    """``key``, ``source``, ``n_tokens``, ``rate`` and ``copies`` of every document of a source with a target.

    ``targets`` has ``source``, ``target_share`` and ``max_repeat``, a row a source (at most ``MOST_SOURCES``).  ``total`` is the size wanted; by default, and at
    most, the largest that all shares allow under their caps.  Documents without a source, of a source without a target, of a share of 0 or without
    tokens get no copy and don't appear; a source's tokens come as near to its goal as whole documents in hash order allow (half the size of one); a source with a target but without tokens is left out and the others share its part.  No document has more than
    ``max_repeat`` copies.  Repeated keys are documents of their own that get the same copies if their sizes agree; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = targets.where("source is not null and target_share > 0").select("source", "target_share", "max_repeat").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    wanted = {r.source: (float(r.target_share), int(r.max_repeat)) for r in rows}
    named = spark.createDataFrame([(s,) for s in sorted(wanted)], "source string")
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(size).cast("bigint").alias("n_tokens")).where("source is not null and n_tokens > 0")
    sized = checkpoint(sized.join(F.broadcast(named), "source"))
    histogram = checkpoint(sized.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")))
    have, means = {}, {}
    for r in histogram.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("tokens"), F.sum("n").alias("docs")).collect():  # a row a source
        have[r.source], means[r.source] = int(r.tokens), r.tokens / r.docs
    wanted = {s: v for s, v in wanted.items() if have.get(s)}
    schema = f"`{key}` {dict(docs.dtypes)[key]}, source string, n_tokens bigint, rate double, copies bigint"
    if not wanted:
        return spark.createDataFrame([], schema)
    share = sum(v[0] for v in wanted.values())
    most = min(cap * have[s] * share / part for s, (part, cap) in wanted.items())
    total = min(total or most, most)
    goals = {s: (part / share * total, cap) for s, (part, cap) in wanted.items()}
    full = {s for s, (g, cap) in goals.items() if g >= cap * have[s] * (1 - 1e-9)}
    tilt = solve(histogram, {s: g for s, g in goals.items() if s not in full}, means)
    plan = spark.createDataFrame([(s, tilt.get(s, 0.0), float(goals[s][1]), means[s], s in full) for s in sorted(goals)], "source string, m double, cap double, mean double, is_full boolean")
    rate = F.when(F.col("is_full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.exp(F.least(F.col("m") * F.col("n_tokens") / F.col("mean"), F.lit(700.0)))))
    rated = sized.join(F.broadcast(plan), "source").withColumn("rate", rate).withColumn("part", F.col("rate") - F.floor("rate"))
    # a document takes one copy more if its place, the hash less the part of a copy it is due, is below the source's threshold
    chance = F.pmod(F.xxhash64("key", "n_tokens", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = F.floor((chance - F.col("part") + 1) * (CELLS * CELLS // 2)).cast("bigint")
    rated = rated.withColumn("place", F.when(F.col("part") > 0, place))
    whole = {r.source: r.n for r in rated.groupBy("source").agg(F.sum(F.floor("rate") * F.col("n_tokens")).alias("n")).collect()}  # a row a source
    cut = dict.fromkeys(goals, 0)
    for level in (CELLS, 1):  # first the cell of the threshold, then the place in it
        cuts = spark.createDataFrame(sorted(cut.items()), "source string, cut bigint")
        near = rated.join(F.broadcast(cuts), "source").where("place is not null")
        if level == 1:
            near = near.where(F.floor(F.col("place") / CELLS) == F.floor(F.col("cut") / CELLS))
        found: dict[str, list[tuple[int, int]]] = {}
        for r in near.groupBy("source", (F.floor(F.col("place") / level) * level).alias("at")).agg(F.sum("n_tokens").alias("n")).collect():  # sources x CELLS
            found.setdefault(r.source, []).append((r["at"], r.n))
        for s, (goal, _) in goals.items():
            for first, n in sorted(found.get(s, [])):
                # a whole cell is taken if it fits; at the last level also if it brings the tokens nearer to the goal
                if whole[s] + n > goal and not (level == 1 and whole[s] + n - goal < goal - whole[s]):
                    cut[s] = first
                    break
                whole[s] += n
                cut[s] = first + level
    cuts = spark.createDataFrame(sorted(cut.items()), "source string, cut bigint")
    extra = F.when(F.col("place") < F.col("cut"), 1).otherwise(0)
    out = rated.join(F.broadcast(cuts), "source").withColumn("copies", (F.floor("rate") + extra).cast("bigint"))
    return out.select(F.col("key").alias(key), "source", "n_tokens", "rate", "copies")


def shares(mixed: DataFrame, docs: DataFrame, targets: DataFrame, source: str, size: str) -> DataFrame:
    """Per source (null and untargeted ones too): what there is, what was taken, target and actual share."""
    there = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(size).alias("n_tokens"))
    taken = mixed.groupBy("source").agg(F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    whole = F.lit(float(taken.agg(F.sum("mixed_tokens")).first()[0] or 0))
    out = there.join(targets.select("source", "target_share", "max_repeat"), "source", "left").join(taken, "source", "left")
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("n_copies", "mixed_tokens", "most_copies")}
    return out.withColumns(filled).withColumn("actual_share", F.when(whole > 0, F.round(F.col("mixed_tokens") / whole, 6)))
