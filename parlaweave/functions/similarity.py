"""Name similarity on token sets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit a character of ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def indel_ratio(a: str, b: str) -> int:
    """100 * (L - d) / L with d the insertions and deletions between ``a`` and ``b``, rounded."""
    return round(200 * _common(a, b) / (len(a) + len(b))) if a or b else 0


def token_set(s: str | None) -> frozenset[str]:
    return frozenset(re.sub(r"[^a-z0-9]+", " ", (s or "").encode("ascii", "ignore").decode().lower()).split())


def set_score(x: frozenset[str], y: frozenset[str], least: int = 0) -> int:
    """Best of the pairwise ratios of shared tokens, shared + own of ``x``, shared + own of ``y``; 0 if either is empty.

    A score that can't reach ``least`` by the lengths alone is given as 0."""
    if not x or not y:
        return 0
    both = x & y
    if both and (len(both) == len(x) or len(both) == len(y)):
        return 100
    shared = " ".join(sorted(both))
    one, two = (" ".join(filter(None, [shared, " ".join(sorted(s - both))])) for s in (x, y))
    best = max(round(200 * len(shared) / (len(shared) + len(s))) for s in (one, two)) if shared else 0  # shared begins both
    most = 200 * min(len(one), len(two)) / (len(one) + len(two))
    if max(best, round(most)) < least:
        return 0
    return max(best, indel_ratio(one, two))


def token_set_score(a: str | None, b: str | None) -> int:
    return set_score(token_set(a), token_set(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Arrow-batched ``token_set_score`` of two columns."""

    @F.pandas_udf("int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([token_set_score(p, q) for p, q in zip(x, y)], dtype="int32")

    return run(a, b)
