"""Splitting oversized items at natural boundaries (problem 5).

A text is parsed into a tree: sections under headings of each level (marked by ``#``, by tags, or lines in capitals), blank-line
blocks, blocks of markup, list items by indentation, lines (a turn of a transcript is a line), sentences, clauses, words.
Sibling subtrees are merged bottom-up while their span fits the limit, and only nodes that are
themselves too large are descended into.  A word has no boundary inside; one that fits a piece stays whole,
at the cost of overlap, and only one above the limit is cut.  Each piece then reaches back over at most ``overlap``
code points of the one before, as far as the limit allows, to a boundary if there is one in reach.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Where a node of each level may end, coarse to fine.  Each match ends a child, always behind white space.
LEVELS = [
    *(re.compile(rf"[ \t\n\r](?=[ ]{{0,3}}#{{{n}}}[ \t]+\S|<h{n}\b)", re.I) for n in range(1, 7)),  # headings
    re.compile(r"\n(?=[^\Wa-zà-ÿ_][^a-zà-ÿ\n.!?:;,]{3,}\n)"),  # lines in capitals that end no sentence
    re.compile(r"\n[ \t\r]*\n[ \t\n\r]*"),  # blank-line blocks
    re.compile(r"[ \t\n\r](?=</?(?:p|div|section|article|table|blockquote|ul|ol|pre)\b)", re.I),  # blocks of markup
    re.compile(r"[ \t\n\r](?=<(?:li|tr|dt|br)\b)", re.I),
    *(re.compile(rf"\n(?={indent}(?:[-*•–]|\d+[.)]|[a-z]\))[ \t])") for indent in ("", r"[ \t]{1,3}", r"[ \t]{4,7}", r"[ \t]{8,}")),  # list items, outer first
    re.compile(r"[\n\r]+"),  # lines: turns
    re.compile(r"[.!?…]+[\"”’)\]]*[ \t]+"),  # sentences
    re.compile(r"[,;:–—]+[ \t]+"),  # clauses
    re.compile(r"[ \t]+"),  # words
]
#: From here on every text has levels of its own; of those before, only the ones that match somewhere count.
_PLAIN = len(LEVELS) - 4
BREAK = " \t\n\r"
_HARD = re.compile(r"[^ \t\n\r]+")


def _levels(text: str) -> list[re.Pattern[str]]:
    """The levels of a text's tree."""
    return [x for x in LEVELS[:_PLAIN] if x.search(text)] + LEVELS[_PLAIN:]


def _children(text: str, start: int, end: int, level: re.Pattern[str]) -> list[int]:
    """Ends of the children of [start, end) at ``level``."""
    cuts = [m.end() for m in level.finditer(text, start, end) if start < m.end() < end]
    return [*cuts, end]


def _inside(text: str, i: int) -> bool:
    """Whether ``i`` is inside a stretch without space, tab or line break."""
    return 0 < i < len(text) and text[i - 1] not in BREAK and text[i] not in BREAK


def _cut(text: str, a: int, b: int, limit: int, longest: int) -> list[tuple[int, int]]:
    """Tiles a stretch and the white space after it: a stretch of at most ``longest`` stays whole, a longer one is cut at ``limit``."""
    if b - a <= longest and (b - a <= limit or text[a] not in BREAK):
        return [(a, b)]
    m = _HARD.match(text, a, b)
    first = max(m.end(), min(a + limit, b)) if m and m.end() - a <= longest else min(a + limit, b)
    return [(a, first), *((i, min(i + limit, b)) for i in range(first, b, limit))]


def pack(text: str, limit: int, longest: int | None = None, uncut: list[int] | None = None) -> list[tuple[int, int]]:
    """Tiles a text with pieces of at most ``limit`` code points, or ``longest`` where a stretch without boundary needs more.

    ``uncut`` gets the starts of the nodes that have no boundary inside and don't fit ``longest``, in order."""
    levels = _levels(text)
    todo, out = [(0, len(text), 0)], []
    while todo:  # an explicit stack: depth does not depend on the text
        a, b, k = todo.pop()
        if b - a <= limit:
            out.append((a, b))
            continue
        if k == len(levels):  # one word, no boundary inside
            if uncut is not None and (m := _HARD.match(text, a, b)) and m.end() - a > (longest or limit):
                uncut.append(a)
            out += _cut(text, a, b, limit, longest or limit)
            continue
        ends = _children(text, a, b, levels[k])
        if len(ends) == 1:
            todo.append((a, b, k + 1))
            continue
        runs, at, i = [], a, 0
        while i < len(ends):
            if ends[i] - at > limit:  # an oversized child is descended into
                runs.append((at, ends[i], k + 1))
                at, i = ends[i], i + 1
                continue
            j = i
            while j + 1 < len(ends) and ends[j + 1] - at <= limit:  # merge siblings up to the limit
                j += 1
            runs.append((at, ends[j], k + 1))
            at, i = ends[j], j + 1
        todo += reversed(runs)
    return _join_small(out, limit)


def _join_small(pieces: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """Neighbours from different subtrees that fit together become one."""
    out: list[tuple[int, int]] = []
    for a, b in pieces:
        if out and b - out[-1][0] <= limit:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def split_text(text: str, limit: int = 1000, overlap: int = 200, uncut: list[int] | None = None) -> list[tuple[int, int, int, str]]:
    """(start, end, shared, kind): pieces that cover the text; ``shared`` code points belong to the piece before too.

    ``kind`` is ``hard`` if the piece begins or ends inside a stretch without space, tab or line break; ``uncut`` as for ``pack``."""
    tiles = pack(text, limit - overlap, limit, uncut) if len(text) > limit else [(0, len(text))]
    starts = [m.start() for m in re.finditer(r"(?<=[ \t\n\r])[^ \t\n\r]", text)]
    out = []
    for k, (a, b) in enumerate(tiles):
        reach = a
        if k:
            low = max(a - min(overlap, limit - (b - a)), tiles[k - 1][0])
            i = bisect_left(starts, low)
            reach = starts[i] if i < len(starts) and starts[i] < a else (low if _inside(text, a) else a)
        hard = _inside(text, a) or _inside(text, b)
        out.append((reach, b, a - reach, "hard" if hard else "natural"))
    return out


def split_items(items: DataFrame, key: str, text: str, limit: int = 1000, overlap: int = 200) -> DataFrame:
    """Pieces of every item longer than ``limit`` code points: ``key``, ``piece_no`` (from 1), ``start``, ``end``, ``shared``, ``kind``, ``hard_start``.

    ``hard_start`` is the start of the first node of the item's tree that has no boundary inside and is larger than ``limit`` (a stretch without
    space, tab or line break), -1 if there is none (so every piece boundary is natural).  Items that fit, null and empty ones
    give no piece; equal rows (key and text) count once; a null key is a key; other columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    long = items.select(F.col(key), F.col(text).alias("__text")).where(F.length("__text") > limit)
    long = long.dropDuplicates()
    kind = dict(items.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, t in zip(pdf[key], pdf["__text"]):
                uncut: list[int] = []
                pieces = split_text(t, limit, overlap, uncut)
                rows += [(k, n, a, b, shared, how, uncut[0] if uncut else -1) for n, (a, b, shared, how) in enumerate(pieces, 1)]
            yield pd.DataFrame(rows, columns=[key, "piece_no", "start", "end", "shared", "kind", "hard_start"])

    return long.mapInPandas(run, f"`{key}` {kind}, piece_no bigint, start bigint, end bigint, shared bigint, kind string, hard_start bigint")


def hard_starts(pieces: DataFrame, key: str) -> DataFrame:
    """One row per split item: ``key`` and ``hard_start``."""
    return pieces.where("piece_no = 1").select(key, "hard_start").distinct()


def soundness(pieces: DataFrame, items: DataFrame, key: str, text: str, limit: int = 1000, overlap: int = 200) -> DataFrame:
    """Per split item (``key`` and text equal rows count once, keys with one text each): whether its pieces cover it without gap, keep ``limit`` and ``overlap``, and are cut hard anywhere."""
    order = Window.partitionBy(key).orderBy("piece_no")
    linked = pieces.withColumn("ok", F.col("start") + F.col("shared") == F.coalesce(F.lag("end").over(order), F.lit(0)))
    told = linked.groupBy(key).agg(F.min("ok").alias("linked"), F.max("end").alias("last"), F.max(F.col("end") - F.col("start")).alias("longest"), F.max("shared").alias("shared"), F.max((F.col("kind") == "hard").cast("int")).alias("hard"))
    size = items.select(key, F.length(text).alias("n")).where(F.col("n") > limit).distinct()
    return size.join(told, key, "left").select(key, "n", (F.col("linked") & (F.col("last") == F.col("n"))).alias("covered"), (F.col("longest") <= limit).alias("limit_kept"), (F.col("shared") <= overlap).alias("overlap_kept"), (F.col("hard") > 0).alias("cut_hard"))
