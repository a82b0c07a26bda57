"""Evaluation texts leaking into training text (problem 7).

Pigeonhole edit matching on words.  A window of ``min_words`` words of a test item that occurs in a document
with at most ``errors`` word edits has, cut into ``errors + 1`` pieces, one piece that is hit exactly.  The pieces
of all windows are the word runs of that length in the items; a hit names the windows of which it is a
piece and where they would stand, and each is verified with Myers' bit-parallel distance (one bit
a word of the window).  Verbatim leaks are the windows that come out with no edit.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of items in one broadcast block, about one piece each (some 200 bytes in a worker).
BROADCAST_PIECES = 500_000
_DROP = re.compile(r"[^\w\s]|_")


def words(text: str | None) -> list[str]:
    """Words of a text, not regarding case, accents, punctuation and white space."""
    if not text:
        return []
    text = unicodedata.normalize("NFKD", text)
    if not text.isascii():
        text = "".join(c for c in text if not unicodedata.combining(c))
    return _DROP.sub("", text.casefold()).split()


def myers_best(pattern: list[str], text: list[str], budget: int) -> int | None:
    """Least word edits with which ``pattern`` occurs in ``text``, None above ``budget`` (Myers 1999, semi-global)."""
    m = len(pattern)
    peq: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        peq[w] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
        if score < best:
            best = score
            if not best:
                break
    return best if best <= budget else None


class PieceIndex:
    """All pieces of a block of items; a piece is a run of ``piece`` words."""

    def __init__(self, items: list[tuple[object, str | None]], min_words: int, errors: int) -> None:
        self.min_words, self.errors, self.piece = min_words, errors, max(1, min_words // (errors + 1))
        self.items = [(k, w) for k, t in items if len(w := words(t)) >= min_words]
        self.at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.vocabulary: set[str] = set()
        for n, (_, w) in enumerate(self.items):
            self.vocabulary.update(w)
            for p in range(len(w) - self.piece + 1):
                self.at[" ".join(w[p : p + self.piece])].append((n, p))

    def leaks(self, text: str | None) -> dict[object, tuple[int, int]]:
        """item key -> (least edits, windows found) for one document."""
        doc = words(text)
        found: dict[object, tuple[int, int]] = {}
        done: set[tuple[int, int, int]] = set()
        known, size = self.vocabulary, self.piece
        run = 0
        for end, w in enumerate(doc, 1):
            run = run + 1 if w in known else 0
            if run < size:
                continue
            at = end - size
            for n, pos in self.at.get(" ".join(doc[at:end]), ()):
                key, it = self.items[n]
                for w0 in range(pos, pos - self.min_words + size - 1, -size):  # the windows of which this is an aligned piece
                    if w0 < 0 or w0 + self.min_words > len(it):
                        continue
                    lo = at - (pos - w0)
                    if (n, w0, lo) in done:
                        continue
                    done.add((n, w0, lo))
                    segment = doc[max(0, lo - self.errors) : max(0, lo + self.min_words + self.errors)]
                    edits = myers_best(it[w0 : w0 + self.min_words], segment, self.errors)
                    if edits is not None:
                        least, windows = found.get(key, (edits, 0))
                        found[key] = (min(least, edits), windows + 1)
        return found


def _blocks(items: DataFrame, key: str, text: str, size: int) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of at most ``size`` words (one item may be longer); the driver holds one block at a time."""
    block, held = [], 0
    for row in items.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null").toLocalIterator():
        n = len(words(row.t))
        if block and held + n > size:
            yield block
            block, held = [], 0
        block.append((row.k, row.t))
        held += n
    if block:
        yield block


def find_leaks(
    docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, min_words: int = 20, errors: int = 1, block_pieces: int = BROADCAST_PIECES
) -> DataFrame:
    """Documents that hold ``min_words`` consecutive words of an item with at most ``errors`` word edits: ``doc_key``, ``item_key``, ``edits``, ``windows``.

    ``edits`` is the least over the item's windows, 0 for a verbatim passage; ``windows`` counts matches.  The items are the
    stated query set: they are broadcast in blocks of bounded size, each held against all documents, which never shuffle.
    Items shorter than ``min_words`` words cannot leak; null keys of items, null and empty texts match nothing; repeated
    rows of one document key give one row an item; an empty table on either side gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[doc_key], dict(items.dtypes)[item_key]
    schema = f"doc {kinds[0]}, item {kinds[1]}, edits bigint, windows bigint"
    texts = docs.select(F.col(doc_key).alias("doc"), F.col(doc_text).alias("t")).where("t is not null")
    found = None
    for block in _blocks(items, item_key, item_text, block_pieces):
        sent = spark.sparkContext.broadcast(block)

        def run(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = PieceIndex(sent.value, min_words, errors)
            for pdf in frames:
                rows = [(d, i, e, n) for d, t in zip(pdf["doc"], pdf["t"]) for i, (e, n) in index.leaks(t).items()]
                yield pd.DataFrame(rows, columns=["doc", "item", "edits", "windows"])

        part = texts.mapInPandas(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.groupBy(F.col("doc").alias(doc_key), F.col("item").alias(item_key)).agg(F.min("edits").alias("edits"), F.max("windows").alias("windows"))
