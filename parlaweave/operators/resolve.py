"""Resolving spellings of names to canonical ones, in order or at scale."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import set_score, token_set, token_set_ratio
from ..functions.text import name_key
from ..session import checkpoint, parallelism

#: Distinct keys of one graph that a task compares with as many others.
BLOCK_KEYS = 1_000
#: Similar pairs that are united in one task (some 200 bytes each).
TASK_EDGES = 500_000
#: Distinct names of one graph that the ordered resolver folds in one task.
ORDERED_NAMES = 100_000


def resolve_in_order(names: DataFrame, faithful: bool = True, threshold: int = 85, margin: int = 10) -> DataFrame:
    """The ordered resolver: ``graph_id``, ``seq``, ``name``, ``canonical``.

    ``names`` has ``graph_id``, ``seq`` (a total order) and ``name``.  A known key takes its entry's canonical name, which the longest spelling becomes; an unknown key joins
    the one entry it resembles, or the best if it leads by ``margin``, and is a conflict otherwise.  The default is the state of each moment, so a name may change
    over time; with ``faithful=False`` entries (not keys) are candidates and every name gets the final canonical one.  The order matters, so one task folds a graph's names, at most ``ORDERED_NAMES`` different ones."""
    kinds = dict(names.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        entry: dict[str, list[str]] = {}  # key -> [canonical], shared by aliases
        words: dict[str, frozenset[str]] = {}
        conflict: set[str] = set()
        out: list[list[str] | str] = []
        for name, key in zip(pdf["name"], pdf["key"]):
            if not key or key in conflict:
                out.append(name)
                continue
            if key not in entry:
                words[key] = token_set(key)
                close = [(s, k) for k in entry if (s := set_score(words[key], words[k], threshold)) >= threshold]
                if not faithful:  # aliases of one entry are one candidate
                    best: dict[int, tuple[int, str]] = {}
                    for s, k in close:
                        best[id(entry[k])] = max(best.get(id(entry[k]), (0, "")), (s, k), key=lambda c: c[0])
                    close = list(best.values())
                close.sort(key=lambda c: -c[0])
                if not close:
                    entry[key] = [name]
                elif len(close) == 1 or close[0][0] - close[1][0] >= margin:
                    entry[key] = entry[close[0][1]]
                else:
                    conflict.add(key)
                    out.append(name)
                    continue
            held = entry[key]
            if len(name) > len(held[0]):
                held[0] = name
            out.append(held[0] if faithful else held)
        return pd.DataFrame({"graph_id": pdf["graph_id"], "seq": pdf["seq"], "name": pdf["name"], "canonical": [o if isinstance(o, str) else o[0] for o in out]})

    keyed = names.where("name <> ''").select("graph_id", "seq", "name", name_key(F.col("name"), faithful).alias("key"))
    largest = keyed.groupBy("graph_id").agg(F.countDistinct("name").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > ORDERED_NAMES:
        raise ValueError(f"a graph has {largest} names; the ordered resolver is limited to {ORDERED_NAMES}")
    tasks = max(parallelism(names.sparkSession), int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return keyed.repartition(tasks, "graph_id").groupBy("graph_id").applyInPandas(fold, f"graph_id {kinds['graph_id']}, seq {kinds['seq']}, name string, canonical string")


def _united(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over all edges of a task, the least node of a component being its root."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for pdf in frames:
        for a, b in zip(pdf["a"], pdf["b"]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    for at in range(0, len(nodes), 100_000):
        some = nodes[at : at + 100_000]
        yield pd.DataFrame({"node": some, "root": [root(x) for x in some]})


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``node`` and ``root`` (its component's least node) for undirected edges ``a``, ``b``.

    Up to ``task_edges`` edges are united in one task; more go through alternating large and small stars, a few shuffles each, with the same result."""
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    e = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = mark(e)
    if seen[0] <= task_edges:
        kind = dict(e.dtypes)["a"]
        return e.repartition(1).mapInPandas(_united, f"node {kind}, root {kind}")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s")).select("s.a", "s.b")
        new = checkpoint(small.where("a <> b").distinct())
        now = mark(new)
        if now == seen:
            return new.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        e, seen = new, now


def _worded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        words = [sorted(token_set(k)) for k in pdf["key"]]
        yield pd.DataFrame({"graph_id": pdf["graph_id"], "key": pdf["key"], "words": words, "size": [len(" ".join(w)) for w in words]})


def _alike(names: list[str], others: list[str] | None, threshold: int) -> Iterator[tuple[str, str]]:
    """Pairs in reach of ``threshold`` by their shared characters, scored; of ``names`` alone if there are no ``others``."""
    sets = [[token_set(k) for k in ks] for ks in (names, names if others is None else others)]
    bags = [[Counter(" ".join(s)) for s in ss] for ss in sets]
    size = [np.array([b.total() for b in bs], np.int64) for bs in bags]
    shared = np.zeros((len(bags[0]), len(bags[1])), np.int32)
    for c in set().union(*bags[0]) & set().union(*bags[1]):
        shared += np.minimum.outer(*(np.array([b[c] for b in bs], np.int32) for bs in bags))
    near = 400 * shared.astype(np.int64) >= (2 * threshold - 1) * np.add.outer(*size)  # the rounded ratio of a longest common subsequence of all shared characters
    for i, j in zip(*np.nonzero(np.triu(near, 1) if others is None else near)):
        if set_score(sets[0][i], sets[1][j], threshold) >= threshold:
            yield names[i], (names if others is None else others)[j]


def similar_pairs(keys: DataFrame, threshold: int = 85, block: int = BLOCK_KEYS) -> DataFrame:
    """All pairs ``a`` < ``b`` of distinct keys (``graph_id``, ``key``) of a graph whose token-set ratio reaches ``threshold``.

    A pair reaches it by its shared words or by an edit distance.  By shared words: what one of the two has besides is short, so its rarest words, up to that
    length, hold a shared one, which the other is found by.  By edits: the characters both have must suffice; they are counted for all pairs of a graph, ``block``
    keys against ``block`` keys a task, cheap but quadratic in the distinct keys of one graph."""
    spark, kind = keys.sparkSession, dict(keys.dtypes)["graph_id"]
    worded = checkpoint(keys.select("graph_id", "key").distinct().mapInPandas(_worded, f"graph_id {kind}, key string, words array<string>, size int").where("size > 0"))
    words = worded.select("graph_id", "key", "size", F.explode("words").alias("word"))
    count = words.groupBy("graph_id", "word").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("graph_id", "key").orderBy("n", "word").rowsBetween(Window.unboundedPreceding, -1)
    least = 2 * threshold - 1  # twice the ratio that is rounded up to the threshold
    slack = F.col("size") * (1 - least / (400 - least)) + 1e-6
    prefix = words.join(count, ["graph_id", "word"]).withColumn("before", F.coalesce(F.sum(F.length("word") + 1).over(rarest), F.lit(0))).where(F.col("before") <= slack)
    held = prefix.select("graph_id", "word", F.col("key").alias("x")).join(words.select("graph_id", "word", F.col("key").alias("y")), ["graph_id", "word"]).where("x <> y")
    worded_pairs = held.select("graph_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    by_words = worded_pairs.where(token_set_ratio(F.col("a"), F.col("b")) >= threshold)

    def run(cell: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, i, j = cell
        one, two = (pdf.loc[pdf["own"] == k, "key"].tolist() for k in (i, j))
        rows = [(cell[0], min(p), max(p)) for p in _alike(one, None if i == j else two, threshold)]
        return pd.DataFrame(rows, columns=["graph_id", "a", "b"])

    blocks = worded.groupBy("graph_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = worded.join(blocks, "graph_id").select("graph_id", "key", F.expr("cast(pmod(xxhash64(key), blocks) as int)").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = own.select("graph_id", "key", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    tasks = max(parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes but much work, so they must not be coalesced
    by_edits = cells.repartition(tasks, "graph_id", "i", "j").groupBy("graph_id", "i", "j").applyInPandas(run, f"graph_id {kind}, a string, b string")
    return by_words.unionByName(by_edits).distinct()


def resolve_by_key(names: DataFrame) -> DataFrame:
    """The exact part of a resolver: ``graph_id``, ``name``, ``canonical``.  Names of one key take the longest spelling (ties: the least); a name without a key stays."""
    keyed = names.where("name <> ''").select("graph_id", "name", F.coalesce(name_key(F.col("name")), F.col("name")).alias("key")).distinct()
    longest = keyed.groupBy("graph_id", "key").agg(F.min(F.struct((-F.length("name")).alias("l"), "name")).alias("best"))
    return keyed.join(longest, ["graph_id", "key"]).select("graph_id", "name", F.col("best.name").alias("canonical"))


def resolved_mentions(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Mention rows with speaker and mention under their canonical names; names the resolver doesn't know stay.

    All is resolved before anything is counted, so one person is one vertex whatever spelling came first."""
    known = resolved.select(F.col("graph_id").alias("_g"), F.col("name").alias("_n"), F.col("canonical").alias("_c")).distinct()
    out = rows
    for c in ("speaker", "mention"):
        out = out.join(known, (F.col("graph_id") == F.col("_g")) & (F.col(c) == F.col("_n")), "left").withColumn(c, F.coalesce("_c", c)).drop("_g", "_n", "_c")
    return out


def names_of(rows: DataFrame) -> DataFrame:
    """Distinct ``graph_id``, ``name`` of mention rows."""
    return rows.select("graph_id", F.explode(F.array("speaker", "mention")).alias("name")).where("name is not null").distinct()


def resolve_at_scale(names: DataFrame, threshold: int = 85) -> DataFrame:
    """Order-independent resolver: ``graph_id``, ``name``, ``canonical``.

    All similar keys of a graph are linked, and every group takes its longest spelling (ties: the least).  Not the same as the ordered fold:
    there are no conflicts, so a short key that resembles several others brings them into one group."""
    keyed = names.where("name <> ''").select("graph_id", "name", F.coalesce(name_key(F.col("name")), F.col("name")).alias("key")).distinct()
    close = similar_pairs(keyed.select("graph_id", "key"), threshold)
    tie = lambda c: F.concat_ws("\x01", "graph_id", c)
    roots = components(close.select(tie("a").alias("a"), tie("b").alias("b")))
    placed = keyed.join(roots, tie("key") == roots["node"], "left").select("graph_id", "name", F.coalesce("root", tie("key")).alias("root"))
    longest = placed.groupBy("root").agg(F.min(F.struct((-F.length("name")).alias("l"), "name")).alias("best"))
    return placed.join(longest, "root").select("graph_id", "name", F.col("best.name").alias("canonical"))
