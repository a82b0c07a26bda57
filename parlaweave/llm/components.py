"""Consolidating pairwise matches into groups (problem 6).

Hierarchical spanning forests.  A level runs union-find inside every partition of the edge table
and keeps only the spanning forest of that partition (at most one edge a node).  Forests that
meet in a node are then merged: the node keeps one pointer and its other roots become edges of a
smaller graph that only has roots as nodes.  Once the remaining forest fits the documented bound
of one task it is finished there; until then levels are repeated, each on fewer nodes.  Roots are
chosen by a hash that changes with the level, so long chains in key order shrink by a constant
factor a level instead of one node a level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: Edges that one union-find task may hold (16 bytes each and about 100 bytes of bookkeeping).
TASK_EDGES = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _priority(keys: np.ndarray, level: int) -> np.ndarray:
    """A bijective 64-bit mix of the keys that differs from level to level (ties are impossible)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64(level + 1) * _MIX
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def spanning_forest(a: np.ndarray, b: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node of the edges, the root being the node of least priority."""
    if not len(a):
        return a, b
    keys, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.argsort(_priority(keys, level), kind="stable")
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys))
    left, right = rank[codes[: len(a)]].tolist(), rank[codes[len(a) :]].tolist()
    parent = list(range(len(keys)))
    for x, y in zip(left, right):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    for i in range(len(parent)):  # a parent is always less than its child, so one sweep flattens
        parent[i] = parent[parent[i]]
    by_rank = keys[order]
    return by_rank, by_rank[np.asarray(parent)]


def _forest_of(level: int, task_edges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held, limit = [], [], 0, task_edges

        def fold() -> None:
            nonlocal a, b, held, limit
            v, r = spanning_forest(np.concatenate(a), np.concatenate(b), level)
            keep = v != r
            a, b, held = [v[keep]], [r[keep]], int(keep.sum())
            limit = max(task_edges, 2 * held)

        for batch in batches:
            a.append(batch.column(0).to_numpy(zero_copy_only=False))
            b.append(batch.column(1).to_numpy(zero_copy_only=False))
            held += batch.num_rows
            if held >= limit:  # forest edges replace the edges read so far
                fold()
        if a:
            fold()
            for at in range(0, len(a[0]), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(a[0][at : at + 65_536]), pa.array(b[0][at : at + 65_536])], names=["a", "b"])

    return run


def connected_groups(edges: DataFrame, a: str, b: str, task_edges: int = TASK_EDGES) -> DataFrame:
    """One row (``record_key``, ``group_key``) for each non-null key of ``edges``' columns ``a`` and ``b``.

    ``group_key`` is the smallest key of the component.  Null keys link nothing, but the other key of
    such a row counts; rows of a key with itself and repeats in both directions change nothing; an
    empty table gives an empty result; other columns are ignored.
    """
    pairs = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("record_key")).where("record_key is not null").distinct()
    todo = pairs.where("a is not null and b is not null and a <> b")
    pointers: list[DataFrame] = []
    level = 0
    while True:
        forest = checkpoint(todo.mapInArrow(_forest_of(level, task_edges), "a bigint, b bigint"))
        held = forest.count()
        if held <= task_edges:  # bounded: one task merges what is left
            pointers.append(forest.repartition(1).mapInArrow(_forest_of(level, task_edges), "a bigint, b bigint"))
            break
        # a node's pointers from all partitions meet: at most one row a partition, so no hot key
        met = checkpoint(forest.groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("roots")))
        pointers.append(met.select("a", F.col("m").alias("b")))
        roots = forest.select(F.col("b").alias("a")).distinct()
        linked = met.where(F.size("roots") > 1).select(F.explode("roots").alias("a"), F.col("m").alias("b")).where("a <> b")
        still = met.join(roots, "a", "left_semi").select("a", F.col("m").alias("b"))
        todo = linked.unionByName(still).repartition(max(1, -(-held // task_edges)))
        level += 1
    # pointers of the last level first: each level's targets are nodes of the next
    final = pointers[-1].select(F.col("a").alias("node"), F.col("b").alias("root"))
    for step in reversed(pointers[:-1]):
        up = final.withColumnRenamed("node", "b").withColumnRenamed("root", "top")
        here = step.join(up, "b", "left").select(F.col("a").alias("node"), F.coalesce("top", "b").alias("root"))
        later = final.join(here.select("node"), "node", "left_anti")
        final = checkpoint(here.unionByName(later))
    rooted = nodes.join(final.withColumnRenamed("node", "record_key"), "record_key", "left").select("record_key", F.coalesce("root", "record_key").alias("root"))
    least = rooted.groupBy("root").agg(F.min("record_key").alias("group_key"))
    return rooted.join(least, "root").select("record_key", "group_key")
