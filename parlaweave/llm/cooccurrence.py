"""Items that appear together (problem 4).

Support pruning first: a pair can only reach ``min_count`` and ``1/per_mille`` of the baskets if both
of its items do, and at most ``1000 / per_mille`` times the mean basket size items can.  That bound
does not grow with the number of baskets, so the dictionary of surviving items is small.

Counting is a heavy-light decomposition inside blocks of whole baskets:
* frequent items are rows of a dense bit matrix over the block's baskets; a pair is AND + popcount;
* pairs of rare items are hash-counted from the baskets' lists of rare items;
* mixed pairs probe the frequent item's bits at the rare item's list of baskets.
Each block sends one count a pair, and the blocks' counts are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import parallelism

#: Baskets in a bit-matrix block: 65,536 baskets are 8 KB a frequent item.
BLOCK_BASKETS = 65_536
#: An item in more than one basket of ``HEAVY_SHARE`` is heavy: its bit row is then denser than its list.
HEAVY_SHARE = 64
#: Codes of rare pairs held before they are folded into counts.
PAIR_BUFFER = 4_000_000


def _sum_codes(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    allc = np.concatenate(codes)
    u, inv = np.unique(allc, return_inverse=True)
    return u, np.bincount(inv, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)


def count_block(basket: np.ndarray, item: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a < b) with their count in one block of whole baskets.

    ``basket``/``item`` are distinct incidences; ``heavy`` is a flag for each incidence's item."""
    _, row = np.unique(basket, return_inverse=True)
    n_rows = int(row.max()) + 1 if len(row) else 0
    out_a, out_b, out_n = [], [], []

    def emit(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        keep = n > 0
        a, b, n = a[keep], b[keep], n[keep]
        out_a.append(np.minimum(a, b)), out_b.append(np.maximum(a, b)), out_n.append(n)

    h_items, h_idx = np.unique(item[heavy], return_inverse=True)
    bits = np.zeros((len(h_items), (n_rows + 63) // 64 * 64), np.uint8)
    bits[h_idx, row[heavy]] = 1
    words = np.packbits(bits, axis=1).view(np.uint64) if len(h_items) else np.zeros((0, 0), np.uint64)
    for i in range(len(h_items) - 1):
        n = np.bitwise_count(words[i + 1 :] & words[i]).sum(axis=1).astype(np.int64)
        emit(np.full(len(n), h_items[i]), h_items[i + 1 :], n)

    l_row, l_item = row[~heavy], item[~heavy]
    by_item = np.argsort(l_item, kind="stable")  # lists of baskets of the rare items
    l_items, starts = np.unique(l_item[by_item], return_index=True)
    lists = np.split(l_row[by_item], starts[1:]) if len(l_items) else []
    if len(h_items):
        for it, rows in zip(l_items, lists):
            n = bits[:, rows].sum(axis=1, dtype=np.int64)
            emit(np.full(len(n), it), h_items, n)

    by_row = np.lexsort((l_item, l_row))
    l_row, l_item = l_row[by_row], l_item[by_row]
    codes, counts, held = [], [], 0
    base = np.int64(item.max()) + 1 if len(item) else np.int64(1)
    alive, step = np.arange(len(l_row)), 1
    while len(alive):  # pairs of members ``step`` apart in their basket; members ascend, so a < b
        alive = alive[alive + step < len(l_row)]
        alive = alive[l_row[alive] == l_row[alive + step]]
        for part in np.array_split(alive, len(alive) // PAIR_BUFFER + 1):
            codes.append(l_item[part] * base + l_item[part + step])
            counts.append(np.ones(len(part)))
            held += len(part)
            if held >= PAIR_BUFFER:
                u, n = _sum_codes(codes, counts)
                codes, counts, held = [u], [n], 0
        step += 1
    if codes:
        u, n = _sum_codes(codes, counts)
        emit(u // base, u % base, n)
    if not out_a:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_n)


def _count_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One partition of incidences sorted by basket: cut into blocks of whole baskets, count each, add up."""
    codes, counts, base = [], [], np.int64(1) << 31
    held: list[pd.DataFrame] = []
    baskets = 0

    def flush(pdf: pd.DataFrame) -> None:
        if len(pdf):
            a, b, n = count_block(pdf["basket"].to_numpy(), pdf["item"].to_numpy().astype(np.int64), pdf["heavy"].to_numpy().astype(bool))
            if len(a):
                codes.append(a * base + b), counts.append(n)
            if len(codes) > 8:
                u, n = _sum_codes(codes, counts)
                codes[:], counts[:] = [u], [n]

    for pdf in frames:
        held.append(pdf)
        baskets += pdf["basket"].nunique()
        if baskets >= BLOCK_BASKETS:
            block = pd.concat(held)
            last = block["basket"].iloc[-1]  # may go on in the next batch
            flush(block[block["basket"] != last])
            held, baskets = [block[block["basket"] == last]], 1
    if held:
        flush(pd.concat(held))
    if codes:
        u, n = _sum_codes(codes, counts)
        yield pd.DataFrame({"a": u // base, "b": u % base, "n_ab": n})


def pair_lift(
    records: DataFrame, basket: str, item: str, min_count: int = 5, per_mille: int = 1, min_lift: float = 3.0
) -> DataFrame:
    """Pairs of ``item`` that share baskets: ``word_a < word_b`` (code points), ``n_a``, ``n_b``, ``n_ab``, ``n`` and ``lift``.

    Rows with a null basket or item are left out, repeats of (basket, item) count once.  Kept are pairs
    with ``n_ab >= min_count``, ``1000 * n_ab >= per_mille * n`` and ``n_ab * n >= min_lift * n_a * n_b``.  The empty string is
    an item as any other; an empty table gives an empty result; other columns are ignored.
    """
    inc = records.select(F.col(basket).alias("basket"), F.col(item).cast("string").alias("item_name")).where("basket is not null and item_name is not null").distinct()
    sizes = inc.groupBy("item_name").agg(F.count(F.lit(1)).alias("n_item"))
    total = inc.select(F.countDistinct("basket").alias("n"), F.count(F.lit(1)).alias("incidences"))
    n, incidences = total.first()
    least = max(min_count, -(-per_mille * n // 1000), 1)
    # at most incidences / least items survive: the mean basket size times 1000 / per_mille, whatever the number of baskets
    frequent = sizes.where(F.col("n_item") >= least)
    named = frequent.select("item_name", "n_item", (F.col("n_item") > n // HEAVY_SHARE).alias("heavy"), F.row_number().over(Window.orderBy("item_name")).cast("bigint").alias("item"))
    bound = incidences // least
    named = F.broadcast(named) if bound <= 500_000 else named
    coded = inc.join(named, "item_name").select("basket", "item", "heavy")
    spark = records.sparkSession  # a given number keeps small inputs from being coalesced into one task
    n_parts = max(parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = coded.repartition(n_parts, "basket").sortWithinPartitions("basket")
    counted = parts.mapInPandas(_count_blocks, "a bigint, b bigint, n_ab bigint").groupBy("a", "b").agg(F.sum("n_ab").alias("n_ab"))
    counted = counted.where((F.col("n_ab") >= min_count) & (F.col("n_ab") * 1000 >= per_mille * n))
    left = named.select(F.col("item").alias("a"), F.col("item_name").alias("word_a"), F.col("n_item").alias("n_a"))
    right = named.select(F.col("item").alias("b"), F.col("item_name").alias("word_b"), F.col("n_item").alias("n_b"))
    out = counted.join(left, "a").join(right, "b").where(F.col("n_ab") * F.lit(n) >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
    return out.select("word_a", "word_b", "n_a", "n_b", "n_ab", F.lit(n).cast("bigint").alias("n"), (F.col("n_ab") * F.lit(float(n)) / (F.col("n_a") * F.col("n_b"))).alias("lift"))
