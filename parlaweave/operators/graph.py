"""Mention graphs as vertex and edge tables, keyed by ``graph_id``.

Edges are ``graph_id, src, dst, weight``, one row a directed pair.  Everything that looks at neighbourhoods is a
join on (graph_id, vertex); only the operators named so hold one graph in a task.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import parallelism

#: Edges of one graph that a task may hold (paths and communities), vertices of one that a layout may; larger graphs are refused.
TASK_EDGES, LAYOUT_VERTICES = 5_000_000, 5_000
#: Sources of paths that one task walks from, at least.
TASK_SOURCES = 64


def mention_rows(speeches: DataFrame, order: list[str]) -> DataFrame:
    """``speeches`` with ``names`` (first: the speaker) as rows: the columns of ``order``, ``speaker``, ``mention``, ``pos``.  A speech without a mention keeps one row with null."""
    named = speeches.where(F.size("names") > 0).withColumn("speaker", F.col("names")[0])
    rest = F.slice("names", F.lit(2), F.greatest(F.size("names") - 1, F.lit(0)))
    return named.select(*order, "speaker", F.posexplode_outer(rest).alias("pos", "mention"))


def mention_edges(rows: DataFrame, speech: list[str]) -> DataFrame:
    """Edge weights: the speeches in which the speaker names the other; self mentions and repeats inside a speech don't count."""
    kept = rows.where("mention is not null and mention <> speaker").select("graph_id", *speech, F.col("speaker").alias("src"), F.col("mention").alias("dst")).distinct()
    return kept.groupBy("graph_id", "src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def vertices_first_seen(rows: DataFrame, order: list[str]) -> DataFrame:
    """``graph_id``, ``label`` and ``id``, counted from 1 in the order in which labels first appear; speakers without mentions count too."""
    seen = rows.select("graph_id", F.explode(F.array(F.struct(*order, F.lit(-1).alias("pos"), F.col("speaker").alias("label")), F.struct(*order, F.coalesce("pos", F.lit(0)).alias("pos"), F.col("mention").alias("label")))).alias("s"))
    first = seen.where("s.label is not null").groupBy("graph_id", F.col("s.label").alias("label")).agg(F.min(F.struct(*[F.col(f"s.{c}") for c in order], "s.pos")).alias("first"))
    return first.select("graph_id", "label", F.row_number().over(Window.partitionBy("graph_id").orderBy("first", "label")).cast("bigint").alias("id"))


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.explode(F.array("src", "dst")).alias("vertex")).distinct()


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """Total, in and out degree and strength of every vertex, 0 where it has none."""
    ends = edges.select("graph_id", F.explode(F.array(F.struct(F.col("src").alias("vertex"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("vertex"), F.lit(0).alias("o")))).alias("e"), "weight")
    sums = {"in_degree": 1 - F.col("e.o"), "out_degree": F.col("e.o"), "in_strength": (1 - F.col("e.o")) * F.col("weight"), "out_strength": F.col("e.o") * F.col("weight")}
    out = ends.groupBy("graph_id", F.col("e.vertex").alias("vertex")).agg(*[F.sum(v).cast("bigint").alias(k) for k, v in sums.items()])
    if vertices is not None:
        out = vertices.select("graph_id", "vertex").join(out, ["graph_id", "vertex"], "left").na.fill(0)
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree")).withColumn("strength", F.col("in_strength") + F.col("out_strength"))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions as one edge without weight; loops go."""
    return edges.where("src <> dst").select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def to_directed(edges: DataFrame) -> DataFrame:
    """Undirected edges in both directions, each with the weight; loops stay one."""
    back = edges.where("src <> dst").select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), *[F.col(f"`{c}`") for c in edges.columns if c not in ("graph_id", "src", "dst")])
    return edges.unionByName(back)


def undirected_degree(edges: DataFrame) -> DataFrame:
    return undirected(edges).select("graph_id", F.explode(F.array("src", "dst")).alias("vertex")).groupBy("graph_id", "vertex").agg(F.count(F.lit(1)).alias("degree"))


def sizes(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """Vertices, edges, average degree, and density by the directed and by the undirected formula; null where a formula divides by zero."""
    v = (vertices if vertices is not None else vertices_of(edges)).groupBy("graph_id").agg(F.count(F.lit(1)).alias("vertices"))
    e = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"))
    out = v.join(e, "graph_id", "left").na.fill(0, ["edges"])
    pairs = F.nullif(F.col("vertices") * (F.col("vertices") - 1), F.lit(0))
    return out.select("graph_id", "vertices", "edges", (2 * F.col("edges") / F.col("vertices")).alias("average_degree"), (F.col("edges") / pairs).alias("density"), (2 * F.col("edges") / pairs).alias("density_undirected"))


def clustering(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """Average weighted directed clustering a graph (Fagiolo), over all vertices.

    Every triangle is found once: edges point from the vertex of lower degree to the one of higher degree, so a hub is the middle
    of few wedges and the join stays within the number of edges to the power 1.5."""
    plain = edges.where("src <> dst")
    top = plain.groupBy("graph_id").agg(F.max("weight").alias("top"))
    w = F.cbrt(F.col("weight") / F.col("top"))
    pairs = plain.join(top, "graph_id").select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), w.alias("w")).groupBy("graph_id", "a", "b").agg(F.sum("w").alias("w"), (F.count(F.lit(1)) == 2).cast("int").alias("both"))
    ends = pairs.select("graph_id", F.explode(F.array("a", "b")).alias("v"), "both").groupBy("graph_id", "v").agg(F.sum(1 + F.col("both")).alias("d_tot"), F.sum("both").alias("d_bi"), F.count(F.lit(1)).alias("d"))
    deg = ends.select("graph_id", "v", "d")
    ranked = pairs.join(deg.withColumnsRenamed({"v": "a", "d": "da"}), ["graph_id", "a"]).join(deg.withColumnsRenamed({"v": "b", "d": "db"}), ["graph_id", "b"])
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    way = ranked.select("graph_id", F.when(up, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("hi"), "w")
    one, two = way.select("graph_id", "lo", F.col("hi").alias("x"), F.col("w").alias("wx")), way.select("graph_id", "lo", F.col("hi").alias("y"), F.col("w").alias("wy"))
    wedges = one.join(two, ["graph_id", "lo"]).where("x < y")
    closed = wedges.join(pairs.select("graph_id", F.col("a").alias("x"), F.col("b").alias("y"), F.col("w").alias("wz")), ["graph_id", "x", "y"])
    t = closed.select("graph_id", F.explode(F.array("lo", "x", "y")).alias("v"), (2 * F.col("wx") * F.col("wy") * F.col("wz")).alias("p")).groupBy("graph_id", "v").agg(F.sum("p").alias("t"))
    c = t.join(ends, ["graph_id", "v"]).select("graph_id", (F.col("t") / (2 * (F.col("d_tot") * (F.col("d_tot") - 1) - 2 * F.col("d_bi")))).alias("c"))
    n = (vertices if vertices is not None else vertices_of(edges)).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(c.groupBy("graph_id").agg(F.sum("c").alias("c")), "graph_id", "left").select("graph_id", (F.coalesce("c", F.lit(0.0)) / F.col("n")).alias("clustering"))


def shortest_paths(edges: DataFrame, inverse: bool = False) -> DataFrame:
    """Least distances over reachable ordered pairs, summed a source: ``graph_id``, ``src``, ``n``, ``total``, ``longest``.

    The weight is the distance, ``inverse`` takes one over it.  A graph's sources are spread over as many tasks as they make blocks of
    ``TASK_SOURCES`` (no more than there are cores), each of which gets the graph's edges as one row (``TASK_EDGES`` at most)."""
    spark = edges.sparkSession
    kinds = dict(edges.dtypes)
    largest = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > TASK_EDGES:
        raise ValueError(f"a graph has {largest} edges; paths are limited to {TASK_EDGES}")
    cost = 1 / F.col("weight") if inverse else F.col("weight").cast("double")
    tasks = parallelism(spark)
    sources = edges.select("graph_id", "src").distinct()
    blocks = sources.groupBy("graph_id").agg(F.least(F.lit(tasks), F.ceil(F.count(F.lit(1)) / TASK_SOURCES).cast("int")).alias("blocks"))
    packed = edges.where("src <> dst").groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst", cost.alias("cost"))).alias("edges"))
    every = blocks.join(packed, "graph_id").select(F.col("graph_id").alias("g"), "edges", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    mine = sources.join(blocks, "graph_id").select("graph_id", "src", F.expr("cast(pmod(xxhash64(src), blocks) as int)").alias("block"))
    # few rows but much work: a given number of tasks, which must not be coalesced
    mine, every = mine.repartition(4 * tasks, "graph_id", "block"), every.repartition(4 * tasks, "g", "part")

    def run(key: tuple, mine: pd.DataFrame, all_edges: pd.DataFrame) -> pd.DataFrame:
        near = defaultdict(list)
        for e in all_edges["edges"].iloc[0] if len(all_edges) else ():
            near[e["src"]].append((e["dst"], e["cost"]))
        rows = []
        for s in mine["src"]:
            best, heap, tick = {}, [(0.0, 0, s)], 1
            while heap:
                d, _, v = heapq.heappop(heap)
                if v in best:
                    continue
                best[v] = d
                for u, w in near[v]:
                    if u not in best:
                        heapq.heappush(heap, (d + w, tick, u))
                        tick += 1
            del best[s]
            if best:
                rows.append((key[0], s, len(best), sum(best.values()), max(best.values())))
        return pd.DataFrame(rows, columns=["graph_id", "src", "n", "total", "longest"])

    return mine.groupBy("graph_id", "block").cogroup(every.groupBy("g", "part")).applyInPandas(run, f"graph_id {kinds['graph_id']}, src {kinds['src']}, n bigint, total double, longest double")


def path_summary(edges: DataFrame, inverse: bool = False) -> DataFrame:
    """Average distance and diameter over reachable ordered pairs."""
    return shortest_paths(edges, inverse).groupBy("graph_id").agg((F.sum("total") / F.sum("n")).alias("avg_distance"), F.max("longest").alias("diameter"), F.sum("n").alias("reachable_pairs"))


def metrics(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """The seven measures of a graph in one row."""
    size = sizes(edges, vertices).select("graph_id", "vertices", "edges", "average_degree", "density")
    return size.join(clustering(edges, vertices), "graph_id", "left").join(path_summary(edges).select("graph_id", "avg_distance", "diameter"), "graph_id", "left")


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Modularity of a partition (``graph_id``, ``vertex``, ``community``) on the undirected simple graph."""
    und = undirected(edges)
    m = und.groupBy("graph_id").agg(F.count(F.lit(1)).alias("m"))
    left, right = (members.select("graph_id", F.col("vertex").alias(e), F.col("community").alias(f"c_{e}")) for e in ("src", "dst"))
    placed = und.join(left, ["graph_id", "src"]).join(right, ["graph_id", "dst"])
    inner = placed.where("c_src = c_dst").groupBy("graph_id", F.col("c_src").alias("community")).agg(F.count(F.lit(1)).alias("l"))
    ends = placed.select("graph_id", F.explode(F.array("c_src", "c_dst")).alias("community")).groupBy("graph_id", "community").agg(F.count(F.lit(1)).alias("d"))
    part = F.coalesce(F.col("l"), F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)
    return ends.join(inner, ["graph_id", "community"], "left").join(m, "graph_id").groupBy("graph_id").agg(F.sum(part).alias("modularity"))


def edge_kinds(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with ``intra`` and the layout weight and alpha that go with it."""
    left, right = (members.select("graph_id", F.col("vertex").alias(e), F.col("community").alias(f"c_{e}")) for e in ("src", "dst"))
    out = edges.join(left, ["graph_id", "src"]).join(right, ["graph_id", "dst"]).withColumn("intra", F.col("c_src") == F.col("c_dst"))
    return out.select("graph_id", "src", "dst", "weight", "intra", F.when(F.col("intra"), 15.0).otherwise(0.05).alias("layout_weight"), F.when(F.col("intra"), 0.8).otherwise(0.05).alias("alpha"))


def leaders(members: DataFrame, degree: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` members of each community by degree, ties by vertex."""
    by = Window.partitionBy("graph_id", "community").orderBy(F.col("degree").desc(), "vertex")
    return members.join(degree.select("graph_id", "vertex", "degree"), ["graph_id", "vertex"]).withColumn("rank", F.row_number().over(by).cast("bigint")).where(F.col("rank") <= top)


def community_ranks(members: DataFrame, top: int = 12) -> DataFrame:
    """The largest communities, and one row with null ``community`` for the rest: ``rank``, ``communities``, ``members``."""
    size = members.groupBy("graph_id", "community").agg(F.count(F.lit(1)).alias("size"))
    ranked = size.withColumn("rank", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.col("size").desc(), "community")))
    kept = F.col("rank") <= top
    return ranked.groupBy("graph_id", F.when(kept, F.col("rank")).otherwise(top + 1).cast("bigint").alias("rank"), F.when(kept, F.col("community")).alias("community")).agg(F.count(F.lit(1)).alias("communities"), F.sum("size").alias("members"))


def vertex_sizes(members: DataFrame, degree: DataFrame) -> DataFrame:
    """Plot sizes: min-max scaled degree (3 to 153, 30 if all are equal) and the composite of degree and community size."""
    g = Window.partitionBy("graph_id")
    size = F.count(F.lit(1)).over(Window.partitionBy("graph_id", "community"))
    both = members.join(degree.select("graph_id", "vertex", "degree"), ["graph_id", "vertex"]).withColumn("size", size)
    low, high = F.min("degree").over(g), F.max("degree").over(g)
    scaled = F.when(low == high, F.lit(30.0)).otherwise(3 + 150 * (F.col("degree") - low) / F.nullif(high - low, F.lit(0)))
    return both.withColumn("scaled", scaled).withColumn("composite", 10 * F.ln(F.col("degree") + 1) * F.ln(F.col("size") + 1) / F.ln(F.max("size").over(g) + 1))


def louvain(edges: DataFrame) -> DataFrame:
    """Communities of each undirected, unweighted graph: ``graph_id``, ``vertex``, ``community`` (the least vertex of it).

    Multilevel modularity with vertices in order and ties to the smaller community, so the result is the same every time.  One task holds a graph (``TASK_EDGES`` at most)."""
    und = undirected(edges)
    kinds = dict(edges.dtypes)
    largest = und.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > TASK_EDGES:
        raise ValueError(f"a graph has {largest} edges; communities are limited to {TASK_EDGES}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["src"]) | set(pdf["dst"]))
        at = {v: i for i, v in enumerate(names)}
        weight: list[dict[int, float]] = [defaultdict(float) for _ in names]
        for a, b in zip(pdf["src"], pdf["dst"]):
            weight[at[a]][at[b]] += 1.0
            weight[at[b]][at[a]] += 1.0
        belongs, loops, m2 = list(range(len(names))), [0.0] * len(names), 2.0 * len(pdf)
        while True:
            n = len(weight)
            community, k = list(range(n)), [sum(w.values()) + loops[i] for i, w in enumerate(weight)]
            total, moved_any = k[:], False
            moved = True
            while moved:
                moved = False
                for v in range(n):
                    links: dict[int, float] = defaultdict(float)
                    for u, w in weight[v].items():
                        links[community[u]] += w
                    old = community[v]
                    total[old] -= k[v]
                    gain = {c: w - total[c] * k[v] / m2 for c, w in links.items()}
                    best = min(gain, key=lambda c: (-gain[c], c), default=old)
                    if gain.get(best, 0.0) <= gain.get(old, -total[old] * k[v] / m2) + 1e-12:
                        best = old
                    total[best] += k[v]
                    if best != old:
                        community[v], moved, moved_any = best, True, True
            if not moved_any:
                break
            ids = {c: i for i, c in enumerate(sorted(set(community)))}
            merged: list[dict[int, float]] = [defaultdict(float) for _ in ids]
            inner = [0.0] * len(ids)
            for v in range(n):
                inner[ids[community[v]]] += loops[v]
                for u, w in weight[v].items():
                    a, b = ids[community[v]], ids[community[u]]
                    if a == b:
                        inner[a] += w
                    else:
                        merged[a][b] += w
            belongs = [ids[community[b]] for b in belongs]
            weight, loops = merged, inner
        least: dict[int, str] = {}
        for v, b in zip(names, belongs):
            least.setdefault(b, v)
        return pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "vertex": names, "community": [least[b] for b in belongs]})

    return und.groupBy("graph_id").applyInPandas(run, f"graph_id {kinds['graph_id']}, vertex {kinds['src']}, community {kinds['src']}")


def layout(edges: DataFrame, iterations: int = 2000, start_temp: float = 0.1, seed: int = 1) -> DataFrame:
    """Fruchterman-Reingold coordinates ``x``, ``y`` of each graph's vertices; ``edges`` may bring ``layout_weight``.  One task holds a graph; a task's arrays grow with the square of the vertices, so at most ``LAYOUT_VERTICES`` are laid out."""
    kinds = dict(edges.dtypes)
    largest = vertices_of(edges).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > LAYOUT_VERTICES:
        raise ValueError(f"a graph has {largest} vertices; a layout is limited to {LAYOUT_VERTICES}")
    weighted = edges if "layout_weight" in edges.columns else edges.withColumn("layout_weight", F.lit(1.0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        names = sorted(set(pdf["src"]) | set(pdf["dst"]))
        at = {v: i for i, v in enumerate(names)}
        a, b = pdf["src"].map(at).to_numpy(), pdf["dst"].map(at).to_numpy()
        w = pdf["layout_weight"].to_numpy()[:, None]
        p = np.random.default_rng(seed).normal(size=(len(names), 2))
        for i in range(iterations):
            gap = p[:, None, :] - p[None, :, :]
            far = np.maximum((gap**2).sum(-1), 1e-9)
            force = (gap / far[..., None]).sum(1)
            pull = (p[a] - p[b]) * np.linalg.norm(p[a] - p[b], axis=1, keepdims=True) * w
            np.add.at(force, a, -pull)
            np.add.at(force, b, pull)
            long = np.maximum(np.linalg.norm(force, axis=1, keepdims=True), 1e-9)
            p = p + force / long * np.minimum(long, start_temp * len(names) ** 0.5 * (1 - i / iterations))
        return pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "vertex": names, "x": p[:, 0], "y": p[:, 1]})

    return weighted.groupBy("graph_id").applyInPandas(run, f"graph_id {kinds['graph_id']}, vertex {kinds['src']}, x double, y double")


def rotated(x: Column, y: Column) -> tuple[Column, Column]:
    return y, -x
