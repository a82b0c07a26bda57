import itertools
import math
import random

from parlaweave.plans import registry


def test_speech_graphs_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for g in ("a", "b"):
        for s in range(40):
            side = rng.randrange(2)
            rows += [(g, s, f"p{side * 6 + k}", rng.randrange(1, 4)) for k in rng.sample(range(6), 3)]
        rows.append((g, 0, "p11", 1))
    spark.createDataFrame(rows, "graph_id string, speech_id long, word string, weight long").write.parquet(str(tmp_path / "speech_mention.parquet"))
    run = lambda n: registry.queries()[n](spark, str(tmp_path)).collect()

    weight = {}
    for g, s in sorted({r[:2] for r in rows}):
        said = {}
        for _, _, w, n in (r for r in rows if r[:2] == (g, s)):
            said[w] = max(said.get(w, 0), n)
        src = min(said, key=lambda w: (-said[w], w))
        for w in said.keys() - {src}:
            weight[g, src, w] = weight.get((g, src, w), 0) + 1
    kinds = {(r.graph_id, r.src, r.dst): r for r in run("edge_intra_inter_speeches")}
    assert {k: r.weight for k, r in kinds.items()} == weight
    places = run("vertex_plot_sizes_speeches")
    home = {(r.graph_id, r.vertex): r.community for r in places}
    assert all(r.intra == (home[g, a] == home[g, b]) and r.layout_weight == (15.0 if r.intra else 0.05) for (g, a, b), r in kinds.items())
    leaders = {(r.graph_id, r.community, r.rank): r.vertex for r in run("community_leaders_speeches")}
    average, diameter, quality = ({r.graph_id: r for r in run(n)} for n in ("path_average_speeches", "path_diameter_speeches", "modularity_speeches"))
    for g in ("a", "b"):
        vs = sorted({v for k in weight if k[0] == g for v in k[1:]})
        far = {(a, b): weight.get((g, a, b), math.inf) for a in vs for b in vs}
        for m, a, b in itertools.product(vs, repeat=3):
            far[a, b] = min(far[a, b], far[a, m] + far[m, b])
        got = [d for (a, b), d in far.items() if a != b and d < math.inf]
        assert average[g].reachable_pairs == len(got) and abs(average[g].avg_distance - sum(got) / len(got)) < 1e-9 and diameter[g].diameter == max(got)
        degree = {v: sum((k[1] == v) + (k[2] == v) for k in weight if k[0] == g) for v in vs}
        und = {frozenset(k[1:]) for k in weight if k[0] == g}
        q = 0.0
        for c in {home[g, v] for v in vs}:
            inside = [v for v in vs if home[g, v] == c]
            q += sum(u <= set(inside) for u in und) / len(und) - (sum(len(u & set(inside)) for u in und) / (2 * len(und))) ** 2
            best = sorted(inside, key=lambda v: (-degree[v], v))[:3]
            assert [leaders.get((g, c, k)) for k in range(1, len(best) + 1)] == best
        assert abs(quality[g].modularity - q) < 1e-9
        low, high = min(degree.values()), max(degree.values())
        assert all(abs(r.scaled - (3 + 150 * (degree[r.vertex] - low) / (high - low))) < 1e-9 for r in places if r.graph_id == g)
    at = run("layout_coordinates_speeches")
    assert {(r.graph_id, r.vertex) for r in at} == set(home) and all(math.isfinite(r.x) and math.isfinite(r.y) for r in at)
