import itertools
import random

from parlaweave.functions.similarity import token_set_score
from parlaweave.operators import resolve as R


def test_all_pairs_against_brute_force(spark):
    rng = random.Random(7)
    given, family = ["rogerio", "ana", "tatiana", "joao", "li"], ["gonfurez", "guimmimar", "xalhalanda", "silva", "souza", "hamranelves"]
    keys = {"rogerio gonfurez guimmimar", "rogerio gonfurez guimmimar junior", "guimmimar rogerio gonfurez", "regerio gonfurez guimmimar", "silva", "silvah", "ção", "12"}
    for _ in range(90):
        w = [rng.choice(given), *rng.sample(family, rng.randrange(4))]
        if rng.random() < 0.5:
            rng.shuffle(w)
        k = " ".join(w)
        if rng.random() < 0.5:
            i = rng.randrange(len(k))
            k = k[:i] + rng.choice(["", "x", k[i] * 2]) + k[i + 1 :]
        keys.add(k.strip())
    want = {("g", a, b) for a, b in itertools.combinations(sorted(keys), 2) if token_set_score(a, b) >= 85}
    df = spark.createDataFrame([("g", k) for k in keys] + [("h", "silva")], "graph_id string, key string")
    for block in (1000, 20):
        assert {tuple(r) for r in R.similar_pairs(df, block=block).collect()} == want
    assert ("g", "rogerio gonfurez guimmimar", "rogerio gonfurez guimmimar junior") in want and ("g", "regerio gonfurez guimmimar", "rogerio gonfurez guimmimar") in want and ("g", "silva", "silvah") in want
    assert R.similar_pairs(df.limit(0)).count() == 0


def test_extra_and_reordered_words_resolve(spark):
    n = ["Rogério Gonfurez Guimmimar", "Rogério Gonfurez Guimmimar Júnior", "Guimmimar Gonfurez Rogério", "Rui Dias"]
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(n)], "graph_id string, seq long, name string")
    assert {r.name: r.canonical for r in R.resolve_at_scale(df).collect()} == {x: n[1] if x != "Rui Dias" else x for x in n}
