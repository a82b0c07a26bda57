import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from parlaweave.llm import components, cooccurrence, leakage, mixing, splitting


def _brute_groups(edges):
    group = {}
    for a, b in edges:
        for x in (a, b):
            if x is not None:
                group.setdefault(x, {x})
        if a is not None and b is not None and group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[a]:
                group[x] = group[a]
    return {x: min(g) for x, g in group.items()}


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(1000, 1300)]
    edges = chain + [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(5, None), (None, 9999), (None, None), (7, 7), (1, 0), (0, 1)] + [(1, x) for x in range(3000, 3200)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for bound in (1_000_000, 40):
        got = {r.record_key: r.group_key for r in components.connected_groups(df, "a", "b", bound).collect()}
        assert got == _brute_groups(edges)
    assert components.connected_groups(df.limit(0), "a", "b").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60), st.integers(0, 3))
def test_forest(edges, level):
    a, b = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
    v, r = components.spanning_forest(a, b, level)
    root = dict(zip(v.tolist(), r.tolist()))
    want = _brute_groups(edges)
    assert root.keys() == want.keys() and all((root[x] == root[y]) == (want[x] == want[y]) for x, y in itertools.combinations(want, 2))


def test_pairs(spark):
    rng = random.Random(2)
    rows = [(b, w) for b in range(300) for w in {f"w{min(int(rng.expovariate(0.12)), 60)}" for _ in range(rng.randrange(1, 9))}]
    rows += [(1000, f"w{i}") for i in range(61)] + [(1, None), (None, "w1"), (2, "w0"), (2, "w0"), (3, "")]
    df = spark.createDataFrame(rows, "s long, w string").withColumnRenamed("x", "item")
    got = {(r.word_a, r.word_b): (r.n_a, r.n_b, r.n_ab, r.n) for r in cooccurrence.pair_lift(df, "s", "w", 3, 1, 1.5).collect()}
    inc = {(b, w) for b, w in rows if b is not None and w is not None}
    baskets, count = {}, {}
    for b, w in inc:
        baskets.setdefault(b, set()).add(w)
        count[w] = count.get(w, 0) + 1
    n, both = len(baskets), {}
    for ws in baskets.values():
        for p in itertools.combinations(sorted(ws), 2):
            both[p] = both.get(p, 0) + 1
    want = {p: (count[p[0]], count[p[1]], k, n) for p, k in both.items() if k >= 3 and 1000 * k >= n and k * n >= 1.5 * count[p[0]] * count[p[1]]}
    assert got == want and want
    assert cooccurrence.pair_lift(df.limit(0), "s", "w").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 12)), min_size=1, max_size=200, unique=True), st.sets(st.integers(0, 12)))
def test_block_counts(inc, heavy):
    b, i = (np.array([x[k] for x in inc], np.int64) for k in (0, 1))
    got = dict(zip(zip(*(x.tolist() for x in cooccurrence.count_block(b, i, np.isin(i, list(heavy)))[:2])), cooccurrence.count_block(b, i, np.isin(i, list(heavy)))[2].tolist()))
    want = {}
    for k in set(b.tolist()):
        for p in itertools.combinations(sorted(i[b == k].tolist()), 2):
            want[p] = want.get(p, 0) + 1
    assert got == want


def test_split(spark):
    para = "Uma frase curta aqui. Outra frase, com vírgula; e mais. "
    texts = {1: para * 60, 2: "x" * 2500, 3: "a " + "y" * 1001 + " b " + para * 5, 4: para, 5: "\n\n".join([para * 5] * 8), 6: "\t" * 1500, 7: "x" * 1000}
    df = spark.createDataFrame([*texts.items(), (8, None), (9, ""), (1, texts[1])], "k long, text string")
    pieces = splitting.split_items(df, "k", "text")
    got = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.k, r.piece_no)):
        got.setdefault(r.k, []).append(r)
    assert set(got) == {1, 2, 3, 5, 6}
    for k, ps in got.items():
        before = 0
        for p in ps:
            assert 0 < p.end - p.start <= 1000 and p.start + p.shared == before and p.shared <= 200
            before = p.end
        assert before == len(texts[k])
    assert all(p.kind == "natural" and (not p.start or texts[1][p.start - 1] in " \n") for p in got[1])
    starts = {r.k: r.hard_start for r in splitting.hard_starts(pieces, "k").collect()}
    assert starts == {1: -1, 2: 0, 3: 2, 5: -1, 6: -1}
    assert splitting.split_items(df.limit(0), "k", "text").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text("ab .\n,", max_size=400), st.integers(5, 60))
def test_tiles(text, limit):
    tiles = splitting.pack(text, limit)
    assert "".join(text[a:b] for a, b in tiles) == text and all(b - a <= limit for a, b in tiles)


def _edits(p, t):
    best = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        row = [i]
        for j, y in enumerate(t, 1):
            row.append(min(best[j] + 1, row[-1] + 1, best[j - 1] + (x != y)))
        best = row
    return min(best)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), st.lists(st.sampled_from("abcd"), max_size=20), st.integers(0, 4))
def test_myers(p, t, k):
    d = _edits(p, t)
    assert leakage.myers_best(p, t, k) == (d if d <= k else None)


def test_leaks(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    item = " ".join(words[:40])
    other = " ".join(words[100:119])  # too short
    docs = {
        1: "X " + " ".join(words[5:25]).upper() + " y", 2: " ".join(words[5:24]), 3: " ".join(words[5:15] + ["z"] + words[16:25]), 4: " ".join(f"{w}," for w in words[10:30]).replace(" ", "\n"),
        5: None, 6: "", 7: item, 8: " ".join(words[100:119]), 9: " ".join(words[0:10] + ["q"] + words[10:20]),
    }
    d = spark.createDataFrame([*docs.items(), (7, item)], "doc_id long, text string")
    i = spark.createDataFrame([(1, item), (2, other), (3, None), (4, item)], "item_id long, text string")
    for block in (10, 500_000):
        got = {(r.doc_id, r.item_id): r.edits for r in leakage.find_leaks(d, "doc_id", "text", i, "item_id", "text", block_pieces=block).collect()}
        assert got == {(k, n): e for k, e in ((1, 0), (2, 1), (3, 1), (4, 0), (7, 0), (9, 1)) for n in (1, 4)}
    assert leakage.find_leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0 and leakage.find_leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0


def test_mix(spark):
    rng = random.Random(3)
    docs = [(k, s, rng.randrange(1, 400)) for k, s in enumerate(["a"] * 3000 + ["b"] * 900 + ["c"] * 300)] + [(9001, None, 5), (9002, "z", 5), (9003, "a", 0), (9004, "a", None)]
    d = spark.createDataFrame(docs, "k long, source string, n long")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("none", 0.0, 9)], "source string, target_share double, max_repeat int")
    m = mixing.mix(d, t, "k", "source", "n").collect()
    total = sum(r.copies * r.n_tokens for r in m)
    for s, share, cap in (("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)):
        mine = [r for r in m if r.source == s]
        assert abs(sum(r.copies * r.n_tokens for r in mine) / total - share) < 0.005 and max(r.copies for r in mine) <= cap
    assert {r.k for r in m} == {k for k, s, n in docs if s in "abc" and n} if None not in {s for _, s, _ in docs} else len(m) == 4200
    report = {r.source: r.actual_share for r in mixing.shares(mixing.mix(d, t, "k", "source", "n"), d, t, "source", "n").collect()}
    assert report[None] == 0 and abs(report["a"] - 0.5) < 0.005
    assert mixing.mix(d.limit(0), t, "k", "source", "n").count() == 0
    sized = mixing.count_tokens(spark.createDataFrame([(1, "olá mundo"), (2, None), (3, "")], "k long, text string"), "text")
    assert {r.k: r.n_tokens > 0 for r in sized.collect()} == {1: True, 2: False, 3: False}
