from parlaweave.operators import entities as E
from parlaweave.operators import evaluate as V

from conftest import rows


def test_rules():
    one = E.rules_of("O SR. PRESIDENTE (Rui Dias. Bloco/PSD - MG) - Boa tarde.")
    assert [(e["start"], e["end"], e["word"]) for e in one] == [(0, 43, "Presidente Rui Dias PSD-MG")]
    assert E.rules_of("O SR. PRESIDENTE (Rui Dias. PSD - MG) - Boa tarde.", faithful=True) == []
    both = "O SR. PRESIDENTE (Rui Dias. PSD - MG) - Boa tarde.\nA SRA. ANA LIMA (Bloco Alfa/PT - CE) - Obrigada."
    assert [e["metadata"]["party"] for e in E.rules_of(both)] == ["PSD", "PT"]
    giant = E.rules_of(both, faithful=True)
    assert len(giant) == 1 and giant[0]["metadata"] == {"party": "PT", "state": "CE", "title": "PRESIDENTE"}
    plain = E.rules_of("A SRA. ANA LIMA (PT - CE) - Obrigada.")[0]
    assert (plain["start"], plain["end"], plain["word"]) == (0, 25, "ANA LIMA PT-CE")
    assert E.rules_of(None) == []


def _spans(spark, *s):
    return spark.createDataFrame([(1, a, b, w, sc, i) for i, (a, b, w, sc) in enumerate(s)], "k long, start int, end int, word string, score double, ord int")


def test_merge_and_dedup(spark):
    m = lambda *s: rows(E.merge_adjacent(_spans(spark, *s), "k", "ord"), "start")
    assert m((0, 4, "JOSE", 0.9), (5, 10, "SILVA", 0.8)) == [(1, 0, 10, "JOSE SILVA", 0.8)]
    assert m((0, 6, "ABCDEF", 0.9), (4, 9, "EFGHI", 0.9)) == [(1, 0, 9, "ABCDEFGHI", 0.9)]
    assert len(m((0, 4, "A", 0.9), (6, 9, "B", 0.9))) == 2
    best = rows(E.dedup_spans(_spans(spark, (0, 4, "a", 0.7), (0, 4, "b", 0.9), (0, 4, "c", None)), "k", "ord"), "start")
    assert [r[3] for r in best] == ["b"]
    assert E.merge_adjacent(_spans(spark, (0, 1, "x", None)).limit(0), "k", "ord").count() == 0


def test_groups(spark):
    s = spark.createDataFrame([(1, "Ana Lima"), (1, "Ana Lima Souza"), (1, "Rui"), (1, "Rui"), (1, None), (2, "Ana")], "k long, word string")
    got = rows(E.group_similar(s, "k"), "k", "word")
    assert got == [(1, "Ana Lima Souza", "Ana Lima", 1), (1, "Ana Lima Souza", "Ana Lima Souza", 1), (1, "Rui", "Rui", 2), (2, "Ana", "Ana", 1)]


def test_scorer(spark):
    d = spark.createDataFrame([(1, "x " * 600 + "Ana Lima falou"), (2, ""), (3, None)], "k long, t string")
    got = E.dedup_spans(E.score_entities(d, "k", "t"), "k", "word").collect()
    assert {(r.start, r.end, r.word) for r in got} == {(1200, 1208, "Ana Lima")}
    assert E.recognise(d, "k", "t").count() == 1


def test_overlap(spark):
    g = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 50, 60), (1, 2, 8000, 9000)], "k long, gold_id int, start int, end int")
    p = spark.createDataFrame([(1, 0, 8, 12), (1, 1, 0, 10), (1, 2, 60, 70), (1, 3, 4000, 9500)], "k long, pred_id int, start int, end int")
    m = V.first_overlap(g, p, "k")
    assert {(r.gold_id, r.pred_id) for r in m.collect()} == {(0, 0), (2, 3)}
    assert [r.gold_id for r in V.missed(g, m, "k").collect()] == [1]
    assert {r.pred_id for r in V.spurious(p, m, "k").collect()} == {1, 2}


def test_scores(spark):
    d = spark.createDataFrame([(o,) for o, n in (("TP", 6), ("DM", 2), ("FN", 2), ("FP", 2)) for _ in range(n)], "o string")
    r = V.scores(d, "o").first()
    assert [round(r[c], 9) for c in ("precision_strict", "recall_strict", "f1_strict", "precision_lenient", "recall_lenient", "f1_lenient")] == [0.6] * 3 + [0.8] * 3
    assert V.scores(d.limit(0), "o").first().f1_strict == 0
