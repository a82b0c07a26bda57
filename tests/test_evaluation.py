from parlaweave import session
from parlaweave.operators import entities as E
from parlaweave.operators import evaluate as V
from parlaweave.operators import graph as G
from parlaweave.operators import resolve as R
from parlaweave.operators import stats as S

import pytest
from conftest import rows


def test_outcomes_scores_report(spark):
    gold = spark.createDataFrame([("d", 1, 0, 10, "Ana", "Ana Lima"), ("d", 2, 20, 30, "Rui", "Rui"), ("d", 3, 40, 50, "Bia", "Bia"), ("d", 4, 60, 70, "Zé", "Zé")], "k string, gold_id int, start int, end int, canon string, raw string")
    pred = spark.createDataFrame([("d", 1, 8, 12, "ANA", "Ana Lima"), ("d", 2, 0, 10, "Ana", "Ana Lima"), ("d", 3, 20, 30, "Rui", "Outro"), ("d", 4, 55, 65, "X", "Y"), ("e", 5, 0, 1, "E", "E")], "k string, pred_id int, start int, end int, p_canon string, p_raw string")
    got = V.all_outcomes(gold, pred, "k")
    told = {(r.outcome, r.canon, r.p_canon, r.reason) for r in got.collect()}
    assert told == {("TP", "Ana", "ANA", None), ("DM", "Rui", "Rui", "concept_mismatch"), ("FN", "Bia", None, None), ("DM", "Zé", "X", "name_mismatch"), ("FP", None, "Ana", None), ("FP", None, "E", None)}
    assert rows(V.totals(gold, pred, "k"), "k") == [("d", 4, 4), ("e", 0, 1)]
    lines = [r.line for r in V.report_lines(got).orderBy("part", "name", "at", "line").collect()]
    assert lines[0] == "## NER comparison" and "- precision (strict): 0.2000" in lines and "- recall (lenient): 0.7500" in lines
    assert lines[lines.index("### FN") + 1] == "- gold: Bia | Bia @ (40, 50)" and lines[-2:] == ["- found: Ana | Ana Lima @ (0, 10)", "- found: E | E @ (0, 1)"]
    assert lines[lines.index("### TP") + 1] == "- gold: Ana | Ana Lima @ (0, 10) | found: ANA | Ana Lima @ (8, 12)"
    nothing = V.all_outcomes(gold, pred.limit(0), "k")
    assert {r.outcome for r in nothing.collect()} == {"FN"} and "### TP\n- none" in [r.line for r in V.report_lines(nothing).collect()]
    assert V.all_outcomes(gold.limit(0), pred.limit(0), "k").count() == 0


def test_positions_move_with_the_canonical_name(spark):
    m = spark.createDataFrame([("d", "Ana Lima Sá", 0, 11, 0.91234), ("d", "ana lima", 20, 28, 0.5), ("d", "ANA LIMA SÁ", 40, 51, 0.7), ("d", "ana lima", 20, 28, 0.5), (None, "Rui", 0, 3, 1.0), ("d", None, 1, 2, 1.0)], "k string, word string, start int, end int, score double")
    got = {(r.k, r.canonical): [tuple(p) for p in r.positions] for r in E.group_similar_positions(m, "k").collect()}
    assert got == {("d", "Ana Lima Sá"): [(0, 11, 0.9123), (20, 28, 0.5), (40, 51, 0.7)], (None, "Rui"): [(0, 3, 1.0)]}
    with pytest.raises(ValueError):
        E.group_similar(m, "k", most=2)


def test_merge_keeps_what_the_first_member_brought(spark):
    text = "O SR. PRESIDENTE (Rui Dias. PSD - MG) - Boa tarde, Ana Lima falou."
    got = E.recognise(spark.createDataFrame([("d", text)], "k string, t string"), "k", "t").orderBy("start").collect()
    assert [(r.source, r.metadata and r.metadata.party) for r in got] == [("rule_parliamentary_presidente", "PSD"), (None, None)]


def test_graph_of_one_person_under_several_spellings(spark):
    r = spark.createDataFrame([("g", "d", 0, "Ana Lima", "RUI DIAS", 0), ("g", "d", 1, "ANA LIMA PT-CE", "Rui Dias", 0), ("g", "d", 2, "Ana Lima", "Ana Lima PT-CE", 0), ("h", "e", 0, "Ana Lima", None, None)], "graph_id string, doc_id string, speech_no long, speaker string, mention string, pos int")
    one = R.resolved_mentions(r, R.resolve_by_key(R.names_of(r)))
    assert rows(G.mention_edges(one, ["doc_id", "speech_no"])) == [("g", "ANA LIMA PT-CE", "RUI DIAS", 2)]
    assert one.count() == 4 and rows(one.where("graph_id = 'h'").select("speaker", "mention")) == [("Ana Lima", None)]


def test_bounds_and_fits(spark, monkeypatch):
    e = spark.createDataFrame([("g", f"v{i}", f"v{i + 1}", 1 + i % 3) for i in range(200)], "graph_id string, src string, dst string, weight long")
    for blocks in (64, 7):
        monkeypatch.setattr(G, "TASK_SOURCES", blocks)
        p = G.path_summary(e).first()
        assert (p.reachable_pairs, p.diameter) == (200 * 201 // 2, sum(1 + i % 3 for i in range(200)))
    monkeypatch.setattr(G, "LAYOUT_VERTICES", 10)
    with pytest.raises(ValueError):
        G.layout(e)
    monkeypatch.setattr(R, "ORDERED_NAMES", 1)
    with pytest.raises(ValueError):
        R.resolve_in_order(spark.createDataFrame([("g", 1, "a b"), ("g", 2, "c d")], "graph_id string, seq int, name string"))
    steep = spark.createDataFrame([("g", "k", float(x), 3.0 * x**-20.0) for x in (1, 2, 3, 4)] + [("g", "u", 1.0 + x / 10, 2 * (1.0 + x / 10) ** 9) for x in range(6)], "graph_id string, kind string, x double, p double")
    f = {r.kind: r for r in S.power_law_fit(steep).collect()}
    assert abs(f["k"].b + 20) < 1e-3 and abs(f["k"].a - 3) < 1e-6 and abs(f["u"].b - 9) < 1e-4
    c = spark.createDataFrame([("g", "a", "x"), ("g", "b", "x"), ("g", "c", "y")], "graph_id string, vertex string, community string")
    assert rows(S.community_sizes(c)) == [("g", 2, 2, 1, 1.5, 0.5)]
    assert [tuple(r) for r in S.largest_sizes(c, 1).select("community", "size", "rank").collect()] == [("x", 2, 1)]


def test_checkpoints_need_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())
