import pytest
from pyspark.sql import functions as F

from parlaweave.operators import graph as G
from parlaweave.operators import resolve as R
from parlaweave.operators import stats as S
from parlaweave.sources import files, html

from conftest import rows


def _edges(spark, *e):
    return spark.createDataFrame([("g", a, b, w) for a, b, w in e], "graph_id string, src string, dst string, weight long")


def test_cycle(spark):
    e = _edges(spark, ("a", "b", 1), ("b", "c", 1), ("c", "a", 1))
    r = G.metrics(e).first().asDict()
    assert r["vertices"] == r["edges"] == 3
    assert {k: round(r[k], 9) for k in ("average_degree", "density", "clustering", "avg_distance", "diameter")} == {"average_degree": 2.0, "density": 0.5, "clustering": 0.5, "avg_distance": 1.5, "diameter": 2.0}
    assert G.sizes(e).first().density_undirected == 1.0


def test_mentions(spark):
    s = spark.createDataFrame([("g", "d", 0, ["A", "B", "B", "C"]), ("g", "d", 1, ["A", "B", "A"]), ("g", "d", 2, ["Z"]), ("g", "d", 3, [])], "graph_id string, doc_id string, speech_no int, names array<string>")
    m = G.mention_rows(s, ["graph_id", "doc_id", "speech_no"])
    e = G.mention_edges(m, ["doc_id", "speech_no"])
    assert rows(e, "dst") == [("g", "A", "B", 2), ("g", "A", "C", 1)]
    v = G.vertices_first_seen(m, ["doc_id", "speech_no"])
    assert [(r[1], r[2]) for r in rows(v, "id")] == [("A", 1), ("B", 2), ("C", 3), ("Z", 4)]
    deg = G.degrees(e, v.select("graph_id", F.col("label").alias("vertex")))
    assert deg.where("vertex = 'Z'").first().degree == 0
    assert tuple(deg.agg(F.sum("in_strength"), F.sum("out_strength")).first()) == (3, 3)


def test_paths_and_communities(spark):
    two = [(a + str(k), b + str(k), 2) for k in (1, 2) for a in "abcd" for b in "abcd" if a < b]
    e = _edges(spark, *two, ("a1", "a2", 5))
    c = G.louvain(e)
    assert {r.community for r in c.collect()} == {"a1", "a2"} and c.count() == 8
    q = G.modularity(e, c).first().modularity
    assert q > G.modularity(e, c.withColumn("community", F.col("vertex"))).first().modularity
    s = G.path_summary(e).first()
    assert s.diameter >= s.avg_distance and s.diameter == 7
    assert G.layout(e, iterations=20).where("x is null or isnan(x)").count() == 0
    assert G.shortest_paths(e.limit(0)).count() == 0


def test_distribution(spark):
    v = spark.createDataFrame([("g", "d", x) for x in (1, 1, 2, 4, None)], "graph_id string, kind string, x long")
    d = S.distribution(v)
    assert [(r.x, r.n, r.ccdf) for r in d.orderBy("x").collect()] == [(1, 2, 1.0), (2, 1, 0.5), (4, 1, 0.25)]
    assert S.loglog_fit(d).count() == 0
    for n, used in ((15, 1), (25, 2), (35, 3)):
        many = spark.createDataFrame([("g", "d", x, 1) for x in range(1, n + 1)], "graph_id string, kind string, x long, n long")
        r = S.loglog_fit(many).first()
        assert r.points == used and (r.slope is None) == (used < 3)
    law = spark.createDataFrame([("g", "d", x, 0.7 * x**-1.5) for x in range(1, 40)], "graph_id string, kind string, x long, p double")
    f = S.power_law_fit(law).first()
    assert (round(f.a, 4), round(f.b, 4), round(f.r2, 4)) == (0.7, -1.5, 1.0)
    assert S.fitted_curve(S.power_law_fit(law), 1, 39).count() == 100


def test_resolver(spark):
    names = ["Arthur Lira PP-AL", "Arthur Lira", "Arthur"]
    run = lambda n, f: [r.canonical for r in R.resolve_in_order(spark.createDataFrame([("g", i, x) for i, x in enumerate(n)], "graph_id string, seq long, name string"), f).orderBy("seq").collect()]
    assert run(names, True) == ["Arthur Lira PP-AL", "Arthur Lira PP-AL", "Arthur"]
    assert run(names[::-1], True) == ["Arthur", "Arthur Lira", "Arthur Lira PP-AL"]
    assert set(run(names, False)) == set(run(names[::-1], False)) == {"Arthur Lira PP-AL"}
    df = spark.createDataFrame([("g", 1, "Ana Lima Souza"), ("g", 2, "Ana Lima Souzza"), ("g", 3, "Rui Dias")], "graph_id string, seq long, name string")
    got = {r.name: r.canonical for r in R.resolve_at_scale(df).collect()}
    assert got == {"Ana Lima Souza": "Ana Lima Souzza", "Ana Lima Souzza": "Ana Lima Souzza", "Rui Dias": "Rui Dias"}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    for most in (500_000, 3):
        assert {(r.node, r.root) for r in R.components(e, most).collect()} == {(i, 1) for i in range(1, 41)} | {(100, 100), (101, 100)}
    assert R.components(e.limit(0)).count() == 0 and [tuple(r) for r in R.components(spark.createDataFrame([("b", "b"), ("a", "b"), ("b", "a")], "a string, b string")).orderBy("node").collect()] == [("a", "a"), ("b", "a")]


def test_gexf_and_files(spark, tmp_path):
    v = spark.createDataFrame([("camara_2020", 1, 'A & "B"'), ("camara_2020", 2, "C")], "graph_id string, id long, label string")
    e = spark.createDataFrame([("camara_2020", 'A & "B"', "C", 3)], "graph_id string, src string, dst string, weight long")
    files.write_gexf(v, e, str(tmp_path / "g"))
    back_v, back_e = files.read_gexf(spark, str(tmp_path / "g" / "graph_id=camara_2020" / "*.txt"))
    assert {(r.id, r.label) for r in back_v.collect()} == {(1, 'A & "B"'), (2, "C")}
    assert [(r.src, r.dst, r.weight) for r in back_e.collect()] == [(1, 2, 3)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1.txt").write_text("CPI:\n12\nPLENO:\n13\nrest\n")
    (tmp_path / "c" / "1.annotated.txt").write_text("x")
    assert rows(files.read_typed_codes(spark, str(tmp_path / "c" / "1.txt")), "codigo") == [("CPI", 12), ("PLENO", 13)]
    assert [r.base for r in files.read_corpus(spark, str(tmp_path / "c")).collect()] == ["1"]
    (tmp_path / "a.txt").write_text("Rui: Rui Dias: x\n\nno colon\n")
    assert rows(files.read_aliases(spark, str(tmp_path / "a.txt")), "alias") == [("Rui", "Rui Dias: x")]
    (tmp_path / "j.json").write_text('{"Ana": [[1, 4, 0.5]], "Rui": [[7, 9]]}')
    assert [tuple(r)[1:] for r in files.read_json_entities(spark, str(tmp_path / "j.json")).orderBy("name").collect()] == [("Ana", 1, 4, 0.5), ("Rui", 7, 9, None)]


def test_pages(spark):
    page = '<html><title>T</title><body><h1>H</h1><b>O SR. X</b><b>n</b><table><td><span class="g-agenda__categoria">CPI da água</span><a href="/x/77">l</a></td><td><span class="g-agenda__categoria">Outros</span><a href="/y/78">m</a></td></table></body></html>'
    f = html.page_fields(spark.createDataFrame([(1, page), (2, None)], "k long, h string"), "k", "h")
    r = f.orderBy("k").collect()
    assert (r[0].title, r[0].heading, r[0].codes) == ("T", "H", ["77", "78"]) and r[1].title is None
    assert [(x.tipo, x.codigo) for x in html.agenda(f, "k").collect()] == [("CPI", "77")]
    assert html.assemble(f, "k").orderBy("k").first().text == "\nCPI da águaOutros"


@pytest.mark.parametrize("a", ["avg", "sum"])
def test_pivot(spark, a):
    from parlaweave.operators import reports

    d = spark.createDataFrame([("C", "x", 1, 1), ("C", "x", 1, 3), ("C", "y", 2, 5), ("S", None, 1, 9)], "fonte string, tipo string, ano int, contador long")
    got = rows(reports.pivot_years(d, [1, 2], a), "tipo")
    assert got == [("C", "x", 2.0 if a == "avg" else 4.0, 0.0), ("C", "y", 0.0, 5.0)]
