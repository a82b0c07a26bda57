from parlaweave.functions import text as X
from parlaweave.operators import graph, reports
from parlaweave.sources import files, html
from pyspark.sql import functions as F

from conftest import rows


def _write(folder, **named):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in named.items():
        (folder / name.replace("__", ".")).write_text(text, encoding="utf-8", newline="")


def test_corpora_and_titles(spark, tmp_path):
    _write(tmp_path / "camara" / "2020", b__txt="x", a__txt="data\r\n Comissão: \nfala", a__annotated__txt="O SR. X")
    _write(tmp_path / "camara" / "2020" / "deep", c__txt="y")
    root = str(tmp_path / "camara")
    assert {r.base for r in files.read_corpus(spark, root).collect()} == {"a", "b", "c"}
    g = rows(files.read_graph_corpus(spark, root + "/2020").select("graph_id", "base"), "base")
    assert g == [("2020", "a"), ("2020", "a.annotated"), ("2020", "b")]
    assert rows(files.count_files(spark, root), "folder") == [("2020", 3), ("deep", 1)]
    t = {r.doc_id.rsplit("/", 1)[-1]: (r["first"], r.second) for r in files.read_titles(spark, root).collect()}
    assert t == {"a.txt": ("data", "Comissão"), "b.txt": ("x", None), "c.txt": ("y", None)}


def test_codes(spark, tmp_path):
    c = spark.createDataFrame([(2020, "CPI", 7), (2020, "CPI", None), (2021, None, 8)], "ano int, tipo string, codigo long")
    files.write_codes(c, str(tmp_path / "codes"))
    files.write_codes(c.where("ano = 2021"), str(tmp_path / "codes"), "append")
    assert sorted(map(tuple, files.read_typed_codes(spark, str(tmp_path / "codes/ano=2020")).collect())) == [("CPI", 7)]
    assert [r.codigo for r in files.read_codes(spark, str(tmp_path / "codes/ano=2021")).collect()] == [8, 8]
    assert rows(files.agenda_urls(spark, "http://x/01/{ano}-31/{ano}", 2019, 2020), "ano") == [(2019, "http://x/01/2019-31/2019"), (2020, "http://x/01/2020-31/2020")]
    codes = files.urls_of(files.probe_codes(spark, "senado", 5, 3), "http://x/{codigo}")
    assert [r.url for r in codes.orderBy("codigo").collect()] == ["http://x/5", "http://x/6", "http://x/7"]
    got = files.fetch_pages(codes, fetch=lambda u: (200, "<b>oi</b>") if u[-1] == "5" else (500, "broken") if u[-1] == "6" else (0, None))
    assert rows(got.select("codigo", "status", "html"), "codigo") == [(5, 200, "<b>oi</b>"), (6, 500, None), (7, 0, None)]
    failed = html.failed(got.withColumn("tipo", F.lit("T")))
    assert [r.value for r in files.failed_lines(failed).collect()] == ["T6"]
    assert files.http_get("http://127.0.0.1:9/none", seconds=1) == (0, None)


def test_json_aliases_csv(spark, tmp_path):
    _write(tmp_path / "j", a__json='{"Ana Lima": [[0, 8, 0.9], [10, 18, 1.0]], "Rui": [[20, 23, 0.5]]}', b__json="{broken")
    got = files.read_json_entities(spark, str(tmp_path / "j")).select("name", "start", "end", "score")
    assert rows(got, "start") == [("Ana Lima", 0, 8, 0.9), ("Ana Lima", 10, 18, 1.0), ("Rui", 20, 23, 0.5)]
    groups = got.groupBy(F.lit(1).alias("k"), "name").agg(F.array_sort(F.collect_list(F.struct("start", "end", "score"))).alias("positions"))
    text = files.entities_json(groups, "k", "name").first().json
    assert text == '{"Ana Lima":[[0.0,8.0,0.9],[10.0,18.0,1.0]],"Rui":[[20.0,23.0,0.5]]}'
    _write(tmp_path / "a", a__txt="zé: José\n\nno colon\nx:y:z\n")
    assert rows(files.read_aliases(spark, str(tmp_path / "a")), "alias") == [("x", "y:z"), ("zé", "José")]
    counts = spark.createDataFrame([(2020, 3, "Camara", None)], "Ano int, Contador int, Fonte string, Tipo string")
    files.write_csv(counts, str(tmp_path / "csv"))
    assert rows(files.read_counts(spark, str(tmp_path / "csv"))) == [(2020, 3, "Camara", None)]
    m = spark.createDataFrame([("g2", 1), ("g1", 2)], "graph_id string, vertices int")
    path = files.write_metrics(m, str(tmp_path), "camara", "20200101")
    assert path.endswith("metricas_camara_20200101") and spark.read.csv(path, header=True).count() == 2


def test_documents_out_and_in(spark, tmp_path):
    d = spark.createDataFrame([("a.annotated", "linha\noutra"), ("b", None)], "name string, text string")
    files.write_documents(d, str(tmp_path / "out"), "name", "text")
    back = spark.read.text(str(tmp_path / "out"), wholetext=True, recursiveFileLookup=True, pathGlobFilter="part-*")
    assert [r.value.rstrip("\n") for r in back.collect()] == ["linha\noutra"]
    told = reports.timed_write(d, str(tmp_path / "timed"))
    assert told["rows"] == 2 and told["seconds_per_row"] * 2 == told["seconds"]


def test_entity_files(spark):
    g = spark.createDataFrame([("x/1.grouped_entities.json",), ("2.grouped_entities.json",), ("3.grouped_entities.json",), ("4.grouped_entities.json",)], "path string")
    t = spark.createDataFrame([("1.txt", "um"), ("1", "nu"), ("2", "dois"), ("3.txt", None)], "file string, text string")
    got = files.text_of_entities(g, t)
    assert rows(got.select("base", "text", "status"), "base") == [("1", "um", "processed"), ("2", "dois", "processed"), ("3", None, "processed"), ("4", None, "skipped")]
    assert rows(files.status_counts(got), "status") == [("processed", 3), ("skipped", 1)]
    e = spark.createDataFrame([("d", "Zé", 0, 2), ("d", "Zé", 0, 2), ("d", "José", 5, 9), ("d", None, 1, 2), ("d", "x", None, 2)], "k string, text string, original_start int, original_end int")
    a = spark.createDataFrame([("Zé", "José")], "alias string, canonical string")
    p = files.gold_positions(e, "k", a).collect()
    assert [(r.name, [(s.start, s.end, s.score) for s in r.positions]) for r in p] == [("José", [(0, 2, 1.0), (5, 9, 1.0)])]


def test_malformed_pages():
    p = html.parse("<span>a</i>b</span><b>O SR. X</b> tail")
    assert [(e.tag, e.text) for e in p.elements] == [("span", "ab"), ("b", "O SR. X")]
    p = html.parse('<body><div class="a b" id="i"><p>um<br>dois<wbr>três</div>fim <td>x</body> depois')
    assert p.all("body")[0].text == "umdoistrêsfim x" and p.all(css="b a")[0].text == "umdoistrês" and p.all(ident="i")[0].tag == "div"
    assert p.all("p", css="a") == [] and [e.tag for e in p.all(inside=p.all("div")[0])] == ["p", "br", "wbr"]
    assert html.parse(None).elements == []


def test_small_functions(spark):
    df = spark.createDataFrame([("[PESSOA:[PESSOA:Ana]] e [PESSOA:]Rui[PESSOA:]", "a/b.c/x.annotated.txt", "3ª Reunião - 12ª - CPI da Água - 2020")], "t string, p string, k string")
    r = df.select(X.mend_tags(F.col("t")).alias("t"), X.base_name(F.col("p")).alias("p"), X.type_of_title(F.col("k")).alias("k"), X.type_of_title(F.lit("sem")).alias("none"), X.nfc(F.lit("e\u0301")).alias("n")).first()
    assert tuple(r) == ("[PESSOA:Ana] e [PESSOA:Rui]", "x.annotated", "CPI", None, "é")
    keys = df.select(X.name_key(F.lit("Deputada Ana  Lima (Bloco Alfa/PT - CE)")), X.name_key(F.lit("Sr. Rui Dias - PSD-MG")), X.name_key(F.lit("JOSE\u0301 SILVA PT-CE")), X.name_key(F.lit("Ana Lima PT-CE"), True), X.name_key(F.lit("Ana (Bloco Alfa/PT - CE)"), True), X.name_key(F.lit("Ana (Alfa/PT - CE)"), True), X.name_key(F.lit("x"))).first()
    assert tuple(keys) == ("ana lima", "rui dias", "jose silva", "ana lima pt-ce", "ana bloco alfa", "ana alfa", None)
    shades = X.palette(7)
    assert shades[0] == "#cc3d3d" and len(set(shades)) == 7 and all(len(c) == 7 for c in shades)


def test_directed_both_ways(spark):
    e = spark.createDataFrame([("g", "a", "b", 2), ("g", "c", "c", 1)], "graph_id string, src string, dst string, weight long")
    assert rows(graph.to_directed(e), "src") == [("g", "a", "b", 2), ("g", "b", "a", 2), ("g", "c", "c", 1)]
