from parlaweave.plans import registry
from parlaweave.plans import relations as R
from parlaweave.sources import html


def test_whole_pages(spark, tmp_path):
    texts = {"camara/2020/1": "a < b & c " * 200 + "fim", "camara/2020/2": "curto", "camara/2020/3": " \n" + "x" * 5000 + "\n"}
    rows = [(k, "camara", 2020, "t", None, None, t, None) for k, t in [*texts.items(), ("camara/2020/4", None), ("camara/2020/1", texts["camara/2020/1"])]]
    spark.createDataFrame(rows, "doc_id string, fonte string, ano int, titulo string, data_str string, tipo string, text string, captured_at string").write.parquet(str(tmp_path / "transcript.parquet"))
    got = {r.doc_id: r.text for r in registry.queries()["html_bold_speakers"](spark, str(tmp_path)).collect()}
    assert got == {k: "\n" + t.strip(" \t\n\r") for k, t in texts.items()}
    body = {r.doc_id: r.spans for r in html.page_fields(R.pages(spark, str(tmp_path)), "doc_id", "html", speech="fala").collect()}
    assert body == {k: [t.strip(" \t\n\r")] for k, t in texts.items()}
