from pyspark.sql import functions as F

from parlaweave.functions import text as X
from parlaweave.functions.similarity import token_set_score
from parlaweave.operators import text as T

from conftest import rows


def test_chunks(spark):
    d = spark.createDataFrame([(n, "x" * n) for n in (0, 1, 1000, 1001, 1800, 1801)] + [(-1, None)], "k long, t string")
    got = {k: [(a, b) for _, a, b in v] for k, v in _by(T.chunk_windows(d, "k", "t")).items()}
    assert got == {1: [(0, 1)], 1000: [(0, 1000)], 1001: [(0, 1000), (800, 1001)], 1800: [(0, 1000), (800, 1800)], 1801: [(0, 1000), (800, 1800), (1600, 1801)]}


def _by(df):
    out = {}
    for k, c, a, b, _ in rows(df, "k", "chunk"):
        out.setdefault(k, []).append((c, a, b))
    return out


def test_speeches(spark):
    d = spark.createDataFrame([(1, "intro O SR. PRESIDENTE fala. A SRA. ANA LIMA responde."), (2, "cito o sr. silva aqui"), (3, "x <PESSOA:X>O SR. PRESIDENTE (A)</PESSOA> fala"), (4, " \n "), (5, None)], "k long, t string")
    got = [(k, s) for k, _, s in rows(T.split_speeches(d, "k", "t"), "k", "speech_no")]
    assert got == [(1, "intro"), (1, "O SR. PRESIDENTE fala."), (1, "A SRA. ANA LIMA responde."), (2, "cito"), (2, "o sr. silva aqui"), (3, "x"), (3, "<PESSOA:X>O SR. PRESIDENTE (A)</PESSOA> fala")]
    faithful = [s for k, _, s in rows(T.split_speeches(d, "k", "t", faithful=True), "k", "speech_no") if k == 3]
    assert faithful == ["x <PESSOA:X>", "O SR. PRESIDENTE (A)</PESSOA> fala"]


def test_tags(spark):
    d = spark.createDataFrame([(1, "Ana Rui"), (2, None), (3, "nada")], "k long, t string")
    s = spark.createDataFrame([(1, "X", 0, 3), (1, "Y", 4, 7), (1, "Z", 5, 99), (1, "W", 3, 3)], "k long, name string, start int, end int")
    got = dict(rows(T.insert_tags(d, s, "k", "t"), "k"))
    assert got == {1: "<PESSOA:X>Ana</PESSOA> <PESSOA:Y>Rui</PESSOA>", 2: None, 3: "nada"}
    touching = spark.createDataFrame([(1, "X", 0, 3), (1, "Y", 3, 7)], s.schema)
    assert dict(rows(T.insert_tags(d, touching, "k", "t"), "k"))[1] == "<PESSOA:X>Ana</PESSOA><PESSOA:Y> Rui</PESSOA>"
    g = spark.createDataFrame([(1, "a <Ana> b <Rui>"), (2, "1 < 2"), (3, None)], "k long, t string")
    assert rows(T.extract_tags(g, "k", "t"), "k", "tag_no") == [(1, 0, "Ana", 2, 5), (1, 1, "Rui", 8, 11)]


def test_fields(spark):
    d = spark.createDataFrame([("54ª Sessão - CPI - Em 2 de março de 2024", "Dep. José Lima (PT - CE)", "JOÃO"), (None, "A", "João"), ("x", "Ana PT-CE", "12")], "t string, n string, u string")
    r = d.select(X.year_of(F.col("t")), X.date_phrase(F.col("t")), X.phrase_date(F.lit("2 de março de 2024")).cast("string"), X.ordinal_type(F.col("t")), X.type_of_title(F.lit("- 3ª - CPI x")), X.is_upper(F.col("u"))).collect()
    assert tuple(r[0]) == (2024, "2 de março de 2024", "2024-03-02", "CPI", "CPI", True)
    assert tuple(r[1]) == (None, None, "2024-03-02", None, "CPI", False)
    keys = [x[0] for x in d.select(X.name_key(F.col("n"))).collect()]
    assert keys == ["dep jose lima", None, "ana"]
    assert d.select(X.name_key(F.col("n"), faithful=True)).collect()[2][0] == "ana pt-ce"


def test_similarity():
    assert token_set_score("arthur", "arthur lira pp-al") == 100
    assert token_set_score("joao silva", "joao souza") == 70
    assert token_set_score("ana pt-ce", "jose silva pt-ce") == 71
    assert token_set_score("", "a") == token_set_score(None, "a") == 0
