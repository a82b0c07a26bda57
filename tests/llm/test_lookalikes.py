import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from parlaweave.llm import lookalikes as L


def plain(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "w string")
    return {r.w: r.plain for r in L.plain_texts(df, "w").collect()}


def test_forms(spark):
    pairs = {
        "Ｆ． MЕNFUΜAR": "F. MENFUMAR", "Ib​iguaсema\xad": "Ibiguacema", "Vicente\xa0Lima": "Vicente Lima", "José": "José", "1ª Secretária": "1ª Secretária",
        "PNC‑PA": "PNC-PA", "Лев Щудрин": "Лев Щудрин", "Αna": "Ana", "": "", "ậ": "ậ", "ậ": "ậ", "x̣́": "x̣́", "ﬁm": "fim", "Ç̃": "Ç̃",
    }
    got = plain(spark, *pairs)
    assert got == pairs
    for v in got.values():
        assert unicodedata.normalize("NFC", v) == v


def test_rows(spark):
    df = spark.createDataFrame([(1, "Αna", "a"), (2, None, "b"), (3, "Лев Щудрин", "c"), (4, "Ana", "d"), (1, "Αna", "a")], "row_id long, text string, plain_ string")
    got = sorted((r.row_id, r.is_case) for r in L.plain_rows(df, "text").collect())
    assert got == [(1, True), (1, True), (2, False), (3, False), (4, False)]
    assert L.plain_rows(df.limit(0), "text").count() == 0


def test_long_text(spark):
    t = "é​" * 20_000
    assert plain(spark, t)[t] == "é" * 20_000


@settings(max_examples=200, deadline=None)
@given(st.characters(codec="utf-8"))
def test_table_is_idempotent(c):
    p = L.plain_pieces(c)
    if p is not None:
        for side in p:
            assert all(L.plain_pieces(x) is None or unicodedata.combining(x) or L.plain_pieces(x)[0] == x for x in side)


MARKS = "".join(chr(o) for o in range(0x300, 0x370) if o not in L._INVISIBLE)


def test_composition_is_canonical(spark):
    """Letters with any marks in any order come out as in NFC, whole syllables and joining letters too."""
    rng = random.Random(8)
    texts = {"".join(rng.choice("aeoysAçñ") + "".join(rng.choice(MARKS) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 5))) for _ in range(1500)}
    texts |= {"ậ́", "ǭ́", "ậ́", "\u0301a\u0301", "\u0323\u0301"}
    texts |= {unicodedata.normalize("NFD", chr(o)) for o in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
    texts |= {unicodedata.normalize("NFD", "한국어 각"), "가\u11a8", "\u1100\u0301\u1161", "a\u1161\u0301", "क़", "ক\u09c7\u09be"}
    texts = {t for t in texts if "ſ" not in t and all(len(unicodedata.normalize("NFKD", c)) == len(unicodedata.normalize("NFD", c)) for c in t)}
    got = plain(spark, *sorted(texts))
    skip = set("ıȷĸŉſ")
    bad = {t: (got[t], unicodedata.normalize("NFC", t)) for t in texts if not skip & set(t) and got[t] != unicodedata.normalize("NFC", t)}
    assert not bad


def test_more_scripts_and_a_table_of_ones_own(spark):
    assert plain(spark, "\u200b", "\u200b\ufeff") == {"\u200b": "", "\u200b\ufeff": ""}
    df = spark.createDataFrame([("ꓡima",), ("Ⲧeixeira",), ("ꓡꓲ",), ("Ana ∅",)], "w string")
    assert {r.w: r.plain for r in L.plain_texts(df, "w").collect()} == {"ꓡima": "Lima", "Ⲧeixeira": "Teixeira", "ꓡꓲ": "LI", "Ana ∅": "Ana ∅"}
    assert {r.w: r.plain for r in L.plain_texts(df, "w", {"∅": "O"}).collect()}["Ana ∅"] == "Ana O"


def test_a_hot_text(spark):
    df = spark.range(4000).selectExpr("id", "if(id % 3 = 0, 'Αna', concat('b', id, chr(769))) as text", "'x' as key", "'y' as t")
    out = L.plain_rows(df, "text")
    assert out.count() == 4000 and out.where("text = 'Αna' and plain = 'Ana' and is_case and key = 'x' and t = 'y'").count() == 1334
