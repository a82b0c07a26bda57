"""Extra columns named like the operators' own, and nulls in every column."""

from pyspark.sql import functions as F

from parlaweave.llm import components, cooccurrence, garbled, leakage, lookalikes, mixing, splitting, turns, variants

NAMES = "a b t k n m doc item basket heavy pos token cand channel core word text plain is_case form near score ways fixes spans root node group_key record_key piece_no start end rate copies source key entry_id name_id people p _text n_tokens speaker_no turn_no entries words party state kind".split()


def wide(df):
    return df.withColumns({c: F.lit(None).cast("string") for c in NAMES if c not in df.columns})


def test_clashes(spark):
    df = lambda data, schema: wide(spark.createDataFrame(data, schema))
    assert components.connected_groups(df([(1, 2), (None, None)], "x long, y long"), "x", "y").count() == 2
    assert cooccurrence.pair_lift(df([(s, w) for s in range(9) for w in "uv"] + [(None, None)], "sid long, w string"), "sid", "w", 1, 1, 0.5).count() == 1
    assert splitting.split_items(df([(1, "x " * 900), (None, "y " * 900), (2, None)], "id long, body string"), "id", "body").select("id").distinct().count() == 2
    text = " ".join(f"w{i}" for i in range(30))
    docs, items = df([(1, text), (None, None)], "id long, body string"), df([(7, text), (None, text)], "iid long, body string")
    assert [tuple(r)[:3] for r in leakage.find_leaks(docs, "id", "body", items, "iid", "body").collect()] == [(1, 7, 0)]
    assert {r.is_case for r in lookalikes.plain_rows(df([(1, "Αna"), (2, None)], "id long, body string"), "body").collect()} == {True, False}
    words = "a comissão aprovou o orçamento"
    g = df([(i, words) for i in range(30)] + [(99, "a comissÃ£o aprovou"), (None, None)], "id long, body string")
    assert [r.id for r in garbled.restore(g, "id", "body").collect()] == [99]
    t, r = df([("d", "PRESIDENTE: Oi.", None), (None, None, None)], "doc_id string, text string, captured_at string"), df([("d", 1, "PRESIDENTE", "Ana Lima", None, None), (None,) * 6], "doc_id string, speaker_no int, title string, word string, party string, state string")
    assert [x.speaker_no for x in turns.speaker_turns(t, r).collect()] == [1]
    rec, reg = df([(1, "Ana Lima", None, None), (None, None, None, None)], "name_id long, word string, party string, state string"), df([(5, "pessoa", "Ana Lima", None, None, None), (6, None, None, None, None, None)], "entry_id long, kind string, canonical_name string, original_names array<string>, party string, state string")
    assert [(x.name_id, x.entry_id) for x in variants.link_names(rec, reg).collect()] == [(1, 5)]
    d, tg = df([(1, "s", 5), (None, None, None)], "id long, src string, sz long"), spark.createDataFrame([("s", 1.0, 2)], "source string, target_share double, max_repeat int")
    assert [x.copies for x in mixing.mix(d, tg, "id", "src", "sz").collect()] == [2]
