from parlaweave.llm import variants as V

ENTRIES = [(1, "pessoa", "Patrícia Augusta Norvilhadura Almegueira", None, None, None), (2, "pessoa", "Inácio Augusto Bratudão", None, None, None), (3, "pessoa", "Marcos Luz Tavorelli", None, None, None), (4, "pessoa", "Marcos Luiz Tavorelli", None, None, None)]
RECORDS = [(1, "Patrícia Augusto Norvilhadura Almmegueira", None, None), (2, "Inácio Augusta Bratudão", None, None), (3, "Marcos Luz Tavorelli", None, None), (4, "Marcos Luiz Tavorelli", None, None), (5, "Patrícia Marcos Almegueira", None, None)]


def test_a_typo_may_be_another_register_word(spark):
    e = spark.createDataFrame(ENTRIES, "entry_id long, kind string, canonical_name string, original_names array<string>, party string, state string")
    r = spark.createDataFrame(RECORDS, "name_id long, word string, party string, state string")
    assert {x.name_id: x.entry_id for x in V.link_names(r, e).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
