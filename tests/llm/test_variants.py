from hypothesis import given, settings
from hypothesis import strategies as st

from parlaweave.llm import names as N
from parlaweave.llm import variants as V

ENTRIES = [
    (1, "pessoa", "João Quemerães Xalhalanda", ["JOAO QUEMERAES XALHALANDA"], "AB", "CE"),
    (2, "pessoa", "Joana Quemerães Xalhalanda", [], "CD", "SP"),
    (3, "pessoa", "Francisco de Vesqueval Neto", None, "AB", None),
    (4, "organizacao", "Conselho Nacional dos Moradores de Lã", ["CNML"], None, None),
    (5, "organizacao", "Cooperativa Interestadual dos Técnicos de Navegação Interior", ["CITNI"], None, None),
]
RECORDS = [
    (1, "João Quemerães Xalhalanda", None, None), (2, "XALHALANDA, JOAO Q.", None, "CE"), (3, "Dep. Xalhalanda, João (AB/CE)", None, None), (4, "Joao QuemeraesXalhalanda", None, None),
    (5, "J. Xalhalanda", None, None), (6, "J. Xalhalanda", "CD", "SP"), (7, "Chico Vesqeuval", None, None), (8, "Chico Vesque val Neto", None, None), (9, "C.N.M.L.", None, None), (10, "Cons. Nac. dos Morad. de La", None, None),
    (11, "Coop. Int. dos Tecn. de Navegação Interior", None, None), (12, "Pedro Xalhalanda", None, None), (13, "João Quemerães Xalhalanda", None, "SP"), (14, "?", None, None), (15, None, None, None), (16, "", None, None),
    (17, "Moradores de Lã, Conselho Nacional dos", None, None), (18, "Paulo Fulano", None, None), (19, "João Quemerães Xalhalanda", None, None),
]


def test_links(spark):
    e = spark.createDataFrame(ENTRIES, "entry_id long, kind string, canonical_name string, original_names array<string>, party string, state string")
    r = spark.createDataFrame(RECORDS, "name_id long, word string, party string, state string").withColumnRenamed("x", "entry_id")
    got = {x.name_id: x.entry_id for x in V.link_names(r, e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 6: 2, 7: 3, 8: 3, 9: 4, 10: 4, 11: 5, 17: 4, 19: 1}
    assert V.link_names(r.limit(0), e).count() == 0 and V.link_names(r, e.limit(0)).count() == 0


def test_trie_against_brute_force():
    words = [w for _, _, n, *_ in ENTRIES for w in V._words(n)] + ["abc", "abcd", "acbd", "xabcd", "z" * 70]
    trie = V.Trie(words)
    asked = [*words, "abdc", "conselo", "moradroes", "xalhlanda", "z", "", "z" * 69 + "y", "ação"]
    for k in (0, 1, 2):
        want = {(q, w, d) for q in asked for w in words if (d := N.distance(q, w, k)) <= k}
        assert {(q, w, d) for q in asked for w, d in trie.near(q, k)} == want
        assert set(trie.near_many(sorted({q for q in asked if len(q) <= V._WIDE}), k)) == {x for x in want if len(x[0]) <= V._WIDE}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", max_size=7), min_size=1, max_size=12), st.lists(st.text("abcd", max_size=7), min_size=1, max_size=6, unique=True), st.integers(0, 2))
def test_automaton(known, typed, k):
    got = set(V.Trie(known).near_many(typed, k))
    assert got == {(q, w, d) for q in typed for w in set(known) if (d := N.distance(q, w, k)) <= k}


FIRST = ["Maria", "Mario", "José", "Sebastião", "Francisca", "Joana", "João"]
LAST = ["Souza", "Souta", "Lima", "Limo", "Campos", "Abc", "Norvilhadura", "Almegueira", "Xalhalanda", "Neto"]
TYPED = ["Maria Souta Limo", "Maria Souza Lma", "Zeca Limo Campos", "Chica Almegueira", "Tião Norvilha dura", "Souza, Maria L.", "M. Lima", "Lima", "Zé", "Joao SoutaLima", "Joã Cam pos Abc", "A. B. C."]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(FIRST), st.lists(st.sampled_from(LAST), min_size=0, max_size=3), st.sampled_from([None, "CE", "SP"])), min_size=1, max_size=14), st.integers(1, 5))
def test_candidates_and_blocks_lose_nothing(people, size):
    rows = [(i, "pessoa", " ".join([a, *b]), None, None, state) for i, (a, b, state) in enumerate(people)]
    forms = [(w, None, state) for w in TYPED + [r[2] for r in rows] for state in (None, "CE")]
    one = [V.Index(rows)]
    got = V.link_forms(forms, lambda: one, {})
    every = V.Index(rows)
    every.candidates = lambda variant: set(range(len(every.entries))) if any(w["kind"] != "initial" for w in variant) else set()
    assert got == V.link_forms(forms, lambda: [every], {})
    cut = [V.Index(rows[k : k + size]) for k in range(0, len(rows), size)]
    assert got == V.link_forms(forms, lambda: cut, {})


def test_two_typos_that_are_register_words(spark):
    e = spark.createDataFrame([(i, "pessoa", n, None, None, None) for i, n in enumerate(["Maria Souza Lima", "Mario Souta Campos", "Souta Limo Abc"])], "entry_id long, kind string, canonical_name string, original_names array<string>, party string, state string")
    r = spark.createDataFrame([(1, "Maria Souta Limo", None, None), (2, "Maria Souza Lma", None, None)], "name_id long, word string, party string, state string")
    for size in (1, 20_000):
        assert {x.name_id: x.entry_id for x in V.link_names(r, e, size).collect()} == {1: 0, 2: 0}


def test_listed_spellings(spark):
    e = spark.createDataFrame([(1, "pessoa", "Ana Clara Lima", ["Ana Lima"], None, None), (2, "pessoa", "Ana Bela Lima", ["Bela Tavares"], None, None)], "entry_id long, kind string, canonical_name string, original_names array<string>, party string, state string")
    r = spark.createDataFrame([(1, "ana lima", None, None), (2, "Bela Tavares", None, None)], "name_id long, word string, party string, state string")
    assert {x.name_id: x.entry_id for x in V.link_names(r, e).collect()} == {1: 1, 2: 2}


def test_nicknames():
    assert all(N.same_given(a, b) for a, b in (("chico", "francisco"), ("pedrinho", "pedro"), ("nanda", "fernanda"), ("gabi", "gabriela"), ("tati", "tatiana"), ("rogerinho", "rogerio")))
    assert not any(N.same_given(a, b) for a, b in (("ana", "joana bela"), ("celia", "zelia"), ("jo", "joao")))
