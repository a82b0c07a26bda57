from hypothesis import given, settings
from hypothesis import strategies as st

from parlaweave.llm import turns as T
from parlaweave.llm.names import distance

ROSTER = [
    {"speaker_no": 1, "title": "PRESIDENTE", "word": "Ademar Silva Flovares", "party": "AB", "state": "CE"},
    {"speaker_no": 2, "title": "DEPUTADA", "word": "MARIA DA LUZ TORRES", "party": "CD", "state": "SP"},
    {"speaker_no": 3, "title": None, "word": "Joaquim Torres Neto", "party": None, "state": None},
]


def numbers(text, roster=ROSTER):
    return [(n, s) for _, n, s in T.turns_of(text, roster)]


def test_styles():
    text = (
        "Notas sem revisão\n[10:00:01] - O SR. PRESIDENTE (Ademar Flovares. AB - CE) - Boa tarde, ahn, a todos. Concordo com Maria Torres (CD - SP) nisso.\n"
        "Presidente: Sigo.\nDep. M. Tores: (Pausa.) Peço a palavra.\nPergunta: e a renda?\nEm síntese: nada.\nQuincas Torres: Hum-hum.\n"
        "O Sr. Presidente da associação enviou ofício à Mesa. A SRA. MARIA TORRES (CD - SP) - Concluo. ORADOR sem nome\nORADOR NÃO IDENTIFICADO: Apoiado!\n(Não identificado) - Muito bem!\nSR. QUINCAS TORRES NETO – Obrigado."
    )
    got = numbers(text)
    assert [n for n, _ in got] == [1, 2, 3, 2, 0, 3]
    assert got[0][1].startswith("Boa tarde, a todos.") and got[0][1].endswith("Sigo.")
    assert "Pergunta: e a renda?" in got[1][1] and got[2][1] == "O Sr. Presidente da associação enviou ofício à Mesa." and got[3][1] == "Concluo. ORADOR sem nome"


def test_relatives_and_empty():
    assert numbers("SR. TORRES: Oi.\nDEPUTADA TORRES (CD/SP): Olá.")[-1][0] == 2
    assert numbers(None) == numbers("") == numbers(" \n") == numbers("sem rótulo algum") == []
    assert numbers("PRESIDENTE: [risos]\n(Pausa.)") == []
    assert numbers("SR. FULANO BELTRANO: Oi.", []) == [(0, "Oi.")]


def test_long_text_is_quick():
    import time

    began = time.time()
    T.turns_of("A" * 200_000 + " a b " * 100_000 + "\nO SR. PRESIDENTE - Fim.", ROSTER)
    assert time.time() - began < 20


def test_frames(spark):
    t = spark.createDataFrame([("d", "PRESIDENTE: Oi.", "2024-01-02", 1), ("d", "PRESIDENTE: Oi.", "2024-01-01", 1), ("e", None, "2024-01-01", 1), ("f", "SR. X Y: Oi.", None, 1), (None, "SR. X Y: Oi.", None, 1)], "doc_id string, text string, captured_at string, speaker_no int")
    r = spark.createDataFrame([("d", 4, "PRESIDENTE", "Ana Lima", None, None), ("d", 4, "PRESIDENTE", "Ana Lima", None, None), ("d", None, None, None, None, None)], "doc_id string, speaker_no int, title string, word string, party string, state string")
    got = {(x.doc_id, x.turn_no, x.speaker_no) for x in T.speaker_turns(t, r).collect()}
    assert got == {("d", 1, 4), ("f", 1, 0), (None, 1, 0)}
    assert T.speaker_turns(t.limit(0), r).count() == 0 and T.speaker_turns(t, r.limit(0)).count() == 3


def test_labels_of_any_length():
    bloc = "Bloco " + "Progressista Parlamentar " * 12
    assert numbers(f"A SRA. MARIA TORRES (CD - SP) - Oi.\nO SR. PRESIDENTE (Ademar Flovares. {bloc}/AB - CE) - Boa tarde.") == [(2, "Oi."), (1, "Boa tarde.")]
    many = " ".join(["MARIA DA LUZ"] * 20)
    assert numbers(f"PRESIDENTE: Oi.\nDEPUTADA {many} TORRES: Sim.")[1][1] == "Sim."
    assert numbers("PRESIDENTE: Oi " + "*" + "vozes ao fundo e risos na galeria " * 5 + "* tudo bem.") == [(1, "Oi tudo bem.")]


@settings(max_examples=300, deadline=None)
@given(st.text("abcã", max_size=9), st.text("abcã", max_size=9), st.integers(0, 4))
def test_distance(a, b, most):
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y), before[j - 2] + 1 if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y else 99))
        before, last = last, row
    assert distance(a, b, most) == min(last[-1], most + 1)
