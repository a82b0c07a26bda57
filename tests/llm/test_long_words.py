import re

from hypothesis import given, settings
from hypothesis import strategies as st

from parlaweave.llm import splitting


def _sound(text, limit, overlap):
    before = 0
    for a, b, shared, kind in (pieces := splitting.split_text(text, limit, overlap)):
        assert 0 < b - a <= limit and a + shared == before and 0 <= shared <= overlap
        before = b
    assert before == len(text)
    return pieces


def _long(text, limit):
    return [m.start() for m in re.finditer(r"[^ \t\n\r]+", text) if len(m.group()) > limit]


def test_words_that_fit_stay_whole():
    para = "Uma frase curta aqui. Outra frase, com vírgula; e mais. "
    for n in (799, 800, 801, 950, 1000):
        for after in (" ", "\n", " " * 300, "\n\n\xa0"):
            text = para * 9 + "y" * n + after + para * 9
            pieces = _sound(text, 1000, 200)
            assert {p[3] for p in pieces} == {"natural"} and any("y" * n in text[a:b] for a, b, _, _ in pieces), (n, after)
    text = para * 9 + "y" * 1001 + " " + para * 9
    assert "hard" in {p[3] for p in _sound(text, 1000, 200)}


@settings(max_examples=300, deadline=None)
@given(st.text("aaaaaaaab .\n,\t\xa0", max_size=200), st.integers(5, 30), st.integers(0, 4))
def test_hard_only_above_the_limit(text, limit, overlap):
    if text:
        pieces = _sound(text, limit, overlap)
        if not _long(text, limit):
            assert {p[3] for p in pieces} == {"natural"}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["aaaaaaaaaaaa", "bb", " ", "\n", "\n\n", "# T\n", "\n## U ", "- x", "\n  - y", "<p>", " <h2>z", "\nCAPITAIS\n", ". ", ", ", "\t", "\xa0"]), max_size=40), st.integers(5, 30), st.integers(0, 4))
def test_uncut_nodes_are_the_long_words(parts, limit, overlap):
    text, uncut = "".join(parts), []
    if len(text) > limit:
        before = 0
        for a, b, shared, _ in splitting.split_text(text, limit, overlap, uncut):
            assert 0 < b - a <= limit and a + shared == before and 0 <= shared <= overlap
            before = b
        assert before == len(text) and uncut == _long(text, limit)


def test_structure_decides_the_cuts():
    body = "Texto corrido sem título nenhum. " * 6
    for mark in ("## {}\n", "<h2>{}</h2>\n", "TÍTULO EM CAPITAIS\n"):
        text = "\n".join(mark.format(i) + body for i in range(12))
        starts = [a + shared for a, _, shared, _ in splitting.split_text(text, 1000, 200)]
        assert all(text.startswith(mark.split("{")[0][:3], a) for a in starts), mark
    nested = "\n".join(f"- item {i}\n" + "\n".join(f"  - parte {i}.{j} com mais algum texto para encher" for j in range(6)) for i in range(9))
    starts = [a + shared for a, _, shared, _ in splitting.split_text(nested, 1000, 200)]
    assert all(nested.startswith("- item", a) for a in starts)
