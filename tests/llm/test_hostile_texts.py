"""Very long texts of awkward shapes take time in proportion to their length."""

import time

import pytest

from parlaweave.llm import splitting, turns, variants


@pytest.mark.parametrize("name", ["Ana" + " " * 20_000 + "Lima", "a" * 200_000, "ana lima " * 5000, "ANA " * 20_000 + "(", "A." * 20_000, "Dep. " * 5000])
def test_names(name):
    index, began = [variants.Index([(1, "pessoa", "Ana Clara Lima", None, None, None)])], time.time()
    assert variants.link_forms([(name, None, None)], lambda: index, {}) == [1 if name.startswith("Ana ") else None]
    assert time.time() - began < 10


@pytest.mark.parametrize("text", ["ANA LIMA " * 20_000, "O SR. ANA (" * 5000, ("Ana " * 3000 + ": ") * 3, "*a " * 30_000, "O SR. ANA " * 10_000, "\n" * 100_000, " " * 50_000 + "x"])
def test_transcripts(text):
    began = time.time()
    assert turns.turns_of(text, []) == []
    assert time.time() - began < 10


@pytest.mark.parametrize("text", ["\n" * 100_000, (" " * 500 + "\n") * 300, "<p>" * 30_000, "ABC DEF\n" * 20_000, "a. " * 40_000])
def test_items(text):
    began = time.time()
    assert splitting.split_text(text)[-1][1] == len(text)
    assert time.time() - began < 10
