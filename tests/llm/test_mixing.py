import random
from pathlib import Path

import pytest

from parlaweave.llm import mixing


def _actual(spark, docs, targets, **more):
    d = spark.createDataFrame(docs, "k long, source string, n long")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeat int")
    m = mixing.mix(d, t, "k", "source", "n", **more).collect()
    total = sum(r.copies * r.n_tokens for r in m)
    assert all(0 <= r.copies <= cap for r in m for s, _, cap in targets if s == r.source)
    return {s: sum(r.copies * r.n_tokens for r in m if r.source == s) / total for s, *_ in targets}, total


def test_sizes_a_thousandfold_apart(spark):
    rng = random.Random(5)
    docs = [(i, "short", rng.randrange(3, 8)) for i in range(2000)] + [(i, "long", rng.randrange(3000, 7000)) for i in range(2000, 4000)]
    actual, _ = _actual(spark, docs, [("short", 0.004, 5), ("long", 0.996, 1)])
    assert abs(actual["short"] - 0.004) < 0.0001
    mixed = [(i, "a", rng.choice([1, 2, 50, 900])) for i in range(1500)] + [(i, "b", 1) for i in range(1500, 9000)] + [(i, "c", 40) for i in range(9000, 9500)]
    goal = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 2)]
    actual, total = _actual(spark, mixed, goal)
    assert all(abs(actual[s] - part) < 0.005 for s, part, _ in goal)
    less, small = _actual(spark, mixed, goal, total=total / 9)
    assert abs(small * 9 / total - 1) < 0.05 and all(abs(less[s] - part) < 0.06 for s, part, _ in goal)


def test_refusals(spark):
    h = spark.createDataFrame([("a", 10, 5)], "source string, n_tokens long, n long")
    with pytest.raises(RuntimeError):
        mixing.solve(h, {"a": (20.0, 1)}, {"a": 10.0}, steps=1, tolerance=1e-12)
    assert abs(mixing.solve(h, {"a": (20.0, 1)}, {"a": 10.0})["a"] - -0.916290) < 1e-5


@pytest.mark.skipif(not Path(mixing.VOCABULARY).exists(), reason="no vocabulary here")
def test_tokens_agree_with_the_other_library(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(mixing.VOCABULARY.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    texts = ["A comissão aprovou o orçamento.", "", None, "  x\n\n y \t", "<|endoftext|> 1234 ª º €", "é" * 300, "\U0001F600 n'est"]
    d = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k: r.n_tokens for r in mixing.count_tokens(d, "t").collect()}
    assert got == {i: len(other.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
