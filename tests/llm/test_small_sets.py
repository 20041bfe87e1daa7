"""Sets of 3 shingles within sets of 4: Jaccard 3/4."""

import random

from test_ngram_join import brute, result

from gridloom.llm import ngram_join as nj


def rows():
    rng = random.Random(9)
    texts = ["a b c d e f g", "a b c d e f g h", "z a b c d e f g", "k l m n o p", "k l m n o p q"]
    for _ in range(60):
        w = [f"w{rng.randrange(200)}" for _ in range(7)]
        texts += [" ".join(w), " ".join([*w, "after"]), " ".join(["before", *w])][: rng.randrange(1, 4)]
    texts += ["r s r s r s r s t", "r s r s r s r s t u", " ".join(["r s"] * 20) + " t"]
    return list(enumerate(texts))


def test_three_within_four(spark):
    assert result(spark, rows()) == brute(rows())


def test_three_within_four_with_widespread_keys(spark, monkeypatch):
    monkeypatch.setattr(nj, "STAR", 2)
    assert result(spark, rows()) == brute(rows())
