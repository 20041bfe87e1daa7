"""Benchmark items that a large share of all rows hold."""

import random

from gridloom.llm import decontaminate


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 4, 5]))) for _ in range(n))


def test_item_in_a_third_of_all_rows(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, 34)) for i in range(20)]
    docs = [(i, prose(rng, 150)) for i in range(400)]
    own = {i: f"{prose(rng, rng.randrange(60))} {items[0][1]} {prose(rng, rng.randrange(60))}" for i in range(1000, 1100)}
    copy = f"{prose(rng, 30)} {items[0][1]} {prose(rng, 40)}"
    docs += [*own.items(), *((i, copy) for i in range(2000, 2100)), (3000, f"{prose(rng, 50)} {items[1][1]}")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {(i, 0) for i, _ in docs if 1000 <= i < 3000} | {(3000, 1)}
    assert {(r[0], r[1]) for r in got.collect()} == want
