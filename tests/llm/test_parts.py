"""Parts of the classifier and of sharding against plain versions; bounds of the sample; empty and odd tables."""

import hashlib
import random

import numpy as np

from gridloom.llm import classifier as c
from gridloom.llm import sharding


def test_log_ratios():
    rng = random.Random(4)
    rows = [sorted(rng.sample(range(12), rng.randrange(0, 7))) for _ in range(40)]
    y = [rng.choice([1, -1]) for _ in rows]
    got = c.log_ratios([np.array(r, np.int32) for r in rows], np.array(y), 12)
    for k in range(12):
        share = [(1 + sum(k in r for r, v in zip(rows, y, strict=True) if v == s)) / (2 + y.count(s)) for s in (1, -1)]
        assert abs(got[k] - np.log(share[0] / share[1])) < 1e-12


def test_dual_descent_reaches_the_optimum(monkeypatch):
    monkeypatch.setattr(c, "EPOCHS", 3000)
    rng = np.random.default_rng(3)
    n, size = 30, 8
    rows = [np.sort(rng.choice(size, rng.integers(1, size), replace=False)) for _ in range(n)]
    values = [rng.standard_normal(len(r)) for r in rows]
    y = np.where(rng.random(n) < 0.3, 1, -1)
    dense = np.zeros((n, size))
    for i, (r, v) in enumerate(zip(rows, values, strict=True)):
        dense[i, r] = v
    cost = np.where(y > 0, n / (2 * (y > 0).sum()), n / (2 * (y < 0).sum())) * c.COST
    # the plain version: projected gradient on the dual, in small steps
    q = (dense * y[:, None]) @ (dense * y[:, None]).T
    alpha = np.zeros(n)
    for _ in range(60_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, cost)
    best = dense.T @ (alpha * y)
    loss = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (dense @ w))).sum()
    got = c.dual_descent(rows, values, y, size)
    assert loss(got) <= loss(best) * 1.01 and np.linalg.norm(got - best) < 0.05 * np.linalg.norm(best)


def test_the_sample_is_bounded(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda good: " ".join(("fine" if good else "bad#") + str(rng.randrange(90)) for _ in range(30))
    docs = [(i, text(i % 2)) for i in range(60)] + [(1, text(1)) for _ in range(300)] + [(2, "same bad# text")] * 300
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(c, "SAMPLE", 40)
    seen = []
    fit = c.fit
    monkeypatch.setattr(c, "fit", lambda x, y: seen.append((len(x), sum(v.nbytes for v in x), len({v.tobytes() for v in x}))) or fit(x, y))
    out = c.quality_scores(frame, labels).collect()
    assert len(out) == len(docs) and seen[0][0] == 40 and seen[0][2] == 40
    monkeypatch.setattr(c, "SAMPLE_BYTES", seen[0][1] // 2)
    assert len(c.quality_scores(frame, labels).collect()) == len(docs)
    assert seen[1][1] <= c.SAMPLE_BYTES and 10 <= seen[1][0] < 40


def plain_table(names, size):
    order = []
    for name in names:
        h = hashlib.sha256(name.encode()).digest()
        at, step = int.from_bytes(h[:8], "big") % size, int.from_bytes(h[8:16], "big") % (size - 1) + 1
        order.append([(at + k * step) % size for k in range(size)])
    table = {}
    while len(table) < size:
        for i, slots in enumerate(order):
            free = next((s for s in slots if s not in table), None)
            if free is not None:
                table[free] = i
    return [table[s] for s in range(size)]


def test_sharding_tables(spark):
    for names, size in ((["a"], 7), (sharding.shard_names(3), 101), (sharding.shard_names(13), 211)):
        assert sharding.lookup_table(names, size) == plain_table(names, size)
    docs = spark.createDataFrame([(None, None, 1, "x"), (3, "t", 2, "y"), (3, "u", 2, "y")], "doc_id long, text string, slot int, shard string")
    out = sharding.placed(docs, ["a", "b"], 11)
    assert out.columns == ["doc_id", "text", "slot", "shard"] and out.where("doc_id = 3").select("slot").distinct().count() == 1
    assert sharding.placed(docs.limit(0), ["a", "b"], 11).collect() == []
