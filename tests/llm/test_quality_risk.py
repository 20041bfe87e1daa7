"""The cutoffs of the quality rules: against a plain version, and the risk that they keep on a simulated corpus."""

import math
import random

from pyspark.sql import functions as F

from gridloom.llm import quality_rules as q

SCHEMA = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_exclamations long"
RATES = {"a": 0.002, "b": 0.01, "c": 0.03, "d": 0.1, "e": 0.0}


def simulated(seed, n=1500):
    """Good documents that symbols reject at a stratum's rate, and capitals at half of it; bad ones have many of both."""
    rng, rows, labels = random.Random(seed), [], []
    for s, (stratum, rate) in enumerate(RATES.items()):
        for i in range(60 if stratum == "e" else n):
            bad = i % 6 == 0
            symbols = 45 if bad and rng.random() < 0.9 or rng.random() < rate else rng.randrange(8)
            capitals = 300 if bad and rng.random() < 0.5 or rng.random() < rate / 2 else rng.randrange(60)
            rows.append((s * 100_000 + i, stratum, 100, 500, symbols, 0, 0, 5, capitals, 1))
            labels.append((s * 100_000 + i, int(not bad), 0))
    return rows, labels


def value(row, rule):
    names = SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    above, below = q.RULES[rule][0].split(" / ")
    at = dict(zip(names, row, strict=True))
    return (-1 if above[0] == "-" else 1) * at[above.lstrip("-")] / at[below]


def plain(rows, labels, chooses):
    label = {d: y for d, y, _ in labels}
    out = {}
    for stratum in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == stratum]
        a, b = [r for r in own if chooses[r[0]]], [r for r in own if not chooses[r[0]] and label[r[0]] == 1]
        good, bad = [r for r in a if label[r[0]]], [r for r in a if not label[r[0]]]
        best = []
        for rule, (_, grid) in q.RULES.items():
            gains = [(sum(value(r, rule) > c for r in bad) / max(1, len(bad)) - q.GOOD_COST * (sum(value(r, rule) > c for r in good) / max(1, len(good))), c) for c in grid]
            if max(gains)[0] >= q.MIN_GAIN:
                best.append((-max(gains)[0], rule, max(gains)[1]))
        best.sort()
        on = 0
        for j in range(1, len(best) + 1):
            k = sum(any(value(r, rule) > c for _, rule, c in best[:j]) for r in b)
            tail = sum(math.comb(len(b), i) * q.RISK**i * (1 - q.RISK) ** (len(b) - i) for i in range(k + 1))
            if tail <= q.LEVEL / (len(q.RULES) * len(RATES)):
                on = j
        out |= {(stratum, rule): c for _, rule, c in best[:on]}
    return out


def test_cutoffs_equal_a_plain_version_and_keep_the_risk(spark):
    rows, labels = simulated(3)
    stats = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    chosen = q.cutoffs(stats, known)
    got = {(r["stratum"], r["rule"]): r["cutoff"] for r in chosen.collect()}
    chooses = {r[0]: r[1] for r in stats.select("doc_id", q.chooses(F.col("doc_id"))).collect()}
    assert got == plain(rows, labels, chooses)
    # the stratum of few labels, and those of which good documents look bad, prove nothing
    assert {s for s, _ in got} == {"a", "b"} or {s for s, _ in got} == {"a"}
    # good documents of the same make, not seen before: the whole verdict rejects at most RISK of any stratum
    fresh, labels = simulated(4, 6000)
    verdict = {r["doc_id"]: r["kept"] for r in q.judged(spark.createDataFrame(fresh, SCHEMA), chosen).collect()}
    for s, stratum in enumerate(RATES):
        good = [d for d, y, _ in labels if y and d // 100_000 == s]
        assert sum(not verdict[d] for d in good) <= q.RISK * len(good), stratum


def test_kept_documents_equal_the_verdicts(spark):
    good = [(i, f"the quick brown fox jumps over one lazy dog and then sleeps {i}") for i in range(900)]
    bad = [(2000 + i, f"the*** quick### brown$$$ fox&&& jumps over%%% one*** lazy### dog$$$ and {i}") for i in range(80)]
    rows = [*good, *bad, (None, good[0][1]), (None, None), (7, bad[0][1]), (9000, "")]
    docs = spark.createDataFrame([(i, t, "en", "x") for i, t in rows], "doc_id long, text string, lang string, n_words string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int")
    out = q.kept_documents(docs, labels)
    assert out.columns == docs.columns
    got = sorted(((r[0], r[1]) for r in out.collect()), key=str)
    assert got == sorted([*good, (None, good[0][1])], key=str)
    assert q.kept_documents(docs.limit(0), labels).collect() == [] and q.kept_documents(docs, labels.limit(0)).count() == len(rows) - 2
