"""Decontamination against a plain check of every passage with every item: nothing else is found, and little is missed."""

import random
import re

from gridloom.llm import decontaminate as dc


def words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def plain(docs, items):
    out = set()
    for doc, text in docs:
        w = words(text)
        for item, told in items:
            q = words(told)
            n = len(q)
            if not n or len(set(q) & set(w)) < 0.5 * len(set(q)):
                continue
            for p in range(0, len(w), dc.STEP):
                around = w[max(0, p - n) : p + 2 * dc.STEP + n]
                if n < dc.MIN_WORDS:
                    found = any(around[i : i + n] == q for i in range(len(around)))
                else:
                    both = common(q, around)
                    found = both >= dc.NEAR * n or both >= dc.PARAPHRASE * n and common(q[-dc.ANSWER_WORDS :], around) >= dc.ANSWER * len(q[-dc.ANSWER_WORDS :])
                if found:
                    out.add((doc, item))
                    break
    return out


def corpus(seed):
    rng = random.Random(seed)
    rare = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 4, 5]))) for _ in range(3000)]
    usual = rare[:60]
    prose = lambda n, of=rare: [rng.choice(usual) if rng.random() < 0.5 else rng.choice(of) for _ in range(n)]
    # items of ordinary and of common words only, short ones, and two that are equal
    items = [(i, prose(rng.randrange(12, 60), usual if i % 5 == 0 else rare)) for i in range(40)]
    items += [(100, prose(4)), (101, items[3][1]), (102, prose(9)), (103, prose(150))]
    docs = []
    for i in range(400):
        w = prose(rng.randrange(0, 120))
        if i % 2:
            told = list(rng.choice(items)[1])
            if i % 6 == 3:  # near: a word in eight is another, or gone
                told = [x for x in (rng.choice(rare) if rng.random() < 0.08 else x for x in told) if rng.random() > 0.05]
            elif i % 6 == 5:  # paraphrased: a third of the words, not those of the answer
                told = [rng.choice(rare) if k < len(told) - 8 and rng.random() < 0.33 else x for k, x in enumerate(told)]
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.title() for x in told]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(900, None), (901, ""), (902, " ".join([*prose(30_000), *items[1][1], *prose(30_000)]))]
    return docs, [(i, " ".join(q)) for i, q in items] + [(200, None), (201, " ,")]


def test_recall_and_precision(spark):
    want, got = set(), set()
    for seed in (1, 2):
        docs, items = corpus(seed)
        want |= {(seed, *x) for x in plain([d for d in docs if d[0] != 902], items)} | {(seed, 902, 1)}
        found = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        got |= {(seed, r[0], r[1]) for r in found if r[0] != 902} | {(seed, 902, r[1]) for r in found if r[0] == 902 and r[1] == 1}
    assert got <= want
    assert len(got) >= 0.97 * len(want), sorted(want - got)
    assert len(want) > 300 and all((s, 902, 1) in got for s in (1, 2))


def test_blocks_of_items(spark, monkeypatch):
    docs, items = corpus(3)
    docs = docs[:150]
    want = plain(docs, items)
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 7)
    found = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r[0], r[1]) for r in found}
    assert got <= want and len(got) >= 0.97 * len(want) and len(found) == len(got)
