"""Token counts, decontamination, classifier, sharding, pipeline."""

import random

import numpy as np
import pytest

from gridloom.llm import classifier, decontaminate, sharding, token_count

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = ["", "a" * 4000, "ab" * 1500, " " * 900, "<|endoftext|>x<|endoftext|>", "don't  stop\n\n now", "ⁿ² ₂ ßẞ", "日本語 テスト", "x\x1c\x85 y"]
    texts += ["".join(rng.choice([chr(rng.randrange(32, 0x250)), "  ", "\n", "'ll", "<|endoftext|>", chr(rng.randrange(0x370, 0xD7FF)), chr(rng.randrange(0x1F300, 0x1FAFF))]) for _ in range(rng.randrange(50))) for _ in range(300)]
    rows = [*enumerate(texts), (None, None), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string")
    out = token_count.token_counts(docs, PATH).collect()
    library = Tokenizer.from_file(PATH)
    want = sorted((str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 1024) for i, t in rows)
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in out) == want
    assert token_count.token_counts(docs.limit(0), PATH).collect() == []


def test_long_pre_tokens(monkeypatch):
    import time

    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(PATH), random.Random(12)
    want = lambda t: len(library.encode(t, add_special_tokens=False))
    merger = token_count.Merger(PATH)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "aaab", "theranios", "=-", "é日本ßx") for n in (1, 2, 3, 50, 700)]
    texts += ["a" * n for n in range(1, 40)] + ["the" * 400]
    monkeypatch.setattr(token_count, "LONG", 0)
    assert [merger.count([t])[0] for t in texts] == [want(t) for t in texts]
    monkeypatch.undo()
    for text in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000)), "a" * 300_000, "ab" * 150_000):
        began = time.perf_counter()
        assert merger.count([text]) == [want(text)]
        assert time.perf_counter() - began < 30


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.choice([2, 3, 3, 4, 5]))) for _ in range(n))


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randrange(16, 60))) for i in range(30)] + [(90, "tiny one"), (91, None), (92, "")]
    docs, planted = [], set()
    for i in range(300):
        w = prose(rng, rng.randrange(0, 300)).split()
        if i % 5 == 0:
            item, text = items[rng.randrange(30)]
            words = text.split()
            if i % 10 == 0:  # a paraphrase: some words change, case and marks too; the answer stays
                words = [x if k > len(words) - 10 or rng.random() > 0.15 else "other" for k, x in enumerate(words)]
                words = [x.upper() + "," if rng.random() < 0.3 else x for x in words]
            at = rng.randrange(len(w) + 1)
            w[at:at] = words
            planted.add((i, item))
        docs.append((i, " ".join(w), 1))
    docs += [(None, items[3][1], 1), (700, None, 1), (701, "", 1), (702, items[4][1] + " x" * 50_000, 1), (703, "a tiny one here", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r[0], r[1]) for r in decontaminate.contaminated(frame, bench).collect()}
    want = planted | {(None, 3), (702, 4)}
    assert got - {(703, 90)} <= want
    assert len(got & want) >= 0.95 * len(want)
    assert decontaminate.contaminated(frame, bench.limit(0)).collect() == []
    assert decontaminate.contaminated(frame.limit(0), bench).collect() == []


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.common_subsequence(decontaminate.places(a), len(a), b) == table[-1, -1]


def test_classifier_held_out(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(x + (rng.choice(["###", "$$$"]) if i % 4 == 0 else "") for x in prose(rng, rng.randrange(30, 90)).split()), "en") for i in range(900)]
    docs += [(None, None, "en"), (9000, "", "en"), (1, docs[1][1], "en")]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 900, 2)] + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string")
    out = classifier.quality_scores(frame, labels).collect()
    assert len(out) == len(docs)
    import zlib

    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    test = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in test) >= 0.98 * len(test)
    none = classifier.quality_scores(frame, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert classifier.quality_scores(frame.limit(0), labels).collect() == []


def test_sharding(spark):
    names = sharding.shard_names(10)
    table = sharding.lookup_table(names)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(names[:-1])
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 0.1 * len(table)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)
    import hashlib

    rows = [(1, "a", 0), (1, "b", 0), (None, "t", 0), (None, None, 0), (4, "x" * 100_000, 0)]
    out = sharding.placed(spark.createDataFrame(rows, "doc_id long, text string, slot long"), names).collect()
    for r in out:
        key = str(r["doc_id"]) if r["doc_id"] is not None else r["text"] or ""
        slot = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, table[slot])
    assert len(out) == 5
