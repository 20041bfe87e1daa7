import random

from gridloom.llm import ngram_join as nj


def brute(rows):
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def result(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, nj.ngram_jaccard_join(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocab) for _ in range(60)]
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.5:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0, 2) or ["x"]
            texts.append(" ".join(w) or "x")
        else:
            w = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 7, 9, 12, 20, 60, 150, 400]))]
            if rng.random() < 0.4:
                w[len(w) // 2 : len(w) // 2] = shared
            texts.append(" ".join(w))
    return list(enumerate(texts))


def test_against_brute_force(spark):
    rows = corpus(1, 260) + [(None, "a b c d e f"), (None, "a b c d e f"), (900, None), (901, ""), (902, " \n"), (903, "A b  c\td e f"), (7, "same id other text here now")]
    assert result(spark, rows) == brute(rows)


def test_widespread_keys(spark, monkeypatch):
    monkeypatch.setattr(nj, "STAR", 2)
    rows = corpus(2, 160)
    assert result(spark, rows) == brute(rows)


def test_empty(spark):
    assert result(spark, []) == []


def test_bands_hold_partners():
    for n in range(1, 3000):
        import numpy as np

        a, b = nj.band(np.array([n])), nj.band(np.array([n * 100 // 75]))
        assert b[0] - a[0] <= 1
