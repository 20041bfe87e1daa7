"""The pipeline's rows against plain Python, stage by stage, and its stages on odd rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F
from test_ngram_join import brute
from test_quality_risk import plain as plain_cutoffs
from test_quality_risk import value
from test_recall import plain as plain_leaks

from gridloom.llm import quality_rules, sharding

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
BLANK = "[\x20\x09-\x0d]+"


def words(text):
    return [x for x in re.split(BLANK, text or "") if x]


def statistics(doc, text, lang):
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    inside = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(5)}
    return (doc, lang or "", len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), len(lines), len(re.findall("[A-Z]", t)), t.count("!"))


def plain_quality(rows, labels, chooses):
    known = {}
    for doc, quality in labels:
        known[doc] = max(quality, known.get(doc, quality))
    stats = [statistics(*r[:3]) for r in rows]
    cut = plain_cutoffs([s for s in stats if s[0] in known], [(d, y, 0) for d, y in known.items()], chooses)
    kept = []
    for row, s in zip(rows, stats, strict=True):
        failed = s[2] < 10 or 100 * s[6] > 20 * s[2]
        for rule in quality_rules.RULES:
            below = dict(zip("n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines".split(), s[2:], strict=False)).get(quality_rules.RULES[rule][0].split(" / ")[1], 0)
            failed |= (s[1], rule) in cut and below > 0 and value(s, rule) > cut[s[1], rule]
        if not failed:
            kept.append(row)
    return kept


def plain_mix(rows):
    """Rows as often as the mix takes them."""
    size = {}
    for doc, text, _, source in rows:
        size.setdefault(source, []).append((hashlib.md5(f"mix:{doc}".encode()).hexdigest(), doc, len(words(text))))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    whole = {s: sum(n for *_, n in size[s]) for s in order}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(whole.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest, all_weights = total - sum(2 * whole[s] for s in capped), sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / all_weights > 2 * whole[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in order:
        target = int(2 * whole[s] if s in capped else rest * weight[s] / all_weights)
        times, left = divmod(target, whole[s]) if whole[s] else (0, 0)
        for _, doc, n in sorted(size[s]):
            part = min(n, max(0, left))
            left -= n
            out += [doc] * (times + (part > 0))
    return out


def test_run_equals_plain_python(spark):
    docs = corpus_pipeline.documents(spark, SF)
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] is not None]
    chooses = {r[0]: r[1] for r in docs.select("doc_id", quality_rules.chooses(F.col("doc_id"))).collect()}
    rows = plain_quality(rows, labels, chooses)
    first = {doc for doc, n, group in brute([r[:2] for r in rows]) if doc == group}
    rows = [r for r in rows if r[0] in first]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {doc for doc, _ in plain_leaks([r[:2] for r in rows], items)}
    rows = [r for r in rows if r[0] not in leaks]
    table = sharding.lookup_table(sharding.shard_names())
    slot = lambda doc: int(hashlib.md5(str(doc).encode()).hexdigest()[:8], 16) % sharding.SLOTS
    want = sorted((doc, slot(doc), table[slot(doc)]) for doc in plain_mix(rows))
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "slot", "shard"]
    assert sorted(tuple(r) for r in out.select("doc_id", "slot", "shard").collect()) == want
    assert leaks and len(first) < len(docs.collect())


SCHEMA = "doc_id long, text string, lang string, source string, n_words string, `_row` int, doc string, size string, start int, key string, `a.b` int, node long"


def odd_rows():
    text = " ".join(f"w{i} is" for i in range(40))
    rows = [(None, None), (None, text), (1, text), (1, text), (2, ""), (3, " ".join(f"v{i} the" for i in range(60_000))), (4, " ".join(f"u{i} of" for i in range(30)) + "\n"), (None, " ".join(f"t{i} to" for i in range(30)))]
    return [(i, t, None if k % 3 else "en", None if k % 2 else "s", "x", k, "d", "z", 4, "k", 5, 6) for k, (i, t) in enumerate(rows)]


def test_stages_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, "some item of the benchmark that nobody has written down before")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns, name
        kept[name] = sorted(((r["doc_id"], (r["text"] or "")[:2]) for r in out.collect()), key=str)
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name
    assert kept["quality rules"] == sorted([(1, "w0"), (1, "w0"), (None, "w0"), (3, "v0"), (4, "u0"), (None, "t0")], key=str)
    assert kept["n-gram Jaccard join"] == sorted([(None, ""), (1, "w0"), (2, ""), (3, "v0"), (4, "u0"), (None, "t0")], key=str)
    assert len(kept["benchmark decontamination"]) == 8 and len(kept["sharding"]) == 8
    # two sources: of weight 5, capped at twice its words, and the null one of weight 2, with under one epoch
    mixed = kept["mixing sources to target weights"]
    assert mixed.count((2, "")) == 2 and mixed.count((4, "u0")) == 2 and mixed.count((None, "")) == 2 and (3, "v0") in mixed
