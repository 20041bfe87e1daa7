"""Quality classifier: naive Bayes scaled support vectors (operator 9).

Features are indicators of byte trigrams and words of the text, hashed. Each is scaled by the
log-ratio of its (smoothed) share in the two classes; a linear hinge-loss model is fitted to
the scaled, length-normalised features by dual coordinate descent; a logistic curve, fitted
on rows that the descent did not see, turns margins into probabilities.

The model is fitted on a bounded sample: of the labelled training rows of ``SAMPLE`` ids (those with
the smallest hashes), the ``SAMPLE`` rows with the smallest hashes, as far as their features take
``SAMPLE_BYTES`` at most. These come to the driver; repeated rows count once. Three in four are
fitted, the log-ratios included; the curve is fitted on the fourth. Every row is scored on its
whole text; the broadcast model is ``SIZE`` floats. Training rows are those with
crc32(doc_id) mod 5 not 0.

Null or empty texts have no features and score the sample's share of label 1 as the curve has
it at margin 0. A null doc_id is held out and scored. Null labels are left out; of several
labels of an id the largest counts. Without labels of both classes every score is 0.5. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import vectext as vt
from gridloom.llm.store import documents, materialize, row_hash, scratch

SIZE, SAMPLE, THRESHOLD = 1 << 17, 8192, 0.3
SAMPLE_BYTES = 256 << 20
EPOCHS, COST, SMOOTH = 8, 1.0, 1.0


def features(column):
    """The sorted feature numbers of each text."""
    seen = np.zeros(SIZE, bool)
    for _, _, data, offsets in vt.chunks(column):
        words, _, _, before = vt.words(data, offsets)
        words = (words >> np.uint64(47)).astype(np.int64)
        wide = data.astype(np.uint32)
        if len(wide) > 2:
            grams = (wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16) * np.uint32(0x9E3779B1) >> np.uint32(15)
        else:
            grams = wide[:0]
        for i in range(len(offsets) - 1):
            seen[words[before[i] : before[i + 1]]] = True
            seen[grams[offsets[i] : max(offsets[i], offsets[i + 1] - 2)]] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found


@vt.released
def _sampled(batches):
    for batch in batches:
        raw = [x.astype(np.int32).tobytes() for x in features(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], ["row", "label", "f"])


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Weights of the linear hinge-loss model, one dual variable after another in random order."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    square = np.array([float(v @ v) for v in values])
    cost = np.where(y > 0, COST * len(y) / (2 * max(1, (y > 0).sum())), COST * len(y) / (2 * max(1, (y < 0).sum())))
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            if square[i] == 0:
                continue
            slope = y[i] * float(w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve from margins to probabilities, with smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = p - target
        d = p * (1 - p) + 1e-9
        h = np.array([[(d * margin * margin).sum() + 1e-3, (d * margin).sum()], [(d * margin).sum(), d.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(g * margin).sum(), g.sum()]))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def log_ratios(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """For each feature, the logarithm of the ratio of its smoothed shares in rows of label 1 and of label -1."""
    share = []
    for sign in (1, -1):
        own = [r for r, v in zip(rows, y, strict=True) if v == sign]
        count = SMOOTH + np.bincount(np.concatenate(own), minlength=size)
        share.append(count / (len(own) + 2 * SMOOTH))
    return np.log(share[0] / share[1])


def fit(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(log-ratios, weights, slope, offset) of labelled feature lists, y of 1 and -1."""
    if not (y > 0).any() or not (y < 0).any():
        return np.zeros(SIZE), np.zeros(SIZE), 0.0, 0.0
    held = np.arange(len(rows)) % 4 == 3
    if not all(((y == s) & m).any() for s in (1, -1) for m in (held, ~held)):
        held = np.zeros(len(rows), bool)
    train = np.flatnonzero(~held)
    ratio = log_ratios([rows[i] for i in train], y[train], SIZE)
    values = [ratio[r] / max(np.linalg.norm(ratio[r]), 1e-12) for r in rows]
    w = dual_descent([rows[i] for i in train], [values[i] for i in train], y[train], SIZE)
    test = np.flatnonzero(held) if held.any() else train
    a, b = logistic(np.array([float(w[rows[i]] @ values[i]) for i in test]), y[test])
    return ratio, w, a, b


def _scored(ratio: np.ndarray, w: np.ndarray, a: float, b: float):
    both, square = (ratio * w).astype(np.float64), ratio * ratio

    def run(batches):
        for batch in batches:
            margin = np.array([both[f].sum() / max(np.sqrt(square[f].sum()), 1e-12) for f in features(batch.column(2))])
            score = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score.astype(np.float64)), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return vt.released(run)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % 5 == 0


def _sample(rows: DataFrame) -> list[tuple[int, bytes]]:
    """(label, features) of the rows (row, label, text) with the smallest hashes, in their order, within the bounds."""
    first = materialize(rows.select("row").distinct().orderBy("row").limit(SAMPLE), "first")
    made = rows.join(F.broadcast(first), "row").mapInArrow(_sampled, "row long, label int, f binary")
    made = materialize(made.groupBy("row").agg(F.max("label").alias("label"), F.max("f").alias("f")), "features")
    total, last = 0, None
    for row, size in made.select("row", F.length("f")).orderBy("row").collect():
        total += size
        if total > SAMPLE_BYTES:
            break
        last = row
    if last is None:
        return []
    return [(r[1], bytes(r[2])) for r in sorted(made.where(F.col("row") <= last).toLocalIterator())]


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    # at most SAMPLE rows of two numbers: small enough to broadcast, whatever the corpus
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch(docs.sparkSession):
        got = _sample(source.join(F.broadcast(sample), "doc_id").select(row_hash().alias("row"), "label", "text"))
    x = [np.frombuffer(f, np.int32) for _, f in got]
    y = np.array([1 if v == 1 else -1 for v, _ in got])
    model = fit(x, y)
    return source.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_scored(*model), "doc_id long, held_out boolean, score double, predicted int")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
