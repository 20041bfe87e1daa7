"""Benchmark decontamination by latent semantic retrieval (operator 2).

Passages are windows of 32 words in steps of 16. Benchmark items come in blocks of bounded
size; for each block, over the whole corpus:

1. Frequencies of the block's terms over all steps give TF-IDF weights. Only terms that some
   item has can add to a product with an item, so the matrix keeps those columns.
2. One distributed pass of a randomised SVD: with A the matrix of all steps and W random,
   each task adds up its rows' part of Z = A'(A W); Z and W'Z give the leading right singular
   vectors (single-pass, symmetric form), scaled to even variance, so that rare terms count.
3. Passages and items (long items in pieces of a passage) are compared by cosine in the space
   of these vectors. Candidates around which too many of the item's words are missing are
   ruled out by bitmaps, exactly. The others are checked in place, on the words themselves: by
   the longest common subsequence with the item over the words around the passage, and by
   the item's answer, its last words.

An item is found in a document when its longest common subsequence covers ``NEAR`` of it,
or ``PARAPHRASE`` of it together with ``ANSWER`` of its answer.

The cosine only proposes: of what a check of every passage with every item finds, it may miss a
part (under 1 in 100 of exact, near and paraphrased items in tests). Terms that only
other texts have can add nothing to an item's coordinates, so the space leaves them out.

Words are runs of letters and digits, A-Z folded. Every text is read whole, every passage is
compared with every item. Items of fewer than ``MIN_WORDS`` words prove nothing and are found
only as an exact run of words. Null or empty texts and items match nothing; a null doc_id is
reported as such; repeated rows are reported once each; extra columns are ignored; an empty
benchmark or corpus gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import vectext as vt
from gridloom.llm.store import documents

STEP = 16
RANK, OVERSAMPLE = 64, 8
COSINE = 0.35
MIN_WORDS = 8
NEAR, PARAPHRASE, ANSWER, ANSWER_WORDS = 0.75, 0.6, 0.8, 8
#: Bounds of a block of items, which each task holds.
BLOCK_ITEMS, BLOCK_CHARS = 5_000, 1_000_000
#: Bits of a bitmap of terms, a power of two.
BITS = 512
U = np.uint64


def _words(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for lo, _, data, offsets in vt.chunks(column):
        hashes, _, _, before = vt.words(data, offsets, vt.ALPHANUMERIC, vt.LOWER)
        yield lo, hashes, before


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size; one item alone may exceed the bound."""
    held, chars = [], 0
    for item, text in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if held and (len(held) >= BLOCK_ITEMS or chars + len(text) > BLOCK_CHARS):
            yield held
            held, chars = [], 0
        held.append((item, text))
        chars += len(text)
    if held:
        yield held


class Terms:
    """A block's items as hashes, and the numbering of their terms."""

    def __init__(self, items: list[tuple[int, str]]):
        found = [(i, h) for _, h, before in _words(pa.array([t for _, t in items], pa.string())) for i, h in enumerate(np.split(h, before[1:-1]))]
        # _words gives rows in order, so position is enough
        self.ids = [i for i, _ in items]
        self.words = [h for _, h in found]
        self.terms = np.unique(np.concatenate([*self.words, np.zeros(0, U)]))
        self.lut = np.zeros(1 << 16, bool)
        self.lut[(self.terms >> U(48)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, term numbers) of the words that are terms."""
        at = np.flatnonzero(self.lut[(hashes >> U(48)).astype(np.int64)])
        if not len(self.terms) or not len(at):
            return at[:0], at[:0]
        k = np.searchsorted(self.terms, hashes[at])
        k[k == len(self.terms)] = 0
        ok = self.terms[k] == hashes[at]
        return at[ok], k[ok]


def steps(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(step of each word, document of each step, steps before each document)."""
    counts = np.diff(before)
    number = -(-counts // STEP)
    at = np.concatenate([[0], np.cumsum(number)])
    docs = np.repeat(np.arange(len(counts)), counts)
    return at[docs] + (np.arange(before[-1]) - before[docs]) // STEP, np.repeat(np.arange(len(number)), number), at


def _frequencies(terms: Terms):
    def run(batches):
        seen, total = np.zeros(len(terms.terms), np.int64), 0
        for batch in batches:
            for _, hashes, before in _words(batch.column(0)):
                step, of, _ = steps(before)
                total += len(of)
                at, k = terms.find(hashes)
                code = np.unique(step[at] * len(terms.terms) + k)
                seen += np.bincount(code % max(1, len(terms.terms)), minlength=len(terms.terms))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], total))], ["t", "n"])

    return vt.released(run)


def _hits(terms: Terms, weight: np.ndarray, hashes, before):
    """Steps, their documents, and the (step, term, weight) entries of the matrix."""
    step, of, at_step = steps(before)
    at, k = terms.find(hashes)
    keep = weight[k] > 0
    s, k = step[at[keep]], k[keep]
    return of, at_step, s, k, weight[k]


def _by_step(s: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(s):
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        out[s[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _windows(of: np.ndarray) -> np.ndarray:
    """Steps that begin a passage: all but a document's last, unless it is the only one."""
    if not len(of):
        return np.zeros(0, bool)
    follows = np.append(of[1:] == of[:-1], False)
    alone = ~follows & ~np.concatenate([[False], follows[:-1]])
    return follows | alone


def _sketch(terms: Terms, weight: np.ndarray, w: np.ndarray):
    def run(batches):
        z = np.zeros(w.shape, np.float64)
        weighted = w * weight[:, None]
        for batch in batches:
            for _, hashes, before in _words(batch.column(0)):
                of, _, s, k, x = _hits(terms, weight, hashes, before)
                if not len(s):
                    continue
                first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                y = np.add.reduceat(weighted[k], first, axis=0)
                y /= np.add.reduceat(x * x, first)[:, None]
                order = np.argsort(k, kind="stable")
                row = (np.cumsum(np.concatenate([[0], s[1:] != s[:-1]])))[order]
                k = k[order]
                first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                z[k[first]] += np.add.reduceat(y[row], first, axis=0)
        z *= weight[:, None]
        some = np.flatnonzero(z.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(z[some, i]) for i in range(w.shape[1]))], ["t", *(f"z{i}" for i in range(w.shape[1]))])

    return vt.released(run)


def singular_vectors(z: np.ndarray, w: np.ndarray, rank: int) -> np.ndarray:
    """The leading eigenvectors of C from Z = C W, C symmetric, each divided by the root of its eigenvalue."""
    core = w.T @ z
    value, vector = np.linalg.eigh((core + core.T) / 2)
    ok = value > max(value.max(initial=0), 0) * 1e-7
    if not ok.any():
        return np.zeros((len(z), 1))
    u, root, _ = np.linalg.svd(z @ (vector[:, ok] / np.sqrt(value[ok])), full_matrices=False)
    rank = min(rank, int(np.count_nonzero(root > root[0] * 1e-6)))
    return u[:, :rank] * (root[0] / root[:rank])


def places(words: list[int]) -> dict[int, int]:
    """The places of each word, a bit for each."""
    out: dict[int, int] = {}
    for i, x in enumerate(words):
        out[x] = out.get(x, 0) | 1 << i
    return out


def common_subsequence(at: dict[int, int], n: int, around: list[int]) -> int:
    """Length of the longest common subsequence of ``around`` and n words with these places, a bit for each of the n."""
    full = (1 << n) - 1
    row = full
    for y in around:
        m = at.get(y)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


class Item:
    def __init__(self, words: list[int]):
        self.words, self.n, self.at = words, len(words), places(words)
        self.answer = words[-ANSWER_WORDS:]
        self.answer_at = places(self.answer)

    def judge(self, around: list[int]) -> tuple[int, int, bool]:
        """(common words, common words of the answer, found)."""
        if self.n < MIN_WORDS:
            found = any(around[i : i + self.n] == self.words for i in range(len(around) - self.n + 1))
            return (self.n, self.n, True) if found else (0, 0, False)
        both = common_subsequence(self.at, self.n, around)
        if both < PARAPHRASE * self.n:
            return both, 0, False
        told = common_subsequence(self.answer_at, len(self.answer), around)
        return both, told, both >= NEAR * self.n or told >= ANSWER * len(self.answer)


def bitmaps(rows: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
    """For n rows, a bitmap of the term numbers that each holds."""
    bits = np.zeros((n, BITS), bool)
    bits[rows, numbers * 0x9E3779B1 % (1 << 32) >> 32 - BITS.bit_length() + 1] = True
    return np.packbits(bits, axis=1).view(U)


def spread(bits: np.ndarray, reach: int) -> np.ndarray:
    """Each row with the rows up to ``reach`` before and after it."""
    out, done = bits.copy(), 0
    while done < reach:
        shift = min(2 * done + 1, reach - done)
        now = out.copy()
        now[shift:] |= out[:-shift]
        now[:-shift] |= out[shift:]
        out, done = now, done + shift
    return out


def _search(terms: Terms, weight: np.ndarray, basis: np.ndarray, cosine: float):
    def run(batches):
        queries, owner = [], []
        for i, h in enumerate(terms.words):
            for a in range(0, max(1, len(h) - STEP), STEP) if len(h) > 2 * STEP else [0]:
                _, k = terms.find(h[a : a + 2 * STEP])
                k = np.unique(k[weight[k] > 0])
                vector = (basis[k] * weight[k][:, None]).sum(axis=0)
                if np.linalg.norm(vector) > 1e-9:
                    queries.append(vector / np.linalg.norm(vector))
                    owner.append(i)
        if not queries:
            return
        q, owner = np.array(queries, np.float32), np.array(owner, np.int64)
        held = [np.unique(terms.find(h)[1]) for h in terms.words]
        item_bits = bitmaps(np.repeat(np.arange(len(held)), [len(k) for k in held]), np.concatenate(held), len(held))
        # words that may be missing around a passage, and steps that the words around it may reach
        sizes = np.array([len(h) for h in terms.words])
        missing = (sizes * (1 - PARAPHRASE) + 1e-9).astype(np.int64)
        reach = 1 << np.ceil(np.log2(np.maximum(1, -(-sizes // STEP)))).astype(np.int64)
        items = [Item(h.tolist()) for h in terms.words]
        weighted = basis * weight[:, None]
        for batch in batches:
            rows, out = [], []
            for lo, hashes, before in _words(batch.column(1)):
                of, at_step, s, k, _ = _hits(terms, weight, hashes, before)
                if not len(s):
                    continue
                begins = _windows(of)
                two = begins & np.append(of[1:] == of[:-1], False)
                y = _by_step(s, weighted[k], len(of))
                y[:-1] += np.where(two[:-1, None], y[1:], 0)
                norm = np.sqrt(np.einsum("ij,ij->i", y, y))
                live = np.flatnonzero(begins & (norm > 1e-9))
                y = y[live] / norm[live, None]
                of_step = bitmaps(s, k, len(of))
                near = {int(r): spread(of_step, int(r) + 1) for r in np.unique(reach[owner])}
                best: dict[tuple[int, int], tuple[int, int]] = {}
                size = max(1, 2_000_000 // len(q))
                for a in range(0, len(live), size):
                    hit, query = np.nonzero(y[a : a + size] @ q.T >= cosine)
                    step, item = live[a + hit], owner[query]
                    # words that no step near has are missing, whatever their order: nothing is lost by this
                    ok = np.zeros(len(step), bool)
                    for r, bits in near.items():
                        own = np.flatnonzero(reach[item] == r)
                        ok[own] = np.bitwise_count(item_bits[item[own]] & ~bits[step[own]]).sum(axis=1) <= missing[item[own]]
                    step, query = step[ok], query[ok]
                    code = np.unique(step * len(items) + owner[query])
                    for p, i in zip((code // len(items)).tolist(), (code % len(items)).tolist(), strict=True):
                        doc, item = int(of[p]), items[i]
                        if (doc, i) in best and best[doc, i][0] == item.n:
                            continue
                        first = before[doc] + (p - at_step[doc]) * STEP
                        around = hashes[max(before[doc], first - item.n) : min(before[doc + 1], first + 2 * STEP + item.n)].tolist()
                        both, told, found = item.judge(around)
                        if found and (both, told) > best.get((doc, i), (0, 0)):
                            best[doc, i] = both, told
                for (doc, i), (both, told) in sorted(best.items()):
                    rows.append(lo + doc)
                    out.append((terms.ids[i], items[i].n, both, told))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *(pa.array(x, pa.int64()) for x in zip(*out, strict=True))], ["doc_id", "item_id", "item_words", "common_words", "answer_words"])

    return vt.released(run)


_FOUND = "doc_id long, item_id long, item_words long, common_words long, answer_words long"


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row for each document and benchmark item found in it: doc_id, item_id, item_words, common_words, answer_words."""
    spark = docs.sparkSession
    texts, source = docs.select("text"), docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], _FOUND)
    for items in blocks(benchmark):
        terms = Terms(items)
        if not len(terms.terms):
            continue
        counted = dict(map(tuple, texts.mapInArrow(_frequencies(terms), "t long, n long").groupBy("t").agg(F.sum("n")).collect()))
        total = max(counted.pop(-1, 0), 1)
        seen = np.zeros(len(terms.terms))
        for t, n in counted.items():
            seen[t] = n
        # Positive however common a term is: a benchmark item may itself be what makes its terms common.
        weight = np.where(seen > 0, np.log1p(total / (seen + 0.5)), 0).astype(np.float32)
        rank = min(RANK + OVERSAMPLE, len(terms.terms))
        w = np.random.default_rng(17).standard_normal((len(terms.terms), rank)).astype(np.float32)
        columns = [f"z{i}" for i in range(rank)]
        z = np.zeros((len(terms.terms), rank))
        added = texts.mapInArrow(_sketch(terms, weight, w), ", ".join(["t long", *(f"{c} double" for c in columns)])).groupBy("t").agg(*(F.sum(c).alias(c) for c in columns))
        for row in added.toLocalIterator():
            z[row[0]] = row[1:]
        basis = singular_vectors(z, w.astype(np.float64), RANK).astype(np.float32)
        out = out.unionByName(source.mapInArrow(_search(terms, weight, basis, cosine), _FOUND))
    return out


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
