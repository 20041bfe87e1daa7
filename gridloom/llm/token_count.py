"""Token counts by rank-synchronous merging of arrays (operator 1).

Texts are cut into pre-tokens. Pre-tokens not yet known to the task are held together as one
ragged array of symbols; in each round, every sequence merges all places of its own
lowest-ranked pair, all sequences at once, until none has a ranked pair. The symbols that
survive are the tokens. A pre-token of over ``LONG`` bytes is merged by itself in the same rounds,
each at the cost of its merges. Counts are kept for later texts of the task, in a table of bounded size.

Counts equal those of the ``tokenizers`` library for a byte-level BPE file: no begin, end or
added tokens, no truncation or padding; the added tokens' strings inside a text are one token
each, as is the library's default. A null text is empty: 0 bytes, 0 tokens. Texts are read
whole, also very long ones. A null doc_id stays null; repeated rows are counted each; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import vectext as vt
from gridloom.llm.store import documents

#: Unicode white space.
_SPACE = r"\t-\r \x85\xa0  -     　"
_PIECE = "'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+"
#: Texts of these characters are cut here; others by the library's own pre-tokenizer, whose tables of letters may be of another age.
_PLAIN = "[\\x00-\\u036f\\u2000-\\u206f\\u20a0-\\u20bf]*"
KNOWN, BATCH = 400_000, 1 << 19
#: Bytes of a pre-token from which it is merged by itself.
LONG = 2048
NONE = np.int64(1) << 40


class Merger:
    """The merge table of a vocabulary file, for arrays."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.added = sorted((x["content"] for x in model["added_tokens"]), key=len, reverse=True)
        self.split = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        self.plain = re.compile(_PLAIN)
        every = [chr(c) for c in range(0x20C0) if self.plain.fullmatch(chr(c))]
        letter, digit = ("".join(re.escape(c) for c in every if regex.fullmatch(rf"\p{{{kind}}}", c)) for kind in "LN")
        self.piece = re.compile(_PIECE.format(space=_SPACE, letter=letter, digit=digit))
        self.path, self.library, self.known = path, None, {}
        vocab = model["model"]["vocab"]
        letters = byte_letters()
        self.letters = {c: b for b, c in enumerate(letters)}
        self.byte = np.array([vocab[c] for c in letters], np.int64)
        self.width = max(vocab.values()) + 1
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["model"]["merges"]]
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order, made[order]
        self.by_rank = made

    def cut(self, text: str) -> list:
        """Pre-tokens of a text without added tokens: strings, or bytes where the library cut them."""
        if self.plain.fullmatch(text):
            return self.piece.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [bytes(self.letters[c] for c in x) for x, _ in self.library.pre_tokenize_str(text)]

    def counts(self, pieces: list) -> np.ndarray:
        """Symbols that survive in each pre-token."""
        raw = [x if isinstance(x, bytes) else x.encode() for x in pieces]
        out = np.array([len(x) if len(x) <= LONG else self.long_count(x) for x in raw], np.int64)
        lengths = np.array([len(x) if len(x) <= LONG else 0 for x in raw], np.int64)
        symbol = self.byte[np.frombuffer(b"".join(x for x in raw if len(x) <= LONG), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), lengths)
        while len(symbol) > 1:
            pair = symbol[:-1] * self.width + symbol[1:]
            at = np.searchsorted(self.key, pair)
            at[at == len(self.key)] = 0
            rank = np.where((self.key[at] == pair) & (owner[:-1] == owner[1:]), self.rank[at], NONE)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(np.append(rank, NONE), first)
            run = np.diff(np.append(first, len(owner)))
            live = np.repeat(least < NONE, run)
            hit = rank == np.repeat(least, run)[:-1]
            hit &= live[:-1]
            if not hit.any():
                break
            # of places that overlap (a a a), every other one counts, from the left
            place = np.flatnonzero(hit)
            fresh = np.concatenate([[True], place[1:] != place[:-1] + 1])
            start = np.flatnonzero(fresh)
            nth = np.arange(len(place)) - np.repeat(start, np.diff(np.append(start, len(place))))
            place = place[nth % 2 == 0]
            symbol[place] = self.by_rank[rank[place]]
            out -= np.bincount(owner[place], minlength=len(out))
            # sequences without a ranked pair are done
            live[place + 1] = False
            symbol, owner = symbol[live], owner[live]
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; ``NONE`` for those that never merge and at the end, where ``right`` is under 0."""
        pair = left * self.width + right
        at = np.searchsorted(self.key, pair)
        at[at == len(self.key)] = 0
        return np.where((self.key[at] == pair) & (right >= 0), self.rank[at], NONE)

    def long_count(self, raw: bytes) -> int:
        """Symbols that survive in one very long pre-token. Its lowest-ranked pairs merge together too, but a round costs what it merges, not the length.

        Places are linked to their neighbours. Places wait by the rank of their pair, and a heap has the ranks.
        """
        n = len(raw)
        symbol = np.append(self.byte[np.frombuffer(raw, np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[n], before[0] = n, n
        rank = np.append(self.ranks(symbol[:-1], symbol[1:]), NONE)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] < NONE]
            if not len(places):
                return
            places = places[np.argsort(rank[places], kind="stable")]
            of = rank[places]
            edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(of)], strict=True):
                own = int(of[a])
                if own not in waiting:
                    waiting[own] = []
                    heapq.heappush(heap, own)
                waiting[own].append(places[a:b])

        wait(np.arange(n))
        left = n
        while heap:
            least = heapq.heappop(heap)
            place = np.unique(np.concatenate(waiting.pop(least)))
            place = place[rank[place] == least]
            if not len(place):
                continue
            # of places that overlap (a a a), every other one counts, from the left
            start = np.flatnonzero(np.concatenate([[True], place[1:] != after[place[:-1]]]))
            nth = np.arange(len(place)) - np.repeat(start, np.diff(np.append(start, len(place))))
            place = place[nth % 2 == 0]
            gone = after[place]
            symbol[place] = self.by_rank[least]
            rank[gone] = NONE
            after[place] = after[gone]
            before[after[place]] = place
            left -= len(place)
            changed = np.unique(np.concatenate([place, before[place]]))
            changed = changed[changed < n]
            rank[changed] = self.ranks(symbol[changed], symbol[after[changed]])
            wait(changed)
        return left

    def count(self, texts: list[str]) -> list[int]:
        cut, extra = [], []
        for text in texts:
            parts = [text]
            if any(x in text for x in self.added):
                parts = self.split.split(text)
            cut.append([x for part in parts for x in self.cut(part)] if len(parts) > 1 else self.cut(text))
            extra.append(len(parts) - 1)
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        get = known.get
        found = [list(map(get, pieces)) for pieces in cut]
        missed = [[x for x, n in zip(pieces, values, strict=True) if n is None] if None in values else [] for pieces, values in zip(cut, found, strict=True)]
        fresh = list({x for pieces in missed for x in pieces})
        a = 0
        while a < len(fresh):
            b, size = a, 0
            while b < len(fresh) and size < BATCH:
                size += len(fresh[b])
                b += 1
            known.update(zip(fresh[a:b], self.counts(fresh[a:b]).tolist(), strict=True))
            a = b
        return [(sum(filter(None, values)) + sum(map(get, rest)) if rest else sum(values)) + n for values, rest, n in zip(found, missed, extra, strict=True)]


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


def _counted(path: str, limit: int):
    def run(batches):
        of = merger(path)
        for batch in batches:
            text = batch.column(1).fill_null("")
            for lo, hi, _, offsets in vt.chunks(text):
                n = of.count(text.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(offsets[1:] - offsets[:-1]), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return vt.released(run)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``; ``path``: a vocabulary file that every executor has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counted(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
