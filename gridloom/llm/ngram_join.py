"""N-gram Jaccard self-join by partitioning the universe of shingles (operator 4).

Every text becomes its set of distinct 5-word shingles. Two sets of at least 0.75 Jaccard
similarity differ in few shingles (at most (|A| + |B|) / 7). Sizes are cut into bands of
ratio 4/3, so that partners lie in the same or in neighbouring bands; a *scheme* serves the
pairs whose larger set is in one band. A scheme splits the hash universe into m segments.
By the pigeonhole principle, when the segments' allowances (t + 1 each, t = 0: same subset,
t = 1: same subset after one deletion on either side) add up to more than the possible
differences, some segment agrees. The index holds a key for every segment's subset and, for
t = 1, for its one-deletion neighbours. ``scheme`` picks t and m by cost.

How the work is laid out:

1. One pass hashes the texts: a set's fingerprint is its node, so texts with equal sets are
   one node from there on. A task sends the keys of a node once, however many copies it reads.
2. Keys travel packed as arrays, dealt over partitions of bounded size, and are matched there
   by sorting. A key with few nodes gives its pairs. A key with many gives membership rows
   only; a task that holds many of its nodes itself makes those rows there and sends a few
   nodes on, so that no key brings more than a few nodes a task together.
3. Each key with many nodes gives a star around its most central node, the one with most such
   keys. Bitmaps of the sets rule out most pairs, exactly; the sets of the others are
   fetched and the pairs are verified on the whole sets. Verified links make components.
4. Keys with many nodes that still hold several components, such as those of widespread
   passages, count as given up, and the allowance of their segments is taken off: a node
   whose remaining allowance still exceeds its possible differences loses nothing. The others
   get stars again, around the most central node of what each key has outside its last
   centre's component.
5. For nodes that are still short the universe is cut to the finest, a segment for each
   shingle, and allowances go to the cheapest segments (``_short_pairs``): those that fewest
   of these nodes hold. Only pairs across components are made.

No link is lost, and nothing is capped or sampled. Shingles and sets are 64-bit hashes, and
links are verified on all 64 bits of every shingle.

Inputs and edge cases: a null text, or one without words, has an empty set and no links; a
text with 1 to 4 words is one shingle. A null doc_id gets a row; it never becomes a
component_id unless its whole component has no other. Rows with equal ids count as
separate documents. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import vectext as vt
from gridloom.llm.graph import components
from gridloom.llm.store import documents, materialize, scratch

#: Jaccard threshold as a fraction.
NUM, DEN = 75, 100
#: Words of a shingle.
WORDS = 5
#: Most nodes of a key that gives all its pairs; one of more gives stars, in up to ``ROUNDS`` rounds.
STAR, ROUNDS = 8, 4
#: Shingles (of two to three keys) of a partition, its keys that are matched at a time, keys held by a task before it sends them, and members of keys sent together.
PART_SHINGLES, PIECE_KEYS, FLUSH_KEYS, MEMBER_ROWS = 1_000_000, 500_000, 600_000, 1 << 16
#: Wanted nodes up to which their table, of 16 bytes a node, is broadcast.
BROADCAST_NODES = 1_000_000
U = np.uint64


# -- sets -------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of all rows, shingles before each row)."""
    w, _, _, before = vt.words(data, offsets)
    counts = np.diff(before)
    n = len(counts)
    sizes = np.where(counts >= WORDS, counts - WORDS + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(at[-1], U)
    long = counts >= WORDS
    if len(w) >= WORDS:
        every = vt.combine([w[i : len(w) - WORDS + 1 + i] for i in range(WORDS)], WORDS)
        ok = np.zeros(len(w) + 1, np.int64)
        np.add.at(ok, before[:-1][long], 1)
        np.add.at(ok, before[1:][long] - WORDS + 1, -1)
        out[np.repeat(long, sizes)] = every[np.cumsum(ok)[: len(every)] > 0]
    for k in range(1, WORDS):
        rows = np.flatnonzero(counts == k)
        if len(rows):
            out[at[rows]] = vt.combine([w[before[rows] + i] for i in range(k)], k)
    for i in range(n):
        out[at[i] : at[i + 1]].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[at[:-1][sizes > 0]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def pack(sets: np.ndarray) -> bytes:
    return sets.astype("<u8").tobytes()


def unpack(raw) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def bitmaps(sets: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A bitmap of each row's set with one bit for each shingle, in a power of two of bits, two a shingle at least."""
    out = []
    place = vt.mix(sets ^ U(0x2545F4914F6CDD1D))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        bits = np.zeros(1 << max(6, (2 * (b - a) - 1).bit_length()), np.uint8)
        bits[(place[a:b] & U(len(bits) - 1)).astype(np.int64)] = 1
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return out


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def may_link(a: bytes, b: bytes, sizes: tuple[int, int]) -> bool:
    """False only if the sets can't be linked: every place where the bitmaps differ is a shingle that one of them lacks."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum()) <= differences(*sizes)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U), np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def nodes_of(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A fingerprint of each row's set."""
    return vt.mix(_sums(vt.mix(sets ^ U(0x5851F42D4C957F2D)), at) + np.diff(at).astype(U) * vt.BASE)


# -- schemes ----------------------------------------------------------------


@lru_cache(None)
def _starts(largest: int) -> tuple[int, ...]:
    """The smallest size of each band, up to one beyond ``largest``: partners of a band's sizes end within the next band."""
    out = [1, 2]
    while out[-2] <= largest:
        out.append(max(out[-1] + 1, (out[-1] - 1) * DEN // NUM + 1))
    return tuple(out)


def band(sizes: np.ndarray) -> np.ndarray:
    starts = np.array(_starts(int(sizes.max(initial=1))))
    return np.searchsorted(starts, sizes, "right") - 1


def differences(a: int, b: int) -> int:
    """The most shingles in which linked sets of these sizes differ."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


@lru_cache(None)
def scheme(j: int) -> tuple[int, int, int]:
    """(segments, t, largest size) of band j, by the least expected cost.

    The cost is the keys of a set plus, for both kinds of segment, what is expected to be
    missing from the allowance because segments are empty (t = 0) or hold under two
    shingles (t = 1), two standard deviations included.
    """
    upper = 2
    while len(_starts(upper)) < j + 3:
        upper *= 2
    lo, hi = _starts(upper)[j], _starts(upper)[j + 1] - 1
    need = differences(hi, hi) + 1
    best = None
    for t in (0, 1):
        for m in sorted({max(1, math.ceil(need / (t + 1) * (1 + i / 20))) for i in range(1, 21)}):
            cost = m + t * hi
            for size in (lo, hi):
                mean = size / m
                skip = math.exp(-mean) * (1 + t * mean)
                short = differences(size, hi) + 1 - (t + 1) * (m * (1 - skip) - 2 * math.sqrt(m * skip * (1 - skip)))
                cost += 8 * max(0.0, short) * (t + 1)
            if best is None or cost < best[0]:
                best = (cost, m, t)
    return best[1], best[2], hi


def segment_keys(sets: np.ndarray, at: np.ndarray, role: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, their rows, their segments, what each row can spare) in the scheme of each row's band (role 0) or the one above (role 1).

    What a row can spare are segments: the allowance of those with usable keys, less the
    possible differences, less 1, over the allowance of one; under 0 it is short already.
    """
    sizes = np.diff(at)
    bands = band(np.maximum(sizes, 1)) + role
    uniq, inverse = np.unique(bands, return_inverse=True)
    table = np.array([scheme(int(j)) for j in uniq] or [(1, 0, 1)])
    m, t, hi = (table[inverse, i] if len(sizes) else np.zeros(0, np.int64) for i in range(3))
    partner = np.minimum(hi, sizes * DEN // NUM)
    spare = -((sizes + partner) * (DEN - NUM) // (DEN + NUM)) - 1
    rows = np.repeat(np.arange(len(sizes)), sizes)
    if not len(sets):
        return np.zeros(0, U), rows, rows, spare // (t + 1)
    place = ((sets >> U(32)) * m[rows].astype(U)) >> U(32)
    new = np.ones(len(sets), bool)
    new[1:] = (place[1:] != place[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    edge = np.append(first, len(sets))
    mixed = vt.mix(sets + U(0xA0761D6478BD642F))
    total = _sums(mixed, edge)
    owner, held = rows[first], np.diff(edge)
    salt = vt.mix((bands[owner].astype(U) << U(32)) ^ place[first] ^ U(0xE7037ED1A0B428DB))
    keys = vt.mix(total + salt)
    segment = place[first].astype(np.int64)
    usable = np.where(t[owner] == 1, held >= 2, held >= 1)
    spare = spare + np.bincount(owner, weights=usable * (t[owner] + 1), minlength=len(sizes)).astype(np.int64)
    cut = (t[rows] == 1) & (np.repeat(held, held) >= 2)
    if cut.any():
        one_less = vt.mix(np.repeat(total + salt, held)[cut] - mixed[cut])
        keys, owner = np.concatenate([keys, one_less]), np.concatenate([owner, rows[cut]])
        segment = np.concatenate([segment, np.repeat(segment, held)[cut]])
    return keys, owner, segment, spare // (t + 1)


def narrow(values: np.ndarray) -> bytes:
    """In 1 or 2 bytes each where they fit, else 4."""
    most = values.max(initial=0)
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def widened(raw, count: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // max(1, count) or 1}").astype(np.int64)


def steps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Values that grow within runs, which begin at ``first``, as differences from the one before in the run."""
    out = np.diff(values, prepend=0)
    out[first] = values[first]
    return out


def stepped(values: np.ndarray, first: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """``steps`` undone; ``runs``: the lengths of the runs."""
    total = np.cumsum(values)
    return total - np.repeat(total[first] - values[first], runs)


# -- passes over the texts --------------------------------------------------


@vt.released
def _table_of_sets(batches):
    """doc_id, row, node, n_shingles, the segments that a node can spare in either scheme, and its bitmap."""
    for batch in batches:
        text = batch.column(1)
        for lo, hi, data, offsets in vt.chunks(text):
            sets, at = shingle_sets(data, offsets)
            sizes = np.diff(at)
            spare = [pa.array(segment_keys(sets, at, role)[3]) for role in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(vt.signed(nodes_of(sets, at))), pa.array(sizes), *spare, pa.array(bitmaps(sets, at), pa.binary())], ["doc_id", "row", "node", "n_shingles", "spare0", "spare1", "bits"])


@vt.released
def _sets_by_node(batches):
    """(text, node wanted of it) to (node, its set)."""
    for batch in batches:
        wanted = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in vt.chunks(batch.column(0)):
            sets, at = shingle_sets(data, offsets)
            node = vt.signed(nodes_of(sets, at))
            own = np.flatnonzero(node == wanted[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array([pack(sets[at[i] : at[i + 1]]) for i in own], pa.binary())], ["node", "sh"])


def key_names(keys: np.ndarray, part) -> np.ndarray:
    """A name for the keys (their lower 32 bits) of a partition."""
    return vt.mix((keys.astype(U) << U(32)) ^ np.asarray(part).astype(U))


_PACKED = "p long, keys binary, counts binary, segments binary, nodes binary, sizes binary, members binary"


def _packed(p: int, *parts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p]), *(pa.array([x], pa.binary()) for x in parts)], [x.split()[0] for x in _PACKED.split(", ")])


def _packed_keys(parts: int):
    """Rows of one partition's keys, and rows of members of keys that have many nodes within the task, dealt evenly."""

    def run(batches):
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def flush():
            keys, nodes, sizes, segments = (np.concatenate(x) for x in zip(*held, strict=True))
            part = (((keys >> U(32)) * U(parts)) >> U(32)).astype(np.int64)
            order = np.lexsort((nodes, keys))
            key, node = keys[order], nodes[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
            order, key = order[new], key[new]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            run = np.diff(np.append(first, len(key)))
            many = np.repeat(run, run) > STAR
            if many.any():
                own = order[many]
                name = key_names(keys[own].astype(np.uint32), part[own])
                spread = int(name[0] % U(parts))
                for a in range(0, len(own), MEMBER_ROWS):
                    own_, name_ = own[a : a + MEMBER_ROWS], name[a : a + MEMBER_ROWS]
                    yield _packed((spread + a // MEMBER_ROWS) % parts, *[b""] * 5, nodes[own_].tobytes() + name_.tobytes() + segments[own_].astype(U).tobytes())
            # of a key with many nodes here, as many go on as show that it has many
            order = order[np.arange(len(order)) - np.repeat(first, run) <= STAR]
            # by node within a partition: nodes are told once, with the counts of their keys, and segments as small steps
            order = order[np.lexsort((segments[order], nodes[order], part[order]))]
            edge = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                own = order[edge[p] : edge[p + 1]]
                if len(own):
                    node = nodes[own]
                    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
                    counts = np.diff(np.append(first, len(own)))
                    yield _packed(p, keys[own].astype(np.uint32).tobytes(), narrow(counts), narrow(steps(segments[own], first)), node[first].tobytes(), narrow(sizes[own[first]]), b"")

        for batch in batches:
            for _, _, data, offsets in vt.chunks(batch.column(0)):
                sets, at = shingle_sets(data, offsets)
                nodes, sizes = nodes_of(sets, at), np.diff(at)
                # Up to 2 shingles only equal sets are linked, and those are one node; 3 within 4 reach 3/4.
                fresh = np.array([s > 2 and x not in seen and not seen.add(x) for x, s in zip(nodes.tolist(), sizes.tolist(), strict=True)], bool)
                if len(seen) > 1_000_000:
                    seen.clear()
                if not fresh.any():
                    continue
                sets, at = sets[np.repeat(fresh, sizes)], np.concatenate([[0], np.cumsum(sizes[fresh])])
                nodes, sizes = nodes[fresh], sizes[fresh]
                for role in (0, 1):
                    keys, owner, segment, _ = segment_keys(sets, at, role)
                    held.append((keys, nodes[owner], sizes[owner].astype(np.uint32), 2 * segment + role))
                    count += len(keys)
                if count >= FLUSH_KEYS:
                    yield from flush()
                    held.clear()
                    count = 0
        if held:
            yield from flush()

    return vt.released(run)


# -- matching ---------------------------------------------------------------

_MATCH = "kind int, a long, b long, segment int"


def _keys(table: pa.Table, local: np.ndarray, piece: int, pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """(key and node, segment) of the keys in a piece of their range, sorted and each once; ``local``: the numbers of all rows' nodes."""
    both, segment, base = [np.zeros(0, U)], [np.zeros(0, np.uint32)], 0
    for row in range(table.num_rows):
        keys = np.frombuffer(table["keys"][row].as_buffer(), np.uint32)
        n = len(table["nodes"][row].as_buffer()) // 8
        if len(keys):
            counts = widened(table["counts"][row].as_buffer(), n)
            refs, first = np.repeat(local[base : base + n], counts), np.cumsum(counts) - counts
            where = stepped(widened(table["segments"][row].as_buffer(), len(keys)), first, counts)
            own = np.flatnonzero((keys.astype(U) * U(pieces)) >> U(32) == piece)
            both.append((keys[own].astype(U) << U(32)) | refs[own].astype(U))
            segment.append(where[own].astype(np.uint32))
        base += n
    both, segment = np.concatenate(both), np.concatenate(segment)
    order = np.argsort(both, kind="stable")
    both, segment = both[order], segment[order]
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    return both[new], segment[new]


def _match(table: pa.Table) -> pa.Table:
    """Pairs (kind 0) of one partition's keys, and membership (kind 1: node, key, twice the node's segment plus the role) of keys with more than STAR nodes.

    Keys are unpacked and sorted a piece of their range at a time.
    """
    members = [np.zeros((3, 0), U)]
    nodes, sizes, total = [np.zeros(0, U)], [np.zeros(0, np.uint32)], 0
    for row in range(table.num_rows):
        members.append(np.frombuffer(table["members"][row].as_buffer(), U).reshape(3, -1))
        nodes.append(np.frombuffer(table["nodes"][row].as_buffer(), U))
        sizes.append(widened(table["sizes"][row].as_buffer(), len(nodes[-1])).astype(np.uint32))
        total += len(table["keys"][row].as_buffer()) // 4
    uniq, first, local = np.unique(np.concatenate(nodes), return_index=True, return_inverse=True)
    size, local = np.concatenate(sizes)[first].astype(np.int64), local.astype(np.uint32)
    del nodes, sizes, first
    codes, pieces = [np.zeros(0, np.int64)], -(-total // PIECE_KEYS)
    for piece in range(pieces):
        both, segment = _keys(table, local, piece, pieces)
        key, ref = (both >> U(32)).astype(np.uint32), (both & U(0xFFFFFFFF)).astype(np.int64)
        del both
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        run = np.diff(np.append(start, len(key)))
        few = np.repeat(run <= STAR, run)
        for d in range(1, min(STAR, len(key))):
            i = np.flatnonzero(few[:-d] & (key[:-d] == key[d:]))
            a, b = ref[i], ref[i + d]
            ok = np.minimum(size[a], size[b]) * DEN >= np.maximum(size[a], size[b]) * NUM
            codes.append(np.unique(a[ok] * len(uniq) + b[ok]))
        many = np.flatnonzero(~few)
        members.append(np.stack([uniq[ref[many]], key_names(key[many], table["p"][0].as_py()), segment[many].astype(U)]))
    code = np.unique(np.concatenate(codes))
    a, b = uniq[code // max(1, len(uniq))], uniq[code % max(1, len(uniq))]
    node, name, where = np.concatenate(members, axis=1)
    out = pa.table({
        "kind": pa.array(np.repeat(np.array([0, 1], np.int32), [len(a), len(node)])),
        "a": pa.array(vt.signed(np.concatenate([a, node]))),
        "b": pa.array(vt.signed(np.concatenate([b, name]))),
        "segment": pa.array(np.concatenate([np.zeros(len(a), np.int32), where.astype(np.int32)])),
    })
    vt.trim()
    return out


@vt.released
def _linked(batches):
    for batch in batches:
        a, b, left, right = (batch.column(i) for i in range(4))
        keep = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = unpack(left[i].as_buffer()), unpack(right[i].as_buffer())
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int(np.count_nonzero(y[at] == x)) if len(y) else 0
            keep[i] = DEN * both >= NUM * (len(x) + len(y) - both) and both > 0
        mask = pa.array(keep)
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])


@vt.released
def _plausible(batches):
    for batch in batches:
        a, b, x, y, nx, ny = (batch.column(i) for i in range(6))
        keep = pa.array([may_link(p, q, (i, j)) for p, q, i, j in zip(x.to_pylist(), y.to_pylist(), nx.to_pylist(), ny.to_pylist(), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])


def plausible(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps don't rule a link out. Most candidates end here, at a tenth of a set's bytes."""
    left = bits.select(F.col("node").alias("a"), F.col("bits").alias("x"), F.col("n").alias("nx"))
    right = bits.select(F.col("node").alias("b"), F.col("bits").alias("y"), F.col("n").alias("ny"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "nx", "ny")
    return both.mapInArrow(_plausible, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets, all among ``sets``, reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("sh").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("sh").alias("right"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(_linked, "a long, b long")


def _label(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """``nodes`` with the root of each ``node``: itself where it has no link."""
    found = comps.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return nodes.join(found, F.col("node") == F.col("_n"), "left").withColumn("root", F.coalesce("_r", "node")).drop("_n", "_r")


def _short(nodes: DataFrame, members: DataFrame, comps: DataFrame) -> DataFrame:
    """Of ``nodes`` (node, spare0, spare1), those short of allowance: for empty segments alone, or without the keys that hold several components."""
    held = materialize(_label(members, comps), "members")
    several = held.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    gone = held.join(several, "key", "left_semi").select("node", "segment").distinct()
    lost = gone.groupBy("node").agg(F.sum(1 - F.col("segment") % 2).alias("lost0"), F.sum(F.col("segment") % 2).alias("lost1"))
    return nodes.join(lost, "node", "left").where("spare0 < coalesce(lost0, 0) or spare1 < coalesce(lost1, 0)").select("node", "spare0", "spare1")


def _stars(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the most central member of each key: key, centre; distinct pairs of centres and members). A member's ``degree`` says how central it is."""
    best = members.groupBy("key").agg(F.max(F.struct("degree", "node")).getField("node").alias("centre"))
    best = materialize(best, "centres")
    pairs = members.join(best, "key").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    return best, pairs.distinct()


def _across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs of nodes of different components."""
    ends = _label(_label(pairs.withColumn("node", F.col("a")), comps).select("a", "b", F.col("root").alias("_ra")).withColumn("node", F.col("b")), comps)
    return ends.where("_ra <> root").select("a", "b")


@vt.released
def _listed(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            s = unpack(batch.column(1)[i].as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), batch.column(0)[i].as_py())), pa.array(vt.signed(s)), pa.array(np.full(len(s), len(s)))], ["node", "s", "n"])


def _short_pairs(sets: DataFrame, comps: DataFrame) -> DataFrame:
    """All pairs of nodes with short allowances, of different components, that may be linked, by segments of one shingle each.

    Linked sets share at least 0.75 of either, so a set lacks at most 0.25 n of its segments
    in its partner, and 0.25 n + 1 allowances are enough. They go to the cheapest segments,
    those that fewest of these nodes hold; as all nodes rank segments alike, linked sets
    meet in one that both have allotted. All they share is at or after the first such place in
    either, so what is left there must reach the threshold: this rules out texts that share
    only a widespread passage, within the join itself.
    """
    from pyspark.sql import Window as W

    listed = materialize(sets.mapInArrow(_listed, "node long, s long, n long"), "short")
    seen = listed.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    place = W.partitionBy("node").orderBy("f", "s")
    first = listed.join(seen, "s", "left").withColumn("f", F.coalesce("f", F.lit(1))).withColumn("r", F.row_number().over(place))
    first = first.where(f"f > 1 and r <= n - ceil(n * {NUM / DEN}) + 1").select("node", "s", "n", "r")
    first = materialize(_label(first, comps), "rarest")
    other = first.select(F.col("node").alias("b"), "s", F.col("n").alias("nb"), F.col("r").alias("rb"), F.col("root").alias("other"))
    left = f"(1 + least(n - r, nb - rb)) * {DEN + NUM} >= (n + nb) * {NUM}"
    return first.join(other, "s").where(f"node < b and root <> other and least(n, nb) * {DEN} >= greatest(n, nb) * {NUM} and {left}").select(F.col("node").alias("a"), "b").distinct()


def _fetched(wanted: DataFrame, table: DataFrame, source: DataFrame) -> DataFrame:
    """(node, set) of the wanted nodes, each from one of its rows, found by a hash of id and text; rows equal in both are read alike."""
    one = table.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))
    one = materialize(one, "wanted")
    # two numbers each: up to this many are broadcast, and no text moves
    texts = source.join(F.broadcast(one) if one.count() <= BROADCAST_NODES else one, "row").select("text", "node")
    return materialize(texts.mapInArrow(_sets_by_node, "node long, sh binary").dropDuplicates(["node"]), "fetched")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, n_shingles, component_id, set_id (equal for equal sets)."""
    with scratch(docs.sparkSession):
        table, least = _joined(docs)
    out = table.join(least, (F.col("node") == F.col("_n")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), F.when(F.col("n_shingles") > 0, F.col("node")).alias("set_id"))


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n_shingles of each row; the least doc_id of each node's component)."""
    spark = docs.sparkSession
    # Equal texts in one task are hashed like any other; only their keys are sent once.
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"))
    table = materialize(source.mapInArrow(_table_of_sets, "doc_id long, row long, node long, n_shingles long, spare0 long, spare1 long, bits binary"), "sets")
    total = table.agg(F.sum("n_shingles")).first()[0] or 0
    cores = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    parts = int(max(1, total // PART_SHINGLES, min(cores, total // 200_000)))
    packed = source.select("text").mapInArrow(_packed_keys(parts), _PACKED)
    matched = materialize(packed.groupBy("p").applyInArrow(_match, _MATCH), "matched")
    large = materialize(table.where("n_shingles > 2").groupBy("node").agg(F.max("bits").alias("bits"), F.max("n_shingles").alias("n"), F.max("spare0").alias("spare0"), F.max("spare1").alias("spare1")), "large")
    bits = large.select("node", "bits", "n")

    # a membership may stand here more than once: it is told once when allowances are counted
    members = matched.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("key"), "segment")
    degree = members.groupBy("node").agg(F.count("*").alias("degree"))
    members = materialize(members.join(degree, "node"), "members")
    _, pairs = _stars(members)
    pairs = materialize(plausible(matched.where("kind = 0").select("a", "b").union(pairs).distinct(), bits), "pairs")
    comps = components(verified(pairs, _fetched(_ends(pairs).distinct(), table, source)))

    short = materialize(_short(large.select("node", "spare0", "spare1"), members, comps), "short")
    sets = _fetched(short.select("node"), table, source)
    # from here on only these nodes take part
    bits = materialize(bits.join(short.select("node"), "node", "left_semi"), "bits")
    left, merged = members.join(short, "node", "left_semi"), False
    for _ in range(ROUNDS):
        left = materialize(_label(left, comps), "left")
        best, pairs = _stars(left)
        pairs = materialize(plausible(_across(pairs, comps), bits), "pairs")
        found = materialize(verified(pairs, sets), "links")
        if found.isEmpty():
            break
        comps, merged = components(found.union(comps.select("node", "root"))), True
        # what each key has outside its centre's component
        at = _label(best.select(F.col("centre").alias("node"), "key"), comps).select("key", F.col("root").alias("past"))
        left = _label(left.drop("root"), comps).join(at, "key").where("root <> past").drop("root", "past")
        left = materialize(left, "left")
        if left.isEmpty():
            break

    if merged:
        short = materialize(_short(short, members, comps), "short")
    rest = materialize(plausible(_short_pairs(sets.join(short, "node", "left_semi"), comps), bits), "rest")
    found = materialize(verified(rest, sets), "links")
    if not found.isEmpty():
        comps = components(found.union(comps.select("node", "root")))

    # Ids meet by node first, then by component: only nodes that have links go on to the second step.
    own = materialize(table.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("own")), "own")
    linked = comps.select("node", "root").union(comps.select("root", "root").distinct())
    least = materialize(own.join(linked, "node").groupBy("root").agg(F.min("own").alias("least")), "least")
    linked = materialize(linked.join(least, "root").select(F.col("node").alias("_n"), "least"), "linked")
    own = own.join(linked, F.col("node") == F.col("_n"), "left").select(F.col("node").alias("_n"), F.coalesce("least", "own").alias("least"))
    return materialize(table.select("doc_id", "node", "n_shingles"), "result", keep=True), materialize(own, "result", keep=True)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
