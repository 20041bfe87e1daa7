import numpy as np
import pyarrow as pa

from gridloom.llm import ngram_join as nj


def _batches(texts):
    return [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 50])], ["text"]) for i in range(0, len(texts), 50)]


def _sent(texts, parts):
    return pa.Table.from_batches(list(nj._packed_keys(parts)(iter(_batches(texts)))))


def _texts():
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = [" ".join(words[rng.integers(0, 5000, n)]) for n in rng.integers(5, 900, 120)]
    return texts + [t + " end" for t in texts[:60]] + [texts[0] + f" tail{i}" for i in range(30)]


def test_packed_keys_take_under_7_bytes_and_come_back():
    texts = _texts()
    table = _sent(texts, 3)
    count = sum(len(x.as_py()) // 4 for x in table["keys"])
    assert sum(len(x.as_py()) for name in table.column_names[1:-1] for x in table[name]) < 7 * count
    sets, at = nj.shingle_sets(*nj.vt.buffers(pa.array(texts)))
    want = set()
    nodes = nj.nodes_of(sets, at)
    for role in (0, 1):
        keys, owner, segment, _ = nj.segment_keys(sets, at, role)
        want |= set(zip(keys.astype(np.uint32).tolist(), nodes[owner].tolist(), (2 * segment + role).tolist(), strict=True))
    got, many = set(), sum(len(x.as_py()) for x in table["members"]) // 24
    for p in range(3):
        own = table.filter(pa.compute.equal(table["p"], p))
        uniq, local = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in own["nodes"]]), return_inverse=True)
        for piece in range(4):
            both, segment = nj._keys(own, local, piece, 4)
            got |= set(zip((both >> np.uint64(32)).tolist(), uniq[(both & np.uint64(0xFFFFFFFF)).astype(np.int64)].tolist(), segment.tolist(), strict=True))
    assert got <= want and len(want) - len(got) <= many


def test_matches_are_the_same_in_pieces(monkeypatch):
    table = _sent(_texts(), 1)
    whole = nj._match(table)
    monkeypatch.setattr(nj, "PIECE_KEYS", 5000)
    pieces = nj._match(table)
    rows = lambda t: sorted(zip(*(t[c].to_pylist() for c in t.column_names), strict=True))
    assert whole.num_rows > 500 and rows(whole) == rows(pieces)
