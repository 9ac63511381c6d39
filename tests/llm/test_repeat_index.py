import hashlib
from collections import Counter

import numpy as np
import pytest

from strandwork.llm import repeat_index as ri
from tests.llm.docs import DOCS, ROWS, clashing, doc


def plain(texts, length=200):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(c for c, x in zip(d, gone, strict=True) if not x)
        spans = sum(x and not (i and gone[i - 1]) for i, x in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, **options):
    got = ri.remove_repeats(clashing(spark.createDataFrame([doc(i, t) for i, t in rows], DOCS)), **options).collect()
    want = [(i, *x) for (i, _), x in zip(rows, plain([t for _, t in rows], options.get("op", ri.Repeats()).length), strict=True)]
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == sorted(want, key=str)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)
    return want


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_matching_statistics_are_the_longest_matches_elsewhere(letters):
    rng = np.random.default_rng(letters)
    texts = [rng.integers(0, letters, rng.integers(0, 40)).astype(np.uint8) for _ in range(12)]
    texts += [texts[0], np.concatenate((texts[1], texts[2])), np.zeros(9, np.uint8)]
    index, begins = ri.RunIndex.of(texts)
    found = index.statistics()
    raw = [t.tobytes() for t in texts]
    every = [r[i:] for r in raw for i in range(len(r))]
    for r, at in zip(raw, begins, strict=True):
        for i in range(len(r)):
            want = max((next((k for k, (x, y) in enumerate(zip(s, r[i:], strict=False)) if x != y), min(len(s), len(r) - i)) for j, s in enumerate(every) if j != sum(map(len, raw[: begins.tolist().index(at)])) + i), default=0)
            assert found[at + i] == want
    assert index.run.sum() == index.size and (index.char[1:] != index.char[:-1]).all()


def test_the_transform_of_copies_has_few_runs():
    one = np.random.default_rng(0).integers(0, 20, 500).astype(np.uint8)
    alone, copies = ri.RunIndex.of([one])[0], ri.RunIndex.of([one] * 50)[0]
    assert len(copies.run) < len(alone.run) + 120 < copies.size / 20


def test_fragments_hold_every_window_once_and_equal_windows_share_their_anchor(monkeypatch):
    monkeypatch.setattr(ri, "PIECE", 64)
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (0, 5, 8, 300, 30, 7, 20, 500, 3)] + [b"a" * 150]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    anchors: dict = {}
    seen = Counter()
    for of, v, g, at, n, twice in ri.fragments(data, offsets, 8, 3):
        for o, a, first, m, t in zip(of, v, at, n, twice, strict=True):
            own = [texts[o][i : i + 8] for i in range(first, first + m)]
            seen.update((int(o), i) for i in range(first, first + m))
            assert t or len(set(own)) == len(own)
            for w in own:
                assert anchors.setdefault(w, a) == a
    assert seen == Counter((o, i) for o, t in enumerate(texts) for i in range(len(t) - 7))


@pytest.mark.parametrize("op", [ri.Repeats(8, (3, 6, 8), 2), ri.Repeats(8, (3, 8), 1000), ri.Repeats(20, (5, 17, 20), 3)])
def test_equals_plain_search_with_hot_anchors(spark, op, monkeypatch):
    monkeypatch.setattr(ri, "BLOCK", 300)
    rng = np.random.default_rng(9)
    common = "".join(rng.choice(list("xyzé"), 30))
    rows = [(i, "".join(rng.choice(list("abcde"), rng.integers(0, 60))) + common[int(rng.integers(0, 8)) : int(rng.integers(12, 30))] * int(rng.integers(0, 3)) + "".join(rng.choice(list("abcde"), 9))) for i in range(150)]
    rows += [(500 + i, rows[i % 7][1]) for i in range(30)] + [(600, "q" * 90), (601, "ab" * 50), (602, "abc" * 5 + "q" * 12)]
    want = check(spark, rows, op=op)
    assert 0 < sum(w[2] for w in want) < sum(w[1] for w in want)


def test_awkward_documents(spark, monkeypatch):
    check(spark, [(r[0], r[1]) for r in ROWS])
    check(spark, [(1, "ü" * 100), (1, "ü" * 100), (2, "ü" * 99 + "x"), (None, "ab" * 300), (None, None)])
    monkeypatch.setattr(ri, "PIECE", 1000)
    check(spark, [(1, ROWS[6][1][:6000]), (2, "head " + ROWS[6][1][500:5000]), (3, "z" * 5000)])
    assert ri.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_passages_of_the_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert any(w[2] for w in check(spark, docs))
