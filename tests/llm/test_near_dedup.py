import itertools

import numpy as np
import pyarrow as pa
import pytest

from strandwork.llm import near_dedup as nd
from strandwork.llm.components import connected
from tests.llm.docs import DOCS, ROWS, clashing


def plain(rows, size=5, percent=75):
    """n_shingles and component by all pairs."""
    sets, ids = {}, {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        s = frozenset(tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset()
        ids.setdefault(i, []).append(s)
    top = {i: i for i in ids if i is not None}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(top, 2):
        for x, y in itertools.product(ids[a], ids[b]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                top[hi] = lo
    return {i: ([len(s) for s in ids[i]], root(i) if i is not None else None) for i in ids}


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], DOCS)
    got = nd.near_duplicates(clashing(df), **options).collect()
    want = plain(rows)
    assert len(got) == len(rows)
    for r in got:
        sizes, component = want[r.doc_id]
        assert r.n_shingles in sizes and r.component_id == component and r.kept == (r.doc_id == component)


def test_awkward_documents(spark):
    check(spark, [(r[0], r[1]) for r in ROWS])


def test_rows_that_repeat_an_id_with_other_texts_are_one_node(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    check(spark, [(3, a), (5, a), (5, b), (9, b), (9, c), (12, c), (20, c + " more"), (30, ""), (30, "x y"), (31, "x y"), (2, None), (40, "p q"), (40, "x y")])


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("cell", [nd.CELL, 7])
def test_a_large_group_of_near_copies_at_all_distances(spark, monkeypatch, cell):
    monkeypatch.setattr(nd, "CELL", cell)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for j in rng.choice(120, int(rng.integers(0, 14)), replace=False):
            words[j] = f"x{rng.integers(1000)}"
        rows.append((int(rng.permutation(1000)[0]) * 100 + i, " ".join(words)))
    rows += [(500_000 + i, " ".join(rng.choice(base, 60))) for i in range(20)]
    check(spark, rows)


def test_pruning_keeps_what_reaches_the_similarity():
    op = nd.NearDedup()
    needs = nd.least_matches(op)
    assert [n for n, _ in needs] == list(range(16, 129, 16)) and all(0 < m < n for n, m in needs[1:])
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**32, (2000, op.hashes), dtype=np.uint32)
    other = np.where(rng.random(base.shape) < 0.76, base, rng.integers(0, 2**32, base.shape, dtype=np.uint32))
    every = np.arange(2000)
    assert len(nd.survivors(base, other, every, every, needs)) == 2000
    assert len(nd.survivors(base, np.roll(base, 1, axis=0), every, every, needs)) == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 2000).astype(np.uint64)
    b = np.concatenate([a[:1600], rng.integers(0, 2**63, 400).astype(np.uint64)])
    sig = nd.signatures(np.concatenate([a, b]), np.array([0, 2000, 4000]), 512)
    assert abs((sig[0] == sig[1]).mean() - 1600 / 2400) < 0.08


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(200, 200)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 130)}}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketch_of_empty_values_only():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([b"", b" "], pa.binary())], names=["id", "t"])
    (out,) = nd._sketches(nd.NearDedup())(iter([batch]))
    assert out.column("n").to_pylist() == [0, 0]


def test_many_rows_of_one_id_and_of_one_text(spark):
    same = " ".join(f"w{i}" for i in range(40))
    rows = [(7, f"{same} v{i}") for i in range(60)] + [(7, same)] * 60 + [(3, same)] * 20 + [(2, f"other text {i} of id two") for i in range(60)] + [(9, "other text 5 of id two")]
    check(spark, rows)


def test_blocks_of_the_largest_group_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(nd, "CELL", 10)
    rows = spark.createDataFrame([(1, 0, i, 0 if i < 95 else i) for i in range(100)] + [(2, 1, i, i % 3) for i in range(8)], "key long, band int, id long, label long")
    cells = nd._cells(rows, spark.createDataFrame([(1, 100, (95, 0)), (2, 8, (3, 0))], "key long, m long, top struct<n:long,label:long>")).collect()
    sent = {}
    for r in cells:
        sent.setdefault((r.key, r.id), []).append((r.i, r.j, r.block))
    assert all(len(sent[1, i]) == 1 for i in range(95)) and all(len(sent[1, i]) == 11 for i in range(95, 100)) and all(sent[2, i] == [(0, 0, 1)] for i in range(8))
    for x, y in [(0, 97), (50, 99), (95, 96)]:
        assert len({c[:2] for c in sent[1, x]} & {c[:2] for c in sent[1, y]}) >= 1
