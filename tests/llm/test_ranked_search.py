import math
import re
from collections import Counter

import numpy as np
import pytest

from strandwork.llm import ranked_search as rs
from tests.llm.docs import DOCS, ROWS, clashing, doc

LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
ITEMS = "item_id long, text string, kept string"


def terms(text):
    return Counter(re.findall(rs.TERM, (text or "").translate(LOWER)))


def plain(rows, items, op=rs.Bm()):
    counts = [(i, terms(t)) for i, t in rows]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    w = {t: math.floor(op.unit * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    asked: dict = {}
    for i, t in items:
        if i is not None:
            asked[i] = asked.get(i, Counter()) + terms(t)
    out = []
    for item, query in asked.items():
        found = []
        for (i, c), n in zip(counts, sizes, strict=True):
            m = 100 - op.flat + (op.flat * n * n_docs) // max(1, n_terms)
            score = sum(q * w[t] * (op.scale * c[t] // (op.unit * c[t] + op.slope * m)) for t, q in query.items() if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(found)[: op.k], 1)]
    return sorted(out, key=str)


def check(spark, rows, items, **options):
    docs = clashing(spark.createDataFrame([doc(i, t) for i, t in rows], DOCS))
    got = rs.ranked_search(docs, spark.createDataFrame([(*x, "") for x in items], ITEMS), **options).collect()
    want = plain(rows, items, options.get("op", rs.Bm()))
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == want
    return want


@pytest.mark.parametrize(("shard", "cells"), [(1 << 14, 1 << 16), (7, 40)])
def test_equals_plain_scores_with_ties(spark, monkeypatch, shard, cells):
    monkeypatch.setattr(rs, "SHARD_DOCS", shard)
    monkeypatch.setattr(rs, "CELLS", cells)
    rng = np.random.default_rng(7)
    words = [f"w{int(i)}" for i in rng.zipf(1.3, 9000) % 300]
    rows = [(int(i), " ".join(words[k * 17 : k * 17 + 3 + k % 40])) for k, i in enumerate(rng.permutation(400))]
    rows += [(1000 + i, rows[i % 20][1]) for i in range(200)]  # ties
    items = [(i, " ".join(words[i * 29 : i * 29 + 2 + i % 30])) for i in range(40)]
    assert check(spark, rows, items)
    check(spark, rows, items, op=rs.Bm(k=3), block_terms=20)


def test_awkward_documents_and_items(spark):
    rows = [(r[0], r[1]) for r in ROWS]
    items = [(1, "one TWO two three"), (1, "word1 çødé"), (2, None), (3, "..."), (4, "unknown zebra"), (None, "one two"), (5, "w1x1 " * 50 + "solo"), (6, " ".join(f"word{i}" for i in range(60)) * 20)]
    check(spark, rows, items)
    assert check(spark, [], items) == [] and check(spark, rows, []) == [] and check(spark, [(1, None), (2, "")], items) == []


def test_documents_below_the_heaps_floor_are_not_scored():
    n = 4000
    at, doc = np.array([0, n, n + 12]), np.concatenate((np.arange(n), np.arange(0, n, n // 12)[:12]))
    shard = rs.Shard(at, doc, np.where(np.arange(n + 12) < n, 1, 100).astype(np.int64), np.arange(n))
    heaps = rs.Heaps(1, 10)
    scored = rs.wand(shard, np.array([[0, 1]]), np.array([[1, 1]]), heaps, np.array([0]))
    assert heaps.score.min() == 101 and scored == 3000  # all up to the tenth rare one, then rare ones alone
    late = rs.Shard(at, doc, shard.impact, np.arange(n) + n)
    assert rs.wand(late, np.array([[0, 1]]), np.array([[1, 1]]), heaps, np.array([0])) == 12  # pivots of the rare list alone
    assert sorted(heaps.id[0]) == list(range(0, n, n // 12))[:10]
