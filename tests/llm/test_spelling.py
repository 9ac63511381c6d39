import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.llm import spelling as sp
from tests.llm.docs import DOCS, ROWS, clashing, doc

LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def edits(word, letters):
    """All texts one inserted, deleted or replaced letter away."""
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            yield from (word[:i] + c + word[i + 1 :] for c in letters)


def plain(rows, op=sp.Spelling()):
    counts = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % op.hole == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= op.length and c >= op.count}
    letters, form, out = sorted(set("".join(n))), {}, {}
    for w in n:
        near = {x for x in edits(w, letters) if x in n and x != w}
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= op.factor * n[w] else None
        out[w] = len(near)
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], out[w], n[form[w]] if form[w] else None)
    return out


def check(spark, rows, **options):
    got = sp.spelling_variants(clashing(spark.createDataFrame([doc(i, t) for i, t in rows], DOCS)), **options).collect()
    want = plain(rows, options.get("op", sp.Spelling()))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    return want


def test_wavelet_tree_reports_every_point_of_a_range_once():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 64, 100):
        values = rng.permutation(n)
        ends = np.sort(rng.integers(0, n + 1, (200, 2)), axis=1), np.sort(rng.integers(0, n + 1, (200, 2)), axis=1)
        query, value = sp.WaveletTree(values).report(*ends[0].T, *ends[1].T)
        want = {(i, int(v)) for i in range(200) for v in values[ends[0][i, 0] : ends[0][i, 1]] if ends[1][i, 0] <= v < ends[1][i, 1]}
        assert len(query) == len(want) and set(zip(query.tolist(), value.tolist(), strict=True)) == want


@pytest.mark.parametrize("hot", [sp.HOT, 2, 0])
def test_near_words_of_a_small_alphabet_with_hot_halves(spark, hot):
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abé"), rng.integers(5, 9))) for _ in range(1500)} | {"a" * k for k in range(5, 40)}
    n = {w: int(rng.integers(3, 9)) for w in words}
    got = {r.word: (r.n_near, r.best_n, r.best) for r in sp.near_words(spark.createDataFrame(list(n.items()), "word string, n long"), hot, 3000).collect()}
    want = {}
    for w in words:
        if near := {x for x in edits(w, "abé") if x in n and x != w}:
            best = min(near, key=lambda x: (-n[x], x))
            want[w] = (len(near), n[best], best)
    assert got == want


def test_forms_roots_and_holes(spark):
    text = "Straße straße STRASSE strasse strase color colour color " * 5 + "colours colouurs ÀÉÎõü àéîõü Àéîõü ×÷×÷× "
    rows = [(i, text + "house " * (i % 7) + "hause " + "housed " * (i % 2)) for i in range(40)] + [(1, "color " * 30)]
    want = check(spark, rows)
    assert want["colours"][:2] == ("colour", "color") and want["strase"][0] == "strasse"
    check(spark, rows, op=sp.Spelling(hole=2, length=4, count=2, factor=3))


def test_awkward_documents(spark):
    check(spark, [(r[0], r[1]) for r in ROWS] * 3)
    check(spark, [(None, "words words words wordy wordy wordy"), (1, "abcde" * 4000), (2, "abcde" * 4000), (3, "abcde" * 4000), (4, "abcde" * 3999 + "abcd")])
    assert sp.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0


def test_words_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = sp.spelling_variants(docs).agg(F.count("*").alias("rows"), F.count("form").alias("forms"), F.sum("n_near").alias("near")).first()
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert (got.rows, got.forms, got.near) == (len(want), sum(w[0] is not None for w in want.values()), sum(w[3] for w in want.values()))
