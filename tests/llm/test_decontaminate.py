import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.llm import decontaminate as dc
from strandwork.llm.text_kernel import rolling_hashes
from tests.llm.docs import DOCS, ROWS, clashing

ITEM = " ".join(f"q{i}" for i in range(40))


def tiles(doc, item, k):
    """Greedy string tiling over words, by trying every place."""
    in_doc, in_item = set(), set()
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in in_item and d + n not in in_doc:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        if best[0] < k:
            return len(in_item)
        in_item.update(range(best[1], best[1] + best[0]))
        in_doc.update(range(best[2], best[2] + best[0]))


@pytest.mark.parametrize("listed", [dc.LISTED, 0])
def test_tiling_marks_what_the_plain_form_marks(monkeypatch, listed):
    monkeypatch.setattr(dc, "LISTED", listed)
    rng = random.Random(2)
    for letters, k in (("abcde", 3), ("ab", 3), ("a", 4), ("abc", 2)):
        for _ in range(25):
            doc, item = ([rng.choice(letters) for _ in range(n)] for n in (40, 25))
            number = {x: np.uint64(ord(x) * 0x9E3779B97F4A7C15 % 2**64) for x in letters}
            d, i = (rolling_hashes(np.array([number[x] for x in words], np.uint64), k) for words in (doc, item))
            assert sum(dc.tiles_of(np.arange(len(d)), d, i, k)) == tiles(doc, item, k)
            hits = [(x, y) for x in range(len(doc) - k + 1) for y in range(len(item) - k + 1) if doc[x : x + k] == item[y : y + k]]
            assert (dc.tile(np.array(hits, np.int64).reshape(-1, 2), k) if hits else 0) == tiles(doc, item, k)


def test_rolling_hashes_are_one_for_each_window():
    rng = random.Random(3)
    words = [rng.choice("abcd") for _ in range(3000)]
    numbers = np.array([ord(x) * 0xBF58476D1CE4E5B9 % 2**64 for x in words], np.uint64)
    for size in (1, 2, 5, 9):
        pairs = set(zip((tuple(words[i : i + size]) for i in range(len(words) - size + 1)), rolling_hashes(numbers, size).tolist(), strict=True))
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert len(rolling_hashes(numbers[:3], 5)) == 0


def test_contamination_is_that_of_plain_tiling(spark):
    """Common phrases, repeated items, repetitive texts and rows that repeat: all pairs over the thresholds, and no others."""
    rng = random.Random(6)
    common = "this is what everyone says here and there".split()
    items = [(i, " ".join([*common, *(f"i{i}w{j}" for j in range(rng.randrange(3, 30))), *common])) for i in range(12)]
    items += [(20, " ".join(["again"] * 30)), (21, items[0][1]), (22, "four words are few"), (22, " ".join(f"n{j}" for j in range(9))), (23, " ".join(common)), (None, items[1][1])]
    texts = [" ".join([*common, *(f"t{i}w{j}" for j in range(10))]) for i in range(30)] + ["again " * 400, " ".join(common * 6)]
    for i in range(20):
        words = rng.choice(items)[1].split()
        cut = rng.randrange(len(words))
        texts.append(" ".join(["x", *words[cut:], "y", *words[: rng.randrange(cut + 1)]]))
    rows = [(i if i % 7 else None, t, None, None, None) for i, t in enumerate(texts)] * 2
    got = dc.contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = set()
    for i, t, *_ in rows:
        for item, body in items:
            words = body.split()
            n = tiles(t.split(), words, 5) if set(t.split()) & set(words) else 0
            if len(words) >= 5 and n >= len(words) / 2:
                want.add((i, item, n, len(words)))
    by_text = {(r.id, r.item, r.covered, r.item_words) for r in got}
    assert by_text == want and len(want) > 30 and len(got) == len({(r.id, r.digest, r.item) for r in got})


def test_reordered_passages_are_caught_and_clean_texts_left(spark):
    words = ITEM.split()
    swapped = " ".join(["lead", *words[20:], "between", *words[:20], "tail"])
    third = " ".join([*words[:13], *(f"o{i}" for i in range(60))])
    rows = [(100, ITEM, "en", "a", 0), (101, swapped.upper(), "en", "a", 0), (102, third, "en", "a", 0), (103, " ".join(reversed(words)), "en", "a", 0)]
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short"), (5, ITEM + " more")], "item_id long, text string")
    got = {r.doc_id: r for r in dc.judge_contamination(clashing(spark.createDataFrame(rows + ROWS, DOCS)), items.withColumn("id", F.lit(0))).collect()}
    assert len(got) == 4 + len({r[0] for r in ROWS})
    assert [got[i].contaminated for i in (100, 101, 102, 103)] == [True, True, False, False]
    assert got[100].item == 1 and got[100].n_items == 2 and got[100].coverage == 1.0 and got[101].coverage == 1.0
    assert not any(r.contaminated for i, r in got.items() if i not in (100, 101))


def test_long_excerpts_of_long_items_are_caught(spark):
    item = [f"q{i}" for i in range(300)]
    phrases = [w for i in range(12) for w in [*item[i * 20 : i * 20 + 6], f"o{i}"]]
    rows = [(i, " ".join(w), "en", "a", 0) for i, w in enumerate([["lead", *item[90:210], "tail"], item[10:59], item[10:60], phrases])]
    got = dc.judge_contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id: (r.contaminated, r.coverage) for r in got} == {0: (True, 0.4), 1: (False, 0.0), 2: (True, 50 / 300), 3: (False, 0.0)}


@pytest.mark.parametrize("empty", ["docs", "items"])
def test_empty_tables(spark, empty):
    docs = spark.createDataFrame(ROWS if empty == "items" else [], DOCS)
    items = spark.createDataFrame([] if empty == "items" else [(1, ITEM)], "item_id long, text string")
    got = dc.judge_contamination(docs, items).collect()
    assert len(got) == docs.count() and not any(r.contaminated for r in got)


def test_windows_stay_within_their_text():
    import pyarrow as pa

    hashes, inside, offsets = dc._windows(pa.array([b"a b c", b"", b"d e", b"f g h i"], pa.binary()), 3)
    assert np.flatnonzero(inside).tolist() == [0, 5, 6] and offsets.tolist() == [0, 3, 3, 5, 9] and len(hashes) == 7
