import collections
import math
import zlib

import numpy as np
import pytest

from strandwork.llm import lm_score as lm
from tests.llm.docs import DOCS, ROWS, clashing


def plain(rows, m, fold=2, folds=7, least=2):
    """Scores by counting and one walk per text that carries its state and follows failure arcs."""
    texts = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % folds == fold for i, _ in texts]
    words, pairs, triples = collections.Counter(), collections.Counter(), collections.Counter()
    for (_, t), h in zip(texts, held, strict=True):
        if not h:
            words.update(t)
            pairs.update(zip(["<s>", *t], t, strict=False))
            triples.update(zip(["<s>", *t], t, t[1:], strict=False))
    n, v = sum(words.values()), len(words)
    seen = {**{(w,): c for w, c in words.items()}, ("<s>",): held.count(False), **{p: c for p, c in pairs.items() if c >= least}}
    arcs = {**pairs, **triples}

    def p(w, state):
        if not state:
            return (words[w] + 1) / (n + v + 1)
        return (arcs.get((*state, w), 0) + m * p(w, state[1:])) / (seen[state] + m)

    def longest(state):
        while state and not seen.get(state):
            state = state[1:]
        return state

    out = []
    for (i, t), h in zip(texts, held, strict=True):
        state, score, base = longest(("<s>",)), 0.0, 0.0
        for w in t:
            base += math.log10(p(w, ()))
            at = state
            while at and not arcs.get((*at, w)):
                score += math.log10(m / (seen[at] + m))  # failure arc
                at = at[1:]
            score += math.log10(p(w, at))
            state = longest((*state[-1:], w))
        out.append((i, h, len(t), sum(words[w] > 0 for w in t), n, base, score))
    return out


@pytest.mark.parametrize("partitions", [1, 5])
def test_awkward_documents(spark, partitions):
    rng = np.random.default_rng(4)
    rows = ROWS + [(100 + i, f"word{i} word{i + 1} the end of it", None, None, None) for i in range(30)] + [(200 + i, " ".join(rng.choice(list("abcde"), 12)), None, None, None) for i in range(40)]
    got = lm.lm_scores(clashing(spark.createDataFrame(rows, DOCS).repartition(partitions)), m=4.0).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[6], 6))
    want = sorted(plain([(r[0], r[1]) for r in rows], 4.0), key=key)
    for a, b in zip(sorted(map(tuple, got), key=key), want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_empty_table_and_no_training_rows(spark):
    assert lm.lm_scores(spark.createDataFrame([], DOCS)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = lm.lm_scores(spark.createDataFrame([(held, "a b", None, None, 3)], DOCS)).collect()
    assert row.held_out and row.train_tokens == 0 and row.n_known == 0 and row.score == row.base_score == 0


def test_model_is_normalised(spark):
    """From any state, the probabilities of all words, the end and one unseen word sum to one."""
    train = [(i, t) for i, t in enumerate(["a b a b c", "a b c", "b a b", "c", "a b a"]) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(100, 2000) if zlib.crc32(str(i).encode()) % 7 == 2]
    # a text's own score without its end, for each history and next word
    histories, words = ["", "a", "a b", "b a", "c c", "zz", "zz a"], ["a", "b", "c", "unseen"]
    texts = [h for h in histories] + [f"{h} {w}".strip() for h in histories for w in words]
    rows = train + [(held[j], t) for j, t in enumerate(texts)]
    got = {r.doc_id: r.score for r in lm.lm_scores(spark.createDataFrame([(*r, None, None, None) for r in rows], DOCS), m=3.0).collect()}
    want = {i: s for i, *_, s in plain(rows, 3.0)}
    assert all(got[i] == pytest.approx(want[i], rel=1e-9) for i in got)

    def prefix(t):  # log10 probability of the words alone, by the plain model
        from_end = plain([*train, (held[0], t)], 3.0)[-1][-1]
        return from_end - ends[t]

    ends = {}
    for t in texts:
        tokens = t.split()
        probe = plain([*train, (held[0], t)], 3.0)[-1][-1]
        ends[t] = probe - sum_words(train, held[0], tokens)
    for h in histories:
        before = sum_words(train, held[0], h.split())
        total = 10 ** (got[held[texts.index(h)]] - before) + sum(10 ** (prefix(f"{h} {w}".strip()) - before) for w in words)
        assert total == pytest.approx(1, rel=1e-6)


def sum_words(train, i, tokens):
    """log10 probability of words without the end: the end's own cost is what a text with it has more than one cut before it."""
    import functools

    words, pairs, triples = collections.Counter(), collections.Counter(), collections.Counter()
    for _, t in train:
        t = [*t.encode().split(), None]
        words.update(t)
        pairs.update(zip(["<s>", *t], t, strict=False))
        triples.update(zip(["<s>", *t], t, t[1:], strict=False))
    n, v = sum(words.values()), len(words)

    @functools.cache
    def p(w, *state):
        if not state:
            return (words[w] + 1) / (n + v + 1)
        lower = p(w, *state[1:])
        if len(state) == 2:
            return (triples[(*state, w)] + 3.0 * lower) / (pairs[state] + 3.0) if pairs[state] >= 2 else lower
        seen = len(train) if state[0] == "<s>" else words[state[0]]
        return (pairs[(*state, w)] + 3.0 * lower) / (seen + 3.0) if seen else lower

    tokens = ["<s>", *(w.encode() for w in tokens)]
    return sum(math.log10(p(w, *tokens[max(0, j - 1) : j + 1])) for j, w in enumerate(tokens[1:]))


def test_blocks_close_at_their_size_and_keep_all_rows(spark, monkeypatch):
    rows = [(i, "w " * (i % 40), None, None, None) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS).coalesce(2)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(lm, "RANGES", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    got = lm.lm_scores(df, m=4.0).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {x[0]: x for x in plain([r[:2] for r in rows], 4.0)}
    assert len(got) == 300 and all(tuple(r)[:5] == want[r.doc_id][:5] and r.score == pytest.approx(want[r.doc_id][6], rel=1e-9) for r in got)


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for size in (0, 1, 1000):
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        assert (lm.unpack_sorted(lm.pack_sorted(a)) == a).all()
        b = lm._range_of(a, 7)
        assert b[0] == 0 and b[-1] == len(a) and (np.diff(b) >= 0).all()
