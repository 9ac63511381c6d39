import zlib

import numpy as np
import pyarrow as pa
import pytest

from strandwork.llm import lang_id, quality_model
from tests.llm.docs import DOCS, ROWS, clashing
from tests.llm.docs import LONG as LONG_TEXT

WORDS = {"xx": "alpha beta gamma delta", "yy": "über schön öfter größe", "zz": "niño señor años mañana"}


def corpus(n=240):
    rng = np.random.default_rng(5)
    return [(1000 + i, " ".join(rng.choice(WORDS[k].split(), int(rng.integers(4, 80)))), k, "s", None) for i in range(n) for k in [list(WORDS)[i % 3]]]


def test_language_of_held_out_and_awkward_texts(spark):
    docs = clashing(spark.createDataFrame(corpus() + ROWS, DOCS))
    got = lang_id.identify(docs, per_language=80, passes=6).collect()
    assert len(got) == 240 + len(ROWS)
    held = [r for r in got if r.held_out and r.doc_id and r.doc_id >= 1000]
    assert len(held) > 30 and np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (4, 5, 6)} == {"und"}


def test_language_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None, None, 9)], DOCS)
    (r,) = lang_id.identify(docs).collect()
    assert (r.lang_pred, r.score) == ("und", 0.0) and lang_id.identify(docs.limit(0)).count() == 0


def test_windows_cover_the_whole_text():
    texts = [b"", b"x" * lang_id.LENGTH, b"y" * (2 * lang_id.LENGTH + 3), None]
    windows, n = lang_id.cut_windows(pa.array(texts, pa.binary()))
    assert n.tolist() == [0, 1, 3, 0] and windows.shape == (4, lang_id.LENGTH)
    assert bytes(windows[1:].reshape(-1)).rstrip(b"\0") == texts[2]


def test_gradients_of_the_network():
    net = lang_id.ByteNet.fresh(["a", "b"], 3)
    net.embed, net.conv, net.out = (w.astype(np.float64) for w in (net.embed, net.conv, net.out))
    rng = np.random.default_rng(1)
    x, y = rng.integers(1, 256, (4, lang_id.LENGTH)).astype(np.uint8), np.array([0, 1, 1, 0])
    loss = lambda: -np.log(net.forward(x)[0][np.arange(4), y]).mean()
    grads = net.gradients(x, y)
    for w, g in zip((net.embed, net.conv, net.out), (grads[0], grads[1], grads[3]), strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = w[at]
        w[at] = old + 1e-5
        up = loss()
        w[at] = old - 1e-5
        assert (up - loss()) / 2e-5 == pytest.approx(g[at], rel=2e-2, abs=1e-6)
        w[at] = old


def labelled(n=300):
    rng = np.random.default_rng(7)
    docs = [(i, " ".join(f"{w}***" if i % 3 == 0 else w for w in rng.choice(WORDS["xx"].split(), 40)), None, None, None) for i in range(2000, 2000 + n)]
    return docs, [(i, int(i % 3 != 0), 0) for i in range(2000, 2000 + n)]


def test_quality_of_held_out_and_awkward_texts(spark):
    docs, labels = labelled()
    marks = spark.createDataFrame(labels + [(1, None, None), (None, 1, 0), (2000, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.quality_scores(clashing(spark.createDataFrame(docs + ROWS, DOCS)), marks).collect()
    assert len(got) == 300 + len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id and r.doc_id >= 2000]
    assert len(held) > 30
    assert min(r.score for r in held if r.doc_id % 3) > max(r.score for r in held if r.doc_id % 3 == 0)
    assert len({r.score for r in got if r.doc_id in (4, 5, 6)}) == 1


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_model.quality_scores(docs, none).collect()} == {0.5}
    assert quality_model.quality_scores(docs.limit(0), none).count() == 0


def test_features_stay_within_their_text():
    both, offsets = quality_model.features(pa.array([b"a b c", b"", b"x y"], pa.binary()))
    one, _ = quality_model.features(pa.array([b"a b c"], pa.binary()))
    assert all((b[:3] == o).all() for b, o in zip(both, one, strict=True)) and offsets.tolist() == [0, 3, 3, 5]


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "MAX_LANGUAGES", 2)
    df = spark.createDataFrame([(i, f"text {i}", f"l{i % 3}", None, None) for i in range(30)], DOCS)
    with pytest.raises(ValueError, match="more than 2 languages"):
        lang_id.train(df, per_language=1)


def test_samples_stay_bounded_when_ids_repeat(spark, monkeypatch):
    rows = [(None if i % 2 else 7, f"text {WORDS['xx']} number {i // 4 * 4}", "xx", None, None) for i in range(600)] + corpus(30)
    seen = []
    fit = lang_id.ByteNet.fit
    monkeypatch.setattr(lang_id.ByteNet, "fit", lambda self, data, labels, *a, **b: seen.append(labels) or fit(self, data, labels, *a, **b))
    net = lang_id.train(spark.createDataFrame(rows, DOCS), per_language=5, windows=2, passes=1)
    assert net.languages == ["xx", "yy", "zz"] and all(1 <= n <= 10 for n in np.bincount(seen[0])) and np.bincount(seen[0])[0] >= 4

    docs = spark.createDataFrame([(i % 4, f"words of row {i // 8 * 8}", None, None, None) for i in range(800)], DOCS)
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(4)], "doc_id long, quality int, toxic int")
    read = [quality_model.train(frame, marks, passes=1) for frame in (docs, docs.repartition(5))]
    assert (read[0][0] == read[1][0]).all() and read[0][1] == read[1][1]

    def counting(passes):
        return lambda batches: iter([pa.RecordBatch.from_arrays([pa.array([b"\0" * 4]), pa.array([float(sum(b.num_rows for b in batches))])], names=["weights", "bias"])])

    monkeypatch.setattr(quality_model, "_training", counting)
    assert quality_model.train(docs, marks)[1] == 4


def test_network_is_that_of_plain_loops():
    net = lang_id.ByteNet.fresh(["a", "b", "c"], 4)
    rng = np.random.default_rng(2)
    net.conv_bias[:], net.out_bias[:] = rng.normal(size=net.conv_bias.shape), rng.normal(size=3)
    windows = rng.integers(1, 256, (3, lang_id.LENGTH)).astype(np.uint8)
    windows[2, 100:] = 0
    got = net.predict(windows)
    for w, p in zip(windows, got, strict=True):
        pooled = []
        for f in range(lang_id.FILTERS * len(lang_id.WIDTHS)):
            width = lang_id.WIDTHS[f // lang_id.FILTERS]
            kernel = net.conv[: width * lang_id.EMBED, f].reshape(width, lang_id.EMBED)
            sums = [sum(float(net.embed[w[i + j]] @ kernel[j]) for j in range(width) if i + j < len(w)) for i in range(len(w))]
            pooled.append(max(0.0, max(sums) + net.conv_bias[f]))
        z = np.exp(np.array(pooled) @ net.out + net.out_bias)
        assert p == pytest.approx(z / z.sum(), abs=1e-4)
    (one,) = net.forward(windows)[:1]
    assert one == pytest.approx(got, abs=1e-5)


def test_ftrl_is_that_of_a_plain_loop():
    import math

    model, rng = quality_model.Ftrl(6, alpha=0.4, beta=0.9, l1=0.05, l2=0.3), np.random.default_rng(3)
    z, n, bz, bn = [0.0] * 6, [0.0] * 6, 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= 0.05 else -(z[i] - math.copysign(0.05, z[i])) / ((0.9 + math.sqrt(n[i])) / 0.4 + 0.3)

    for _ in range(200):
        at = sorted(rng.choice(6, 3, replace=False))
        x, label = rng.random(3), int(at[0] == 0)
        model.learn(np.array(at), x, label)
        bias = -bz / ((0.9 + math.sqrt(bn)) / 0.4)
        w = [weight(i) for i in at]
        error = 1 / (1 + math.exp(-(bias + sum(a * b for a, b in zip(w, x))))) - label
        for i, a, b in zip(at, w, x):
            g = error * b
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.4 * a
            n[i] += g * g
        bz += error - (math.sqrt(bn + error * error) - math.sqrt(bn)) / 0.4 * bias
        bn += error * error
    assert model.weights() == pytest.approx([weight(i) for i in range(6)]) and model.bias() == pytest.approx(-bz / ((0.9 + math.sqrt(bn)) / 0.4))
    assert any(w == 0 for w in model.weights()) or abs(model.weights()).max() > 0.1


def test_scores_are_plain_sparse_dot_products(spark):
    import collections
    import math

    texts = [" ".join(np.random.default_rng(i).choice("Ab cd9 Ef! ab ... XY über".split(), 3 + 5 * i)) for i in range(12)] + ["", None, "one", LONG_TEXT]
    rng = np.random.default_rng(8)
    weights = (rng.normal(size=1 << quality_model.LG_FEATURES) * (rng.random(1 << quality_model.LG_FEATURES) < 0.5)).astype(np.float32)
    rows = quality_model.score(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS), weights, 0.2).collect()
    for r in rows:
        kinds, _ = quality_model.features(pa.array([(r.text or "").encode()], pa.binary()))
        counts = collections.Counter(int(f) for k in kinds for f in k)
        words = len((r.text or "").split())
        dot = sum(c * quality_model.SCALE / words * float(weights[f]) for f, c in counts.items()) if words else 0.0
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-500, min(500, 0.2 + dot)))), rel=1e-6)


def test_features_are_one_for_each_plain_ngram():
    import itertools
    import re

    words = "Ab ab Ab cd9 Ef! Ab cd9 Ab Ab".split()
    kinds, _ = quality_model.features(pa.array([" ".join(words).encode()], pa.binary()))

    def shape(w):
        return "".join(k for k, _ in itertools.groupby(re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", w)))))

    shapes = [shape(w) for w in words]
    for k, (source, size) in enumerate(((words, 1), (words, 2), (shapes, 1), (shapes, 2), (shapes, 3))):
        grams = [tuple(source[i : i + size]) if i + size <= len(source) else "end" for i in range(len(source))]
        pairs = set(zip(grams, kinds[k].tolist(), strict=True))
        assert len(pairs) == len(set(grams)) == len(set(kinds[k].tolist()))
    assert [a == b for a, b in zip(kinds[5], kinds[5][1:])] == [(words[i + 1] == words[i]) == (i > 0 and words[i] == words[i - 1]) for i in range(len(words) - 1)]
