"""Quality scores by logistic regression over hashed word n-grams, trained with FTRL-proximal.

n-grams run over the words as written and over their shapes (Aa, a, A!, 9 ...), so that
layout counts where words are rare. A text's score is the sparse dot product of its
n-gram frequencies with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.support import bounded_batches, crc_mod, whole_text
from strandwork.llm.text_kernel import _PIECE, _hash_spans, buffers, mix64, window_hashes, word_spans

LG_FEATURES = 18
#: Frequencies sum to this in each text, for each kind of n-gram.
SCALE = 8.0
_KINDS = mix64(np.arange(0xF0, 0xF8, dtype=np.uint64))


def _classes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[ord("a") : ord("z") + 1] = out[128:] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    return out


_CLASS = _classes()


def features(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """(feature number of each word for each kind of n-gram, offsets of each text's words).

    Kinds: words, word pairs, shapes, shape pairs, shape triples, and whether a word repeats
    the one before. n-grams that would run over a text's end use what follows, hashed apart.
    """
    data, offsets = buffers(column)
    counts = np.zeros(len(offsets) - 1, np.int64)
    kinds: list[list[np.ndarray]] = [[] for _ in range(6)]
    at = 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _PIECE, "right")) - 1)
        piece = data[offsets[at] : offsets[to]]
        starts, ends, n = word_spans(piece, offsets[at : to + 1] - offsets[at])
        counts[at:to] = n
        words = _hash_spans(piece, starts, ends, lower=False)
        # a shape keeps the first byte of each run of one class within a word
        shape = _CLASS[piece]
        keep = np.ones(len(piece), bool)
        keep[1:] = shape[1:] != shape[:-1]
        keep[starts] = True
        place = np.concatenate(([0], np.cumsum(keep)))
        shapes = _hash_spans(shape[keep], place[starts], place[ends], lower=False)
        last = np.cumsum(n) - 1
        last = last[n > 0]
        for kind, (source, size) in enumerate(((words, 1), (words, 2), (shapes, 1), (shapes, 2), (shapes, 3))):
            grams = source
            if size > 1:
                grams = window_hashes(np.append(source, np.zeros(size - 1, np.uint64)), size)
                for b in range(size - 1):  # those over the end are one feature
                    grams[last[last >= b] - b] = _KINDS[7]
            kinds[kind].append(mix64(grams ^ _KINDS[kind]) >> np.uint64(64 - LG_FEATURES))
        same = np.zeros(len(words), np.uint64)
        same[1:] = words[1:] == words[:-1]
        same[(np.cumsum(n) - n)[n > 0]] = 0
        kinds[5].append(mix64(same ^ _KINDS[5]) >> np.uint64(64 - LG_FEATURES))
        at = to
    return [np.concatenate(k).astype(np.int64) if k else np.zeros(0, np.int64) for k in kinds], np.concatenate(([0], np.cumsum(counts)))


class Ftrl:
    """Follow the regularised leader, proximal: weights are a closed form of the sums z and n."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bias_z = self.bias_n = 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.bias()
        g0 = _sigmoid(b + float(w @ x)) - label
        g = g0 * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g
        self.bias_z += g0 - ((self.bias_n + g0 * g0) ** 0.5 - self.bias_n**0.5) / self.alpha * b
        self.bias_n += g0 * g0


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _training(passes: int):
    """One task learns from the bounded sample, which comes in a fixed order, and returns the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, np.ndarray, int]] = []
        for batch in batches:
            kinds, offsets = features(batch.column("t"))
            for i, label in enumerate(batch.column("label").to_pylist()):
                own = slice(offsets[i], offsets[i + 1])
                at, times = np.unique(np.concatenate([k[own] for k in kinds]), return_counts=True)
                rows.append((at.astype(np.int32), (times * (SCALE / max(1, offsets[i + 1] - offsets[i]))).astype(np.float32), label))
        model, rng = Ftrl(1 << LG_FEATURES), np.random.default_rng(1)
        for _ in range(passes):
            for i in rng.permutation(len(rows)):
                model.learn(*rows[i])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary()), pa.array([float(model.bias())])], names=["weights", "bias"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", *, sample: int = 6000, passes: int = 5, seed: int = 1) -> tuple[np.ndarray, float]:
    """(weights, bias) from at most sample labelled rows of docs.

    labels has the id and quality; of repeated labels the least counts, nulls don't. The
    sample is bounded whatever repeats: in each of sample hash classes of the id, the least
    hash, and of documents with that id the text with the least hash.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    order = F.xxhash64(F.lit(seed), id_col)
    marked = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.min("quality") > 0).cast("int").alias("label"))
    least = marked.groupBy(F.pmod(order, F.lit(sample)).alias("class")).agg(F.min_by(id_col, order).alias("__id"), F.min_by("label", order).alias("label"))
    picks = least.select("__id", "label").limit(sample).toArrow()
    if not picks.num_rows:
        return np.zeros(1 << LG_FEATURES, np.float32), 0.0
    picks = F.broadcast(spark.createDataFrame(picks))
    texts = docs.select(order.alias("order"), F.col(id_col).alias("__doc"), whole_text(text).alias("t"))
    chosen = texts.join(picks, F.col("__doc") == F.col("__id")).groupBy("order", "label").agg(F.min(F.struct(F.xxhash64("t").alias("tie"), "t")).alias("of"))
    chosen = chosen.select("order", "label", F.col("of.t").cast("binary").alias("t"))
    got = chosen.repartition(1).sortWithinPartitions("order").mapInArrow(_training(passes), "weights binary, bias double").first()
    return np.frombuffer(got["weights"], np.float32), got["bias"]


def score(docs: DataFrame, weights: np.ndarray, bias: float, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted (1 from threshold on) added; columns of those names are replaced.

    Null and empty texts have no n-gram and get the bias alone; a text of any length counts
    whole. Repeated rows are scored each. An empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        weights, bias = shared.value
        kinds, offsets = features(pa.array(texts.tolist(), pa.binary()))
        each = sum(weights[k].astype(np.float64) for k in kinds)
        total = np.concatenate(([0.0], np.cumsum(each)))
        return pd.Series(_sigmoid(bias + SCALE * (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(1, np.diff(offsets))))

    out = docs.withColumn("score", scored(whole_text(text).cast("binary")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", *, fold: int = 0, folds: int = 5, **training) -> DataFrame:
    """docs with held_out, score and predicted; labels count only for rows whose crc32 of the id modulo folds is not fold."""
    held_out = crc_mod(id_col, folds) == fold
    weights, bias = train(docs, labels.where(~held_out), id_col, text, **training)
    return score(docs.withColumn("held_out", held_out), weights, bias, text)
