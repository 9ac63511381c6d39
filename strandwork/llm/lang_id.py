"""Language identification by a byte convolutional network, trained and applied in numpy.

A window of LENGTH bytes is embedded, filters of several widths slide over it, each filter's
maximum is pooled and a softmax layer turns the maxima into language probabilities. A text
is cut into windows end to end, and its probabilities are the mean over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.support import bounded_batches, crc_mod, whole_text
from strandwork.llm.text_kernel import buffers

LENGTH = 192
EMBED = 8
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Windows that go through the network at once.
BATCH = 512
#: The largest number of languages that can be told apart; the training sample is bounded by it.
MAX_LANGUAGES = 512


@dataclass
class ByteNet:
    """Weights: filters narrower than the widest have zeros beyond their width."""

    languages: list[str]
    embed: np.ndarray  # 256 x EMBED
    conv: np.ndarray  # widest * EMBED x filters
    conv_bias: np.ndarray
    out: np.ndarray  # filters x languages
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int) -> ByteNet:
        rng, n, wide = np.random.default_rng(seed), FILTERS * len(WIDTHS), max(WIDTHS)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        net = cls(languages, normal(256, EMBED, scale=0.5), normal(wide * EMBED, n, scale=0.3), np.zeros(n, np.float32), normal(n, len(languages), scale=0.3), np.zeros(len(languages), np.float32))
        net.embed[0] = 0  # padding
        net.conv *= net.within()
        return net

    @staticmethod
    def within() -> np.ndarray:
        return np.concatenate([np.repeat(np.arange(max(WIDTHS)) < w, EMBED)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1).astype(np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.conv_bias, self.out, self.out_bias]

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """Embedded bytes of every filter position, one row a position."""
        wide = max(WIDTHS)
        padded = np.pad(windows, ((0, 0), (0, wide - 1)))
        x = self.embed[padded].reshape(len(windows), -1)
        shape, step = (len(windows), LENGTH, wide * EMBED), x.strides
        return np.lib.stride_tricks.as_strided(x, shape, (step[0], step[1] * EMBED, step[1])).reshape(-1, wide * EMBED)

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, ...]:
        """(probabilities, pooled maxima, positions of the maxima, columns)."""
        columns = self.columns(windows)
        maps = (columns @ self.conv).reshape(len(windows), LENGTH, -1)
        at = maps.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(maps, at[:, None], 1)[:, 0] + self.conv_bias, 0)
        return self.softmax(pooled), pooled, at, columns

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for lo in range(0, len(windows), BATCH):
            x = windows[lo : lo + BATCH]
            maps = (self.columns(x) @ self.conv).reshape(len(x), LENGTH, -1)
            out[lo : lo + BATCH] = self.softmax(np.maximum(maps.max(axis=1) + self.conv_bias, 0))
        return out

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        p, pooled, at, columns = self.forward(windows)
        n, wide = len(windows), max(WIDTHS)
        dz = p.copy()
        dz[np.arange(n), labels] -= 1
        dz /= n
        d_pooled = (dz @ self.out.T) * (pooled > 0)
        rows = at + np.arange(n)[:, None] * LENGTH  # the column row of each window's and filter's maximum
        picked = columns[rows]  # window x filter x (wide * EMBED)
        d_conv = np.einsum("nfc,nf->cf", picked, d_pooled) * self.within()
        d_columns = (d_pooled[:, :, None] * self.conv.T[None]).reshape(n, -1, wide, EMBED)
        padded = np.pad(windows, ((0, 0), (0, wide - 1)))
        bytes_ = padded[np.arange(n)[:, None, None], at[:, :, None] + np.arange(wide)]
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, bytes_.ravel(), d_columns.reshape(-1, EMBED))
        d_embed[0] = 0
        return [d_embed, d_conv, d_pooled.sum(axis=0), pooled.T @ dz, dz.sum(axis=0)]

    def fit(self, windows: np.ndarray, labels: np.ndarray, passes: int, seed: int, rate: float = 0.004, batch: int = 64) -> None:
        """Adam over shuffled batches; classes count alike."""
        rng, share = np.random.default_rng(seed), np.bincount(labels, minlength=len(self.languages))
        draw = (1 / share[labels]) / (1 / share[labels]).sum()
        mean, square, t = [np.zeros_like(w) for w in self.weights()], [np.zeros_like(w) for w in self.weights()], 0
        for _ in range(passes * max(1, len(labels) // batch)):
            pick, t = rng.choice(len(labels), min(batch, len(labels)), p=draw), t + 1
            for w, g, m, v in zip(self.weights(), self.gradients(windows[pick], labels[pick]), mean, square, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def cut_windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(windows end to end, the last padded with zeros; windows of each value) of a binary array."""
    data, offsets = buffers(column)
    sizes = np.diff(offsets)
    n = -(-sizes // LENGTH)
    out = np.zeros((int(n.sum()), LENGTH), np.uint8)
    first = np.cumsum(n) - n
    at = np.arange(len(data)) + np.repeat(first * LENGTH - offsets[:-1], sizes)
    out.reshape(-1)[at] = data
    return out, n


def _sample_windows(each: int):
    """Windows spread evenly over each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, n = cut_windows(batch.column("t"))
            first = np.cumsum(n) - n
            rows = [(lang, windows[f + k * c // min(each, c)].tobytes()) for lang, f, c in zip(batch.column("lang").to_pylist(), first, n, strict=True) if c for k in range(min(each, c))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.binary())], names=["lang", "window"])

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", *, per_language: int = 800, windows: int = 4, passes: int = 4, seed: int = 1) -> ByteNet | None:
    """A network from at most per_language texts of each language and at most windows of each; None without any.

    The sample is bounded whatever repeats: of each language and each of per_language hash
    classes of id and text, the row with the least hash, once. Rows without language or letters
    don't count. A sample that only more than MAX_LANGUAGES languages can give is an error.
    Of a text of any length the sampled windows are spread over the whole.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    order = F.xxhash64(F.lit(seed), id_col, text)
    least = known.groupBy(F.col(lang).alias("__lang"), F.pmod(order, F.lit(per_language)).alias("__class")).agg(F.min(order).alias("__order"))
    picks = least.limit(per_language * MAX_LANGUAGES + 1).toArrow()
    if picks.num_rows > per_language * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not picks.num_rows:
        return None
    picks = docs.sparkSession.createDataFrame(picks.select(["__lang", "__order"]))
    found = known.join(F.broadcast(picks), (F.col(lang) == F.col("__lang")) & (order == F.col("__order")))
    bounded_batches(docs.sparkSession)
    found = found.select(F.col(lang).alias("lang"), "__order", whole_text(text).cast("binary").alias("t")).dropDuplicates(["lang", "__order"])
    rows = found.select("lang", "t").mapInArrow(_sample_windows(windows), "lang string, window binary").toArrow().sort_by([("lang", "ascending"), ("window", "ascending")])
    languages, label = np.unique(np.array(rows.column("lang").to_pylist(), object), return_inverse=True)
    languages, data = languages.tolist(), buffers(rows.column("window"))[0].reshape(-1, LENGTH)
    net = ByteNet.fresh(languages, seed)
    net.fit(data, label, passes, seed)
    return net


def predict(docs: DataFrame, net: ByteNet | None, text: str = "text", unknown: str = "und") -> DataFrame:
    """docs with lang_pred and score (0 to 1) added; columns of those names are replaced.

    A text that is null or has no letter, and any text without a network, gets unknown and
    score 0. Equal probabilities go to the language that sorts first. A text of any length is
    read whole, windows end to end. Repeated rows are predicted each; the text itself passes
    through unchanged. An empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("lang_pred string, score double")
    def judged(texts):
        import pandas as pd

        net = shared.value
        out = pd.DataFrame({"lang_pred": [unknown] * len(texts), "score": 0.0})
        lettered = np.array([x is not None for x in texts], bool)
        if net is None or not lettered.any():
            return out
        labels, scores = [], []
        for lo in range(0, int(lettered.sum()), 256):
            part = texts[lettered].iloc[lo : lo + 256]
            windows, n = cut_windows(pa.array(part.tolist(), pa.binary()))
            p = np.add.reduceat(net.predict(windows).astype(np.float64), np.cumsum(n) - n) / n[:, None]
            labels += [net.languages[i] for i in p.argmax(axis=1)]
            scores += np.clip(p.max(axis=1), 0, 1).tolist()
        out.loc[lettered, "lang_pred"], out.loc[lettered, "score"] = labels, scores
        return out

    lettered = F.when(F.col(text).rlike(r"\p{L}"), F.col(text).cast("binary"))
    names = docs.columns
    return docs.withColumn("__judged", judged(lettered)).select(*names, "__judged.lang_pred", "__judged.score")


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", *, fold: int = 2, folds: int = 4, **training) -> DataFrame:
    """docs with held_out, lang_pred and score; the network learns from rows whose crc32 of the id modulo folds is not fold."""
    held_out = crc_mod(id_col, folds) == fold
    net = train(docs.where(~held_out), id_col, text, lang, **training)
    return predict(docs.withColumn("held_out", held_out), net, text)
