"""Exact repeats of a fixed number of bytes, found in run-length compressed Burrows-Wheeler transforms.

1. Every window of op.length bytes has an anchor, the least of its hashed op.anchors[0]-byte
   strings; equal windows have equal anchors. A text's fragments are the stretches of windows
   with one anchor. Fragments of an anchor that occurs once in all texts can't repeat and go.
2. Equal fragments are one class, which weighs as much as it has copies. The texts of classes
   are dealt to blocks by their anchor, so all equal windows meet in one block.
3. A block's texts are indexed together: suffix order, transform, runs. For the rows at both
   ends of a run the text position is kept (the sampled run ends) with the length of the match
   to the neighbour outside the run. At all other positions a match goes on from the position
   before, one byte shorter: matching statistics come out of the samples in one stream along
   the text. Windows with a match of op.length bytes, or in a class of several, are repeated.
4. An anchor that more than op.hot classes share is not indexed: the texts of its classes go
   through the same steps with longer anchors, the last as long as a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.support import bounded_batches, id_bitmap, in_bitmap, whole_text, written
from strandwork.llm.text_kernel import buffers, byte_sums, inverse_powers, mix64

#: Window starts of a text that are looked at together, and bytes of a block on average.
PIECE, BLOCK = 1 << 18, 1 << 19
_AT_BITS = np.uint64(20)


@dataclass(frozen=True)
class Repeats:
    """length: bytes of a repeat; anchors: bytes of the anchors, step by step; hot: classes of an anchor that may meet in one block."""

    length: int = 200
    anchors: tuple[int, ...] = (64, 183, 200)
    hot: int = 1024


# ---- the index of a block


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; only suffixes that are still tied are sorted on. The last symbol must be unique."""
    n, bits = len(symbols), int(symbols.max()).bit_length()
    done = max(1, 62 // bits)
    key, longer = np.zeros(n, np.int64), np.concatenate((symbols, np.zeros(done, np.int64)))
    for j in range(done):
        key = key << bits | longer[j : j + n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    opens = np.concatenate(([True], key[1:] != key[:-1]))
    rank, at = np.empty(n, np.int64), np.arange(n)
    while True:
        start = np.flatnonzero(opens)
        rank[order[at]] = np.repeat(at[start], np.diff(np.append(start, len(at))))
        tied = ~opens
        tied[:-1] |= ~opens[1:]
        at = at[tied]
        if not len(at):
            return order
        own = order[at]
        key = rank[own] * n + rank[own + done]
        by = np.argsort(key, kind="stable")
        order[at], key = own[by], key[by]
        opens = np.concatenate(([True], key[1:] != key[:-1]))
        done *= 2


def match_lengths(data: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that data[a:] and data[b:] share, each up to the end of its text; left: bytes to that end at each position."""
    most = np.minimum(left[a], left[b])
    out, live, at = most.copy(), np.arange(len(a)), 0
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    while len(live):
        live = live[most[live] > at]
        x, y = a[live] + at, b[live] + at
        same = words[x] == words[y]
        differs = ~same.all(axis=1)
        stop = live[differs]
        out[stop] = np.minimum(most[stop], at + same[differs].argmin(axis=1))
        live, at = live[~differs], at + 8
    return out


@dataclass
class RunIndex:
    """Run-length compressed transform of texts: characters and lengths of the runs, samples at their first and last rows.

    head, tail: text positions of a run's first and last row; head_length, tail_length: of the
    match with the row before and the row behind the run.
    """

    char: np.ndarray
    run: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    head_length: np.ndarray
    tail_length: np.ndarray
    size: int

    @classmethod
    def of(cls, texts: list[np.ndarray]) -> tuple[RunIndex, np.ndarray]:
        """(index, where each text begins); a text is followed by an end that equals nothing."""
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        ends = begins + sizes
        data = np.zeros(int(ends[-1]) + 1, np.uint8)
        for t, at in zip(texts, begins, strict=True):
            data[at : at + len(t)] = t
        symbols = data.astype(np.int64) + len(texts) + 1
        symbols[ends] = np.arange(1, len(texts) + 1)
        order = suffix_order(symbols)
        before = symbols[order - 1]  # the transform; the first position is behind the last end
        new = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        last = np.append(new[1:], len(before)) - 1
        left = np.repeat(ends, sizes + 1) - np.arange(len(data))
        lengths = np.zeros((2, len(new)), np.int64)
        lengths[0, 1:] = match_lengths(data, left, order[new[1:]], order[new[1:] - 1])
        lengths[1, :-1] = lengths[0, 1:]  # the row behind a run is the next run's first
        return cls(before[new], last - new + 1, order[new], order[last], lengths[0], lengths[1], len(data)), begins

    def statistics(self) -> np.ndarray:
        """For each text position the length of its longest match elsewhere, streamed from the samples."""
        out, at = np.zeros(self.size, np.int64), np.arange(self.size)
        for sample, length in ((self.head, self.head_length), (self.tail, self.tail_length)):
            found, from_ = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int64)
            found[sample], from_[sample] = length, sample
            from_ = np.maximum.accumulate(from_)
            out = np.maximum(out, found[from_] - (at - from_))
        return np.maximum(out, 0)


def _spans(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], marked.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_MARKS = "v long, g long, spans array<struct<lo:int,hi:int>>"
_SPAN = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _indexed(op: Repeats):
    def run(block: pa.Table) -> pa.Table:
        data, offsets = buffers(block.column("t"))
        texts = [data[offsets[i] : offsets[i + 1]] for i in range(block.num_rows)]
        index, begins = RunIndex.of(texts)
        long = index.statistics() >= op.length
        rows, spans = [], []
        for i, (weight, text, at) in enumerate(zip(block.column("weight").to_pylist(), texts, begins, strict=True)):
            windows = len(text) - op.length + 1
            marked = np.ones(windows, bool) if weight > 1 else long[at : at + windows]
            if marked.any():
                rows.append(i)
                spans.append([{"lo": int(lo), "hi": int(hi)} for lo, hi in zip(*_spans(marked), strict=True)])
        own = block.select(["v", "g"]).take(pa.array(rows, pa.int64()))
        return pa.table([own.column("v").combine_chunks(), own.column("g").combine_chunks(), pa.array(spans, _SPAN)], ["v", "g", "spans"])

    return run


# ---- fragments


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of width values: of what precedes it in its block and of what follows in the one before."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], forth[width - 1 : width - 1 + n])


def fragments(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, v, g, at, n, twice) of the fragments of texts: anchor, digest, first byte, windows, and whether the anchor occurs twice in it.

    A text of more than PIECE windows is looked at in pieces, which may cut a fragment in two.
    """
    first = 0
    while first < len(offsets) - 1:
        to = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        for begin in range(offsets[first], offsets[to], PIECE if to == first + 1 else PIECE * 2):
            end = min(offsets[to], begin + PIECE + length - 1) if to == first + 1 else offsets[to]
            piece = data[begin:end]
            if len(piece) < length:
                break
            of = np.repeat(np.arange(first, to), np.diff(offsets[first : to + 1])) if to > first + 1 else np.full(len(piece), first)
            sums = byte_sums(piece)
            inverse = inverse_powers(len(piece))
            hashes = mix64((sums[anchor:] - sums[:-anchor]) * inverse[: len(piece) - anchor + 1])
            low = (np.uint64(1) << _AT_BITS) - np.uint64(1)
            least = _least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - anchor + 1)
            window = np.flatnonzero(of[: len(least)] == of[length - 1 :][: len(least)])  # within one text
            place = (least[window] & low).astype(np.int64)
            v = hashes[place]
            new = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (window[1:] != window[:-1] + 1)))) if len(v) else np.zeros(0, np.int64)
            last = np.append(new[1:], len(v))[: len(new)] - 1
            lo, n = window[new], window[last] - window[new] + 1
            g = mix64((sums[lo + n + length - 1] - sums[lo]) * inverse[lo] + n.astype(np.uint64))
            yield of[lo], v[new].view(np.int64), g.view(np.int64), begin + lo - offsets[of[lo]], n, place[new] != place[last]
        first = to


_FRAGMENT = "k0 long, k1 long, weight long, v long, g long, at int, n int, twice boolean"


def _fragments(op: Repeats, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, v, g, at, n, twice in fragments(*buffers(batch.column("t")), op.length, anchor):
                keys = batch.select(["k0", "k1", "weight"]).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(v), pa.array(g), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(twice)], names=["k0", "k1", "weight", "v", "g", "at", "n", "twice"])

    return run


def _cut(op: Repeats):
    """The texts (v, g, weight, t) of the classes that a text stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("t"))
            for row in range(batch.num_rows):
                want = batch.column("want")[row].values
                v, g, weight, at, n = (want.field(c) for c in ("v", "g", "weight", "at", "n"))
                parts = [data[offsets[row] + a : offsets[row] + a + m + op.length - 1].tobytes() for a, m in zip(at.to_pylist(), n.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([v, g, weight, pa.array(parts, pa.binary())], names=["v", "g", "weight", "t"])

    return run


def _repeats(texts: DataFrame, op: Repeats, level: int) -> DataFrame:
    """(k0, k1, lo, hi) of texts(k0, k1, weight, t): runs of window starts whose windows are repeated, in all texts and copies."""
    found = written(texts.mapInArrow(_fragments(op, op.anchors[level]), _FRAGMENT), "fragments")
    again = found.groupBy("v").agg(F.sum(F.col("weight") * (F.lit(1) + F.col("twice").cast("int"))).alias("times")).where("times > 1")
    held = written(found.join(again.select("v"), "v", "left_semi"), "held")
    whole = F.col("at"), F.col("at") + F.col("n")
    if op.anchors[level] == op.length:  # an anchor is a window
        return held.select("k0", "k1", whole[0].alias("lo"), whole[1].alias("hi"))
    classes = held.groupBy("v", "g").agg(F.sum("weight").alias("weight"), F.min(F.struct("k0", "k1", "at", "n")).alias("of"))
    wants = classes.groupBy("of.k0", "of.k1").agg(F.collect_list(F.struct("v", "g", "weight", "of.at", "of.n")).alias("want"))
    wants = written(wants, "wanted")
    near = in_bitmap(texts, "k1", id_bitmap(wants, "k1")).select("k0", "k1", "t")
    once = near.join(wants.hint("merge"), ["k0", "k1"]).dropDuplicates(["k0", "k1"]) if level == 0 else near.join(wants.hint("merge"), ["k0", "k1"])
    cut = written(once.select("t", "want").mapInArrow(_cut(op), "v long, g long, weight long, t binary"), "classes")
    hot = written(cut.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > op.hot).select("v"), "hot-anchors")
    some_hot = not hot.isEmpty()
    cold = cut.join(hot, "v", "left_anti") if some_hot else cut
    size = cut.agg(F.sum(F.octet_length("t") + 1)).first()[0] or 0
    bucket = F.pmod(F.xxhash64("v"), F.lit(max(1, -(-size // BLOCK)))).cast("int")
    marks = cold.select("v", "g", "weight", "t", bucket.alias("bucket")).groupBy("bucket").applyInArrow(_indexed(op), _MARKS)
    if some_hot:
        longer = cut.join(hot, "v", "left_semi").select(F.col("v").alias("k0"), F.col("g").alias("k1"), "weight", "t")
        finer = _repeats(longer, op, level + 1).groupBy(F.col("k0").alias("v"), F.col("k1").alias("g")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
        marks = marks.unionByName(finer)
    marks = written(marks, "marks")
    each = held.join(marks, ["v", "g"]).select("k0", "k1", "at", F.explode("spans").alias("span"))
    return each.select("k0", "k1", (F.col("at") + F.col("span.lo")).alias("lo"), (F.col("at") + F.col("span.hi")).alias("hi"))


_JUDGED = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _removed(op: Repeats):
    """Takes the bytes of repeated windows out of texts (id, t, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("t"))
            for row in range(batch.num_rows):
                text = data[offsets[row] : offsets[row + 1]]
                spans, edge = batch.column("spans")[row].values, np.zeros(len(text) + 1, np.int32)
                np.add.at(edge, spans.field("lo").to_numpy(), 1)
                np.add.at(edge, spans.field("hi").to_numpy() + (op.length - 1), -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = text[~gone].tobytes()
                out = [[len(text)], [int(gone.sum())], [len(_spans(gone)[0])]]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, 1), *(pa.array(x, pa.int64()) for x in out), pa.array([hashlib.sha256(kept).hexdigest()]), pa.array([kept], pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", op: Repeats = Repeats()) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of docs.

    Every byte of a string of op.length bytes that starts anywhere else in the texts, the same
    text included, is removed; n_spans counts the removed runs, kept is what is left, as
    bytes. Strings are judged on the input, overlaps count, and matches don't cross texts. Null
    texts are empty; a text under op.length bytes loses nothing; one of any length is read
    whole. Rows that repeat an id are texts of their own, equal or not, and so are rows without
    an id. Other columns of docs aren't read. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    whole = whole_text(text)
    no_id = F.lit(np.iinfo(np.int64).min)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole.cast("binary").alias("t"), F.coalesce(F.col(id_col).cast("long"), no_id).alias("k0"), F.xxhash64(whole).alias("k1"))
    long = rows.where(F.octet_length("t") >= op.length)
    found = _repeats(long.select("k0", "k1", F.lit(1).cast("long").alias("weight"), "t"), op, 0)
    marks = written(found.groupBy("k0", "k1").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    bitmap = id_bitmap(marks, "k1")
    maybe = in_bitmap(rows, "k1", bitmap).join(marks.hint("merge"), ["k0", "k1"], "left")
    sure = maybe.where("spans IS NOT NULL").select("id", "t", "spans").mapInArrow(_removed(op), _JUDGED)
    none = F.lit(0).cast("long")
    whole_rows = lambda x: x.select("id", F.octet_length("t").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("t", 256).alias("kept_sha256"), F.col("t").alias("kept"))
    clean = whole_rows(in_bitmap(rows, "k1", bitmap, without=True)).unionByName(whole_rows(maybe.where("spans IS NULL")))
    return sure.unionByName(clean).withColumnRenamed("id", id_col)
