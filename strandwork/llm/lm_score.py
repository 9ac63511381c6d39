"""Language-model scores by a weighted backoff automaton over smoothed n-grams.

The model has three orders with Dirichlet smoothing, so it needs counts only:

    P(w)      = (c(w) + 1) / (N + V + 1)
    P(w | v)  = (c(vw) + m * P(w)) / (c(v) + m)
    P(w | uv) = (c(uvw) + m * P(w | v)) / (c(uv) + m)

As an automaton, a pair uv that training has least times or more is a state, with an arc for
each w seen behind it, weighted log10 P(w | uv), and a failure arc, weighted
log10 m / (c(uv) + m), to the state of v. Each word seen in training (and the start of a
text) is a state with an arc per pair vw, weighted log10 P(w | v), and a failure arc, weighted
log10 m / (c(v) + m), to the empty state. The empty state's arcs are the words seen, with
log10 P(w); any other word costs log10 1 / (N + V + 1) there. An arc for w from a state
that ends in v leads to the state vw if there is one, else to w, else to the empty state. One
walk over a text carries its state from word to word and adds up the weights.

The model grows with the corpus and is nowhere held whole. Texts are packed into blocks
where they are read; each block asks for the counts of just the n-grams it holds, in ranges
of their 64-bit hashes, and tells its own training counts at the same time: words and pairs
first, then the triples behind pairs that are states. Whoever answers for a range adds the
counts of all blocks and answers each in the order it asked, so hashes travel once and one
way only. A block then builds the part of the automaton that its texts can reach and walks
them. A block sends a range one row, and no row for a range it has no n-gram in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.support import bounded_batches, crc_mod, whole_text, written
from strandwork.llm.text_kernel import buffers, mix64, window_hashes, word_hashes

START, END = (mix64(np.array([x], np.uint64))[0] for x in (0x57A7, 0xE0D))
#: Bytes of text in a block at which it is closed, and bytes of text whose n-grams a range answers for.
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 16 << 20
#: Ranges at least, so that small corpora are spread as well.
RANGES = 12
ASK = "gram int, range int, block long, hashes binary, counts binary"
TOLD = "gram int, range int, block long, counts binary, n long, v long"


def _pack(a: np.ndarray) -> bytes:
    """Integers with their bytes sorted by place, then compressed."""
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), "zstd", asbytes=True) if len(a) else b""


def _unpack(data: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    raw = pa.decompress(data, n * size, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    """Sorted 64-bit integers as their count and packed differences."""
    return len(a).to_bytes(8, "little") + _pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.cumsum(_unpack(data[8:], np.uint64, n), dtype=np.uint64)


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Bounds of each range in sorted hashes: range r holds the hashes whose upper half scales to r."""
    top = (hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    return np.searchsorted(top, np.arange(ranges + 1, dtype=np.uint64))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows packed into blocks, a row each: their ids, whether each is learnt from, sizes and texts."""
    held: list[pa.RecordBatch] = []
    first, number = TaskContext.get().partitionId() << 32, 0

    def closed() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        data, offsets = buffers(t.column("t"))
        ids, train, sizes = t.column("id").chunk(0), t.column("train").to_numpy(), np.diff(offsets)
        columns = [pa.array([first + number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([np.packbits(train).tobytes()]), pa.array([_pack(sizes)])]
        columns += [pa.array([len(data)]), pa.array([int(train.sum())]), pa.array([pa.compress(data.tobytes(), "zstd", asbytes=True)])]
        return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "train", "sizes", "size", "starts", "body"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(b.column("t").nbytes for b in held) >= BLOCK_BYTES:
                yield closed()
                held, number = [], number + 1
    if held:
        yield closed()


class Block:
    """The tokens of a block's texts and the distinct words, pairs and triples among them."""

    def __init__(self, texts: pa.Array, train: np.ndarray):
        words, offsets = word_hashes(texts)
        n = len(offsets) - 1
        # start, words, end of each text
        self.offsets = offsets + 2 * np.arange(n + 1)
        self.tokens = np.empty(int(self.offsets[-1]), np.uint64)
        is_start = np.zeros(len(self.tokens), bool)
        is_start[self.offsets[:-1]] = True
        is_end = np.zeros(len(self.tokens), bool)
        is_end[self.offsets[1:] - 1] = True
        self.tokens[is_start], self.tokens[is_end] = START, END
        self.tokens[~(is_start | is_end)] = words
        self.at = np.flatnonzero(~is_start)  # each token that is scored
        self.first = is_start[self.at - 1]  # those that open a text
        self.text = np.repeat(np.arange(n), np.diff(self.offsets) - 1)
        self.used = train[self.text]
        self.words, self.word_of = self._distinct(self.tokens[self.at])
        self.pairs, self.pair_of = self._distinct(window_hashes(self.tokens, 2)[self.at - 1])

    @classmethod
    def packed(cls, t: pa.Table) -> Block:
        """The block of a row of _blocks."""
        n = len(t.column("ids")[0])
        offsets = np.concatenate(([0], np.cumsum(_unpack(t.column("sizes")[0].as_py(), np.int64, n))))
        data = pa.decompress(t.column("body")[0].as_py(), t.column("size")[0].as_py(), "zstd")
        texts = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), data])
        return cls(texts, np.unpackbits(np.frombuffer(t.column("train")[0].as_py(), np.uint8), count=n).astype(bool))

    @staticmethod
    def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, of = np.unique(hashes, return_inverse=True)
        return known, of.astype(np.int32)

    def trained(self, of: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
        """How often each n-gram stands in the training texts; of: its number at each scored token, or at those given."""
        return np.bincount(of[self.used if at is None else self.used[at]], minlength=n).astype(np.uint32)

    def triples(self, pair_counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(scored tokens behind a pair that is a state, that pair, distinct triples, the triple at each)."""
        at = np.flatnonzero(~self.first)
        context = self.pair_of[at - 1]
        is_state = pair_counts[context] >= least
        at, context = at[is_state], context[is_state]
        return at, context, *self._distinct(window_hashes(self.tokens, 3)[self.at[at] - 2])


class BackoffAutomaton:
    """The states and arcs that a block's texts can reach."""

    def __init__(self, block: Block, counts: list[np.ndarray], triples: tuple[np.ndarray, ...], total: int, vocabulary: int, starts: int, m: float):
        self.block, self.m = block, m
        self.words, self.pairs, self.triples = (c.astype(np.float64) for c in counts)
        self.at, self.context, _, self.triple_of = triples
        self.p = (self.words + 1.0) / (total + vocabulary + 1.0)
        self.starts = float(starts)

    def walk(self) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, word log10 probability) of each text.

        The state before a token is the longest of its last two, one or no words that is a
        state, so the states of a left-to-right walk are known at once; a failure arc's and
        the next arc's weights add up to the backed-off probability.
        """
        b, m = self.block, self.m
        p = self.p[b.word_of]
        word = np.log10(p)
        before = np.empty(len(p))  # how often the word before, or the start, was seen
        before[b.first] = self.starts
        before[~b.first] = self.words[b.word_of[np.flatnonzero(~b.first) - 1]]
        known = before > 0
        p[known] = (self.pairs[b.pair_of[known]] + m * p[known]) / (before[known] + m)
        p[self.at] = (self.triples[self.triple_of] + m * p[self.at]) / (self.pairs[self.context] + m)
        n = len(b.offsets) - 1
        return np.bincount(b.text, np.log10(p), n), np.bincount(b.text, word, n)


def _rows(block: int, gram: int, hashes: np.ndarray, counts: np.ndarray, ranges: int) -> Iterator[tuple]:
    bounds = _range_of(hashes, ranges)
    for r in np.flatnonzero(np.diff(bounds)):
        cut = slice(bounds[r], bounds[r + 1])
        yield gram, int(r), block, pack_sorted(hashes[cut]), _pack(counts[cut])


def _asked(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table({c.split()[0]: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(zip(ASK.split(", "), kinds, strict=True))})


def _ask(ranges: int):
    """Words and pairs of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t = pa.Table.from_batches([batch.slice(i, 1)])
                block, number = Block.packed(t), t.column("block")[0].as_py()
                for gram, hashes, of in ((1, block.words, block.word_of), (2, block.pairs, block.pair_of)):
                    yield from _asked(list(_rows(number, gram, hashes, block.trained(of, len(hashes)), ranges))).to_batches()

    return run


def _answer(t: pa.Table) -> pa.Table:
    """Sums of a range, for each block in the order of its hashes; one row more, of block -1, with the range's totals."""
    gram, r = t.column("gram")[0].as_py(), t.column("range")[0].as_py()
    blocks = t.column("block").to_pylist()
    asked = [unpack_sorted(x) for x in t.column("hashes").to_pylist()]
    own = [_unpack(data, np.uint32, len(x)) for x, data in zip(asked, t.column("counts").to_pylist(), strict=True)]
    all_, of = np.unique(np.concatenate(asked), return_inverse=True)
    sums = np.bincount(of, np.concatenate(own), len(all_)).astype(np.uint64)
    told = [_pack(x) for x in np.split(sums[of], np.cumsum([len(x) for x in asked])[:-1])]
    k = len(blocks)
    columns = [[gram] * (k + 1), [r] * (k + 1), [*blocks, -1], [*told, b""], [*[0] * k, int(sums.sum())], [*[0] * k, int((sums > 0).sum())]]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table({c.split()[0]: pa.array(x, kind) for c, x, kind in zip(TOLD.split(", "), columns, kinds, strict=True)})


def _heard(told: pa.Table, gram: int, hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The counts of a block's n-grams from the ranges' answers."""
    out, bounds = np.zeros(len(hashes), np.uint64), _range_of(hashes, ranges)
    for g, r, data in zip(told.column("gram").to_pylist(), told.column("range").to_pylist(), told.column("counts").to_pylist(), strict=True):
        if g == gram:
            out[bounds[r] : bounds[r + 1]] = _unpack(data, np.uint64, int(bounds[r + 1] - bounds[r]))
    return out


def _ask_triples(ranges: int, least: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _asked([])
        block = Block.packed(t)
        at, _, triples, of = block.triples(_heard(told, 2, block.pairs, ranges), least)
        return _asked(list(_rows(t.column("block")[0].as_py(), 3, triples, block.trained(of, len(triples), at), ranges)))

    return run


def _score(ranges: int, least: int, total: int, vocabulary: int, starts: int, m: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            kinds = {"id": t.schema.field("ids").type.value_type, "train": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64()}
            return pa.table({k: pa.array([], kind) for k, kind in kinds.items()})
        block = Block.packed(t)
        words, pairs = _heard(told, 1, block.words, ranges), _heard(told, 2, block.pairs, ranges)
        triples = block.triples(pairs, least)
        score, base = BackoffAutomaton(block, [words, pairs, _heard(told, 3, triples[2], ranges)], triples, total, vocabulary, starts, m).walk()
        n = len(block.offsets) - 1
        n_known = np.bincount(block.text, (words > 0)[block.word_of], n).astype(np.int64)
        train = np.unpackbits(np.frombuffer(t.column("train")[0].as_py(), np.uint8), count=n).astype(bool)
        return pa.table({"id": t.column("ids").combine_chunks().flatten(), "train": pa.array(train), "n_tokens": pa.array(np.bincount(block.text, minlength=n), pa.int64()), "n_known": pa.array(n_known), "base": pa.array(base), "score": pa.array(score)})

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, fold: int = 2, folds: int = 7, m: float = 32.0, least: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    Tokens are the words of the whole text, of any length, A-Z lower-cased, and one end. The
    model learns from rows whose crc32 of the id's text modulo folds is not fold. base_score is
    the add-one word model's log10 probability, score the automaton's; least: how often a pair
    must be seen to be a state. Null and empty texts have the end as their only token; rows
    that repeat are scored and learnt from each. Other columns of docs are not read. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), (crc_mod(id_col, folds) != fold).alias("train"), whole_text(text).cast("binary").alias("t"))
    id_type = texts.schema["id"].dataType.simpleString()
    blocks = written(texts.mapInArrow(_blocks, f"block long, ids array<{id_type}>, train binary, sizes binary, size long, starts long, body binary"), "blocks")
    size, starts = (x or 0 for x in blocks.agg(F.sum("size"), F.sum("starts")).first())
    ranges = max(RANGES, -(-size // RANGE_BYTES))
    answer = lambda asked: asked.groupBy("gram", "range").applyInArrow(_answer, TOLD)
    told = written(answer(blocks.mapInArrow(_ask(ranges), ASK)), "counts")
    n, v = (x or 0 for x in told.where("block = -1 AND gram = 1").agg(F.sum("n"), F.sum("v")).first())
    told = told.where("block >= 0")
    by_block = lambda df: blocks.groupBy("block").cogroup(df.groupBy("block"))
    more = written(answer(by_block(told.where("gram = 2")).applyInArrow(_ask_triples(ranges, least), ASK)), "triples")
    scored = by_block(told.union(more.where("block >= 0"))).applyInArrow(_score(ranges, least, n, v, starts, m), f"id {id_type}, train boolean, n_tokens long, n_known long, base double, score double")
    return scored.select(
        F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score",
    )
