"""Ranked lexical search: WAND over document shards, the shards' heaps merged.

1. One pass cuts the documents into shards of bounded size where they are read: for each
   shard the postings (document, occurrences) of the queries' terms, term by term in the
   order of documents, and the documents' lengths. Nothing is shuffled.
2. Counts over all documents give the terms' weights and the mean length.
3. Each shard is searched for all queries at once. A query's lists are kept in the order of
   the documents they stand at; the pivot is the first list at which the greatest impacts so
   far could reach the least score in the query's heap. Documents before the pivot's can't,
   and lists skip them by binary search. Heaps go on from shard to shard of a task.
4. The heaps of all tasks are merged, in two steps.

Queries are taken in blocks of bounded size, so what is broadcast doesn't grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from strandwork.llm.support import bounded_batches, whole_text, written
from strandwork.llm.text_kernel import buffers, word_hashes

_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents and postings of a shard, whichever is reached first; one document may have more postings.
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 20
#: Terms of a block of queries on average, and bytes of text that are cut into terms at once.
BLOCK_TERMS, PART = 1 << 16, 1 << 20
#: Cells (queries times terms) of the table that is searched in step.
CELLS = 1 << 16


@dataclass(frozen=True)
class Bm:
    """The fixed values of the score: k of k results; 100 - flat + flat * n * N div L is a document's m."""

    k: int = 10
    flat: int = 75
    scale: int = 1_000_000_000
    unit: int = 1000
    slope: int = 8

    def weight(self, n_docs: int, df: np.ndarray) -> np.ndarray:
        return np.floor(self.unit * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)

    def norm(self, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
        return 100 - self.flat + self.flat * n * n_docs // n_terms

    def impact(self, w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return w * (self.scale * tf // (self.unit * tf + self.slope * m))


@dataclass
class Shard:
    """Postings of the query terms: those of term t are doc[at[t]:at[t+1]], ascending, with their impacts."""

    at: np.ndarray
    doc: np.ndarray
    impact: np.ndarray
    ids: np.ndarray

    def __post_init__(self):
        own = np.diff(self.at)
        self.most = np.zeros(len(own), np.int64)
        full = np.flatnonzero(own)
        if len(full):
            self.most[full] = np.maximum.reduceat(self.impact, self.at[full])
        self.wide = len(self.ids) + 1  # more than any document's number
        self.key = np.repeat(np.arange(len(own)), own) * self.wide + self.doc  # ascending over all postings

    def seek(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Place of the first posting of each term at or behind a document; at[term + 1] if none is."""
        return np.searchsorted(self.key, term * self.wide + doc)


class Heaps:
    """The k best (score, id) of each query, worst first by score; of equal scores the least ids stay."""

    def __init__(self, queries: int, k: int):
        self.score = np.zeros((queries, k), np.int64)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.full = np.zeros((queries, k), bool)

    def floor(self) -> np.ndarray:
        """The least score that can still enter each heap; equal scores may, as ids decide."""
        return np.maximum(self.score.min(axis=1), 1)

    def push(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """One (score, id) for each of distinct queries; scores are over 0."""
        own, of = self.score[query], self.id[query]
        low = own.min(axis=1)
        worst = np.where(own == low[:, None], of, np.iinfo(np.int64).min).argmax(axis=1)
        lane = np.arange(len(query))
        better = (score > low) | (score == low) & (ids < of[lane, worst])
        query, worst = query[better], worst[better]
        self.score[query, worst], self.id[query, worst], self.full[query, worst] = score[better], ids[better], True


def wand(shard: Shard, terms: np.ndarray, times: np.ndarray, heaps: Heaps, rows: np.ndarray) -> int:
    """Searches a shard for queries in step, a pivot of each a round; how many documents were scored.

    terms and times: queries x terms, padded with times 0; rows: the queries' places in heaps.
    """
    most = shard.most[terms] * times
    cursor, end = shard.at[terms], shard.at[terms + 1]
    end = np.where(most > 0, end, cursor)  # a list without impact is never read
    floor = heaps.floor()[rows]
    live, scored, last = np.flatnonzero((cursor < end).any(axis=1)), 0, shard.wide - 1
    while len(live):
        own, stop = cursor[live], end[live]
        here = np.where(own < stop, shard.doc[np.minimum(own, len(shard.doc) - 1)], last)
        order = np.argsort(here, axis=1, kind="stable")
        sums = np.cumsum(np.take_along_axis(most[live], order, 1) * (np.take_along_axis(here, order, 1) < last), axis=1)
        reach = sums >= floor[live, None]
        found = reach[:, -1]
        live, own, stop, here, order, reach = live[found], own[found], stop[found], here[found], order[found], reach[found]
        if not len(live):
            break
        lane = np.arange(len(live))
        pivot = here[lane, order[lane, reach.argmax(axis=1)]]
        ready = here.min(axis=1) == pivot
        if ready.any():
            q = live[ready]
            at_pivot = here[ready] == pivot[ready, None]
            gain = np.where(at_pivot, shard.impact[np.minimum(own[ready], len(shard.doc) - 1)] * times[q], 0).sum(axis=1)
            scored += len(q)
            heaps.push(rows[q], gain, shard.ids[pivot[ready]])
            floor[q] = heaps.floor()[rows[q]]
            cursor[q] = own[ready] + at_pivot
        if not ready.all():
            q, behind = live[~ready], here[~ready] < pivot[~ready, None]
            line, column = np.nonzero(behind)
            moved = own[~ready]
            moved[line, column] = np.minimum(shard.seek(terms[q[line], column], pivot[~ready][line]), stop[~ready][line, column])
            cursor[q] = moved
        live = live[(cursor[live] < end[live]).any(axis=1)]
    return scored


_SHARD = "n_docs long, n_terms long, ids binary, lengths binary, at binary, doc binary, tf binary"


def _shards(vocabulary: np.ndarray):
    """Cuts documents (id, t) into shards; counts all terms, keeps the postings of the vocabulary's."""

    def shard(ids: list, lengths: list, term: list, doc: list, tf: list) -> pa.RecordBatch:
        ids, lengths, term, doc, tf = (np.concatenate(x) for x in (ids, lengths, term, doc, tf))
        order = np.argsort(term, kind="stable")
        at = np.searchsorted(term[order], np.arange(len(vocabulary) + 1)).astype(np.int32)
        parts = [ids, lengths.astype(np.int64), at, doc[order].astype(np.int32), tf[order].astype(np.int32)]
        counts = [pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64())]
        return pa.RecordBatch.from_arrays([*counts, *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["n_docs", "n_terms", "ids", "lengths", "at", "doc", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(5)]
        docs = postings = 0
        for batch in batches:
            offsets, at = buffers(batch.column("t"))[1], 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART, "right")) - 1)
                part = batch.slice(at, to - at)
                hashes, ends = word_hashes(part.column("t"), breaks=_IS_BREAK)
                lengths = np.diff(ends)
                spot = np.minimum(np.searchsorted(vocabulary, hashes), max(0, len(vocabulary) - 1))
                known = np.flatnonzero(vocabulary[spot] == hashes) if len(vocabulary) else np.zeros(0, np.int64)
                pair, tf = np.unique(np.repeat(np.arange(len(lengths)), lengths)[known] * max(1, len(vocabulary)) + spot[known], return_counts=True)
                doc, term = np.divmod(pair, max(1, len(vocabulary)))
                for x, y in zip(held, (part.column("id").to_numpy(zero_copy_only=False), lengths, term, doc + docs, tf), strict=True):
                    x.append(y)
                docs, postings, at = docs + len(lengths), postings + len(tf), to
                if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield shard(*held)
                    held, docs, postings = [[] for _ in range(5)], 0, 0
        if docs:
            yield shard(*held)

    return run


def _df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of a task's shards."""
    total: np.ndarray | None = None
    for batch in batches:
        for at in batch.column("at"):
            own = np.diff(np.frombuffer(at.as_buffer(), np.int32)).astype(np.int64)
            total = own if total is None else total + own
    if total is not None:
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array(total[full])], names=["term", "df"])


def _tables(queries: list[Row]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, terms, times) of queries of like size, at most CELLS cells each; a larger query is a table of its own."""
    order = sorted(range(len(queries)), key=lambda i: len(queries[i].terms))
    out, at = [], 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(queries[order[to]].terms) <= CELLS:
            to += 1
        width = len(queries[order[to - 1]].terms)
        terms, times = np.zeros((to - at, width), np.int64), np.zeros((to - at, width), np.int64)
        for row, i in enumerate(order[at:to]):
            q = queries[i]
            terms[row, : len(q.terms)], times[row, : len(q.terms)] = q.terms, q.times
        out.append((np.array(order[at:to]), terms, times))
        at = to
    return out


def _searched(tables: list, queries: int, weight: np.ndarray, n_docs: int, n_terms: int, op: Bm):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(queries, op.k)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths, at, doc, tf = (np.frombuffer(batch.column(c)[row].as_buffer(), kind) for c, kind in (("ids", np.int64), ("lengths", np.int64), ("at", np.int32), ("doc", np.int32), ("tf", np.int32)))
                if len(doc):
                    at, doc = at.astype(np.int64), doc.astype(np.int64)
                    impact = op.impact(np.repeat(weight, np.diff(at)), tf.astype(np.int64), op.norm(lengths, n_docs, n_terms)[doc])
                    shard = Shard(at, doc, impact, ids)
                    for rows, terms, times in tables:
                        wand(shard, terms, times, heaps, rows)
        query, lane = np.nonzero(heaps.full)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(heaps.id[query, lane]), pa.array(heaps.score[query, lane])], names=["query", "doc", "score"])

    return run


def _block(docs: DataFrame, items: list[Row], op: Bm) -> DataFrame:
    """(item, rank, doc, score) of one block of items(item, words: (term, times))."""
    spark = docs.sparkSession
    names = sorted({w.term for r in items for w in r.words})
    hashes = word_hashes(pa.array(names, pa.string()), breaks=_IS_BREAK)[0] if names else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    number = {names[i]: k for k, i in enumerate(order)}
    shards = written(docs.mapInArrow(_shards(hashes[order]), _SHARD), "shards")
    counts = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = counts[0] or 0, counts[1] or 0
    found = shards.select("at").mapInArrow(_df, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(names), np.int64)
    df[found.column("term").to_numpy()] = found.column("df").to_numpy()
    queries = [Row(terms=[number[w.term] for w in r.words], times=[w.times for w in r.words]) for r in items]
    weight = op.weight(n_docs, df)
    heaps = shards.select("ids", "lengths", "at", "doc", "tf").mapInArrow(_searched(_tables(queries), len(queries), weight, n_docs, n_terms, op), "query long, doc long, score long")
    best = lambda x, *key: x.withColumn("rank", F.row_number().over(Window.partitionBy("query", *key).orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= op.k)
    merged = best(best(heaps, F.pmod(F.xxhash64("doc"), F.lit(64))).drop("rank"))
    named = spark.createDataFrame([(i, r.item) for i, r in enumerate(items)], "query long, item long")
    return written(merged.join(named, "query").select("item", "rank", "doc", "score"), "ranked")


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text", op: Bm = Bm(), block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, id, score): each item's op.k documents of highest score over 0, equal scores by ascending id.

    Every row of docs is a document, also if it repeats an id; rows without an id come last
    among equal scores and are returned without one. Rows of items that repeat an id are one
    item with the terms of all of them; items without an id or without a term have no result.
    Null and empty texts have no terms; texts of any length are read whole. Other columns
    aren't read. Without documents or items the result is empty.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    none = np.iinfo(np.int64).max
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(none)).alias("id"), whole_text(text).cast("binary").alias("t"))
    lowered = F.translate(whole_text(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select(F.col(item_col).cast("long").alias("item"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term")).where("item IS NOT NULL")
    of = words.groupBy("item", "term").agg(F.count(F.lit(1)).alias("times")).groupBy("item").agg(F.collect_list(F.struct("term", "times")).alias("words"))
    of = written(of, "queries")
    terms = of.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-terms // block_terms))
    out: DataFrame | None = None
    for b in range(blocks):
        part = of.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()  # a block of bounded size
        found = _block(texts, part, op)
        out = found if out is None else out.unionByName(found)
    own = F.when(F.col("doc") != none, F.col("doc"))
    return out.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), own.alias(id_col), "score")
