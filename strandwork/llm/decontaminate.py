"""Benchmark decontamination by greedy string tiling over shared seeds.

Windows of k words are fingerprinted by a running Karp-Rabin hash. A bitmap of the
benchmark's fingerprints, of fixed size whatever the benchmark's, is broadcast and thins
the documents' windows. A document must share so many windows with an item to reach the
thresholds that it shares at least one of the item's rarest ones; only these are met in an
equi-join, so a phrase that many items and documents share pairs nothing up. For each
document and item paired, the longest match of unmarked words is marked again and again
until none of k words is left. The marked share of the item's words decides, so a passage
is found however its parts are ordered; of long items a verbatim excerpt decides as well.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandwork.llm.support import bounded_batches, whole_text, written
from strandwork.llm.text_kernel import rolling_hashes, word_hashes

#: log2 of the bitmap's bits: 2 MB.
LG_BITS = 24
#: Pairs of equal windows of a document and an item that are listed; beyond, matches are searched by their length.
LISTED = 1 << 16
#: Parts that a window shared by many documents is dealt to.
PARTS = 8


def _windows(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the k-word windows, whether a window starts at each word, offset of each value's words) of a batch."""
    words, offsets = word_hashes(column)
    hashes = rolling_hashes(words, k)
    inside = np.zeros(len(words), bool)
    inside[: len(hashes)] = True
    for b in range(1, k):  # windows may not run over a value's end
        at = offsets[1:] - b
        inside[at[at >= 0]] = False
    return hashes, inside, offsets


def _item_seeds(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, inside, offsets = _windows(batch.column("t"), k)
            at = np.flatnonzero(inside)
            of = np.searchsorted(offsets, at, "right") - 1
            n = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[at].view(np.int64)), batch.column("of").take(pa.array(of)), pa.array(at - offsets[of]), pa.array(n[of])], names=["seed", "of", "item_pos", "item_words"]
            )

    return run


def _doc_seeds(k: int, bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bitmap.value, np.uint8), bitorder="little").view(bool)
        mask = np.uint64((1 << LG_BITS) - 1)
        for batch in batches:
            hashes, inside, offsets = _windows(batch.column("t"), k)
            at = np.flatnonzero(inside)
            at = at[bits[hashes[at] & mask]]
            of = np.searchsorted(offsets, at, "right") - 1
            rows = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("digest").take(rows), pa.array(at - offsets[of]), pa.array(hashes[at].view(np.int64))], names=["id", "digest", "pos", "seed"])

    return run


def tile(matches: np.ndarray, k: int) -> int:
    """Words marked by greedy string tiling; see tiles."""
    return sum(tiles(matches, k))


def tiles_of(doc_pos: np.ndarray, doc_seed: np.ndarray, item_seed: np.ndarray, k: int) -> list[int]:
    """Lengths of the tiles of a document's windows (sorted positions, hashes) and an item's (one a position); see tiles.

    Few equal windows are listed. Of many, as in texts that repeat themselves, the longest
    match is searched by halving its length, with running Karp-Rabin hashes of each length:
    memory is in proportion to the windows, not to their pairs.
    """
    known, place = np.unique(item_seed, return_inverse=True)
    found = np.minimum(np.searchsorted(known, doc_seed), max(0, len(known) - 1))
    held = known[found] == doc_seed if len(known) else np.zeros(len(doc_seed), bool)
    doc_pos, doc_seed, found = doc_pos[held], doc_seed[held], found[held]
    times = np.bincount(place, minlength=len(known))
    if times[found].sum() <= LISTED:
        order, first = np.argsort(place, kind="stable"), np.cumsum(times) - times
        n = times[found]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[found], n)
        return tiles(np.stack([np.repeat(doc_pos, n), order[at]], axis=1), k) if len(at) else []
    item_pos, lengths = np.arange(len(item_seed)), []

    def windows(pos: np.ndarray, seed: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of every m windows in a row."""
        hashes = rolling_hashes(seed, m)
        whole = pos[m - 1 :] - pos[: len(hashes)] == m - 1
        return pos[: len(hashes)][whole], hashes[whole]

    def longest() -> tuple[int, int, int] | None:
        """(windows in a row, item position, document position) of the longest match; the least places of equal ones."""
        lo, hi, best = 1, min(len(item_pos), len(doc_pos)), None
        while lo <= hi:
            m = (lo + hi) // 2
            (i_at, i_hash), (d_at, d_hash) = windows(item_pos, item_seed, m), windows(doc_pos, doc_seed, m)
            hit = np.flatnonzero(np.isin(i_hash, d_hash))
            if len(hit):
                best = (m, int(i_at[hit[0]]), int(d_at[np.argmax(d_hash == i_hash[hit[0]])]))
                lo = m + 1
            else:
                hi = m - 1
        return best

    while (best := longest()) is not None:
        m, i, d = best
        length = m + k - 1
        lengths.append(length)
        left = (item_pos <= i - k) | (item_pos >= i + length)  # windows without a marked word
        item_pos, item_seed = item_pos[left], item_seed[left]
        left = (doc_pos <= d - k) | (doc_pos >= d + length)
        doc_pos, doc_seed = doc_pos[left], doc_seed[left]
    return lengths


def tiles(matches: np.ndarray, k: int) -> list[int]:
    """Lengths of the tiles of greedy string tiling; matches: (document position, item position) of equal k-word windows."""
    matches = np.unique(matches, axis=0)
    diagonal = matches[:, 0] - matches[:, 1]
    order = np.lexsort((matches[:, 1], diagonal))
    diagonal, at = diagonal[order], matches[order, 1]
    cut = np.flatnonzero((diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    # maximal matches, longest first; ties by item position, then document position
    heap = [(-int(at[hi - 1] - at[lo] + k), int(at[lo]), int(at[lo] + diagonal[lo])) for lo, hi in zip(np.append(0, cut), np.append(cut, len(at)), strict=True)]
    heapq.heapify(heap)
    in_item, in_doc, lengths = set(), set(), []
    while heap:
        length, i, d = heapq.heappop(heap)
        free = [i + x not in in_item and d + x not in in_doc for x in range(-length)]
        if all(free):
            in_item.update(range(i, i - length))
            in_doc.update(range(d, d - length))
            lengths.append(-length)
            continue
        start = None
        for x, is_free in enumerate([*free, False]):  # what is left of the match goes back, if long enough
            if is_free and start is None:
                start = x
            elif not is_free and start is not None:
                if x - start >= k:
                    heapq.heappush(heap, (start - x, i + start, d + start))
                start = None
    return lengths


def contamination(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text",
    k: int = 5, coverage: float = 0.5, excerpt: int = 50,
) -> DataFrame:
    """(id, digest, item, covered, item_words, coverage) of each document and item at or over the coverage,
    or with excerpt words of the item in tiles of 2 * k words or more, whatever the item's length.

    digest is xxhash64 of the text: rows that repeat id and text are one here. Texts are
    lower-cased, accented letters too; those of any length are read whole. Null or empty texts
    and items of fewer than k words share nothing. Items that repeat an id are tested each, and
    a null id is one of its own. Other columns than those named are not read. Without documents or items
    there are no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    t = F.lower(whole_text(item_text)).cast("binary")
    names = written(items.select(F.col(item_col).alias("item"), F.xxhash64(t).alias("of")).distinct(), "names")
    seeds = items.select(F.xxhash64(t).alias("of"), t.alias("t")).dropDuplicates(["of"])
    seeds = written(seeds.mapInArrow(_item_seeds(k), "seed long, of long, item_pos long, item_words long"), "seeds")
    low = F.shiftrightunsigned(F.col("seed").bitwiseAND(F.lit((1 << LG_BITS) - 1)), 3)
    cells = seeds.select(low.alias("byte"), F.expr("shiftleft(1, cast(seed & 7 AS int))").alias("bit"))
    cells = cells.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2**(LG_BITS - 3) rows at most
    bitmap = np.zeros(1 << (LG_BITS - 3), np.uint8)
    bitmap[cells.column("byte").to_numpy()] = cells.column("bits").to_numpy()
    bitmap = spark.sparkContext.broadcast(bitmap.tobytes())

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(whole_text(text)).alias("digest"), F.lower(whole_text(text)).cast("binary").alias("t"))
    id_type = texts.schema["id"].dataType.simpleString()
    found = written(texts.mapInArrow(_doc_seeds(k, bitmap), f"id {id_type}, digest long, pos long, seed long"), "found")

    # each window covers k words at most, and a tile of 2 * k words has k + 1: fewer windows than this can't reach either threshold
    need = F.least(F.ceil(F.col("item_words") * coverage / k), F.lit(-(-excerpt * (k + 1) // (2 * k))))
    rarity = F.row_number().over(Window.partitionBy("of").orderBy(F.coalesce("times", F.lit(0)), "item_pos"))
    times = found.groupBy("seed").agg(F.count(F.lit(1)).alias("times"))
    rare = seeds.join(times, "seed", "left").withColumn("rarity", rarity).where((F.col("rarity") <= F.col("item_words") - k + 2 - need) & F.col("times").isNotNull())
    rare = rare.select("seed", "of").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = found.select("id", "digest", "seed", F.pmod(F.xxhash64("digest", "pos"), F.lit(PARTS)).cast("int").alias("part"))
    pairs = written(dealt.join(rare, ["seed", "part"]).select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "of").distinct(), "pairs")

    own = found.join(pairs, F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))).drop("__id", "__digest")
    own = own.join(seeds.select("of", "seed").distinct(), ["of", "seed"], "left_semi")
    hits = own.groupBy("id", "digest", "of").agg(F.collect_set(F.struct("pos", "seed")).alias("hits"))
    of_item = seeds.groupBy("of", "item_words").agg(F.transform(F.array_sort(F.collect_list(F.struct("item_pos", "seed"))), lambda x: x["seed"]).alias("item_seeds"))
    hits = hits.join(of_item, "of").where((F.size("hits") * k >= F.col("item_words") * coverage) | (F.size("hits") * 2 * k >= excerpt * (k + 1)))

    @F.pandas_udf("covered long, verbatim long")
    def tiled(hits: pd.Series, item_seeds: pd.Series) -> pd.DataFrame:
        found = []
        for own, seeds in zip(hits, item_seeds, strict=True):
            at = np.array([(x["pos"], x["seed"]) for x in own], np.int64)
            at = at[np.argsort(at[:, 0])]
            found.append(tiles_of(at[:, 0], at[:, 1].view(np.uint64), np.asarray(seeds, np.int64).view(np.uint64), k))
        return pd.DataFrame({"covered": [sum(x) for x in found], "verbatim": [sum(n for n in x if n >= 2 * k) for x in found]}, dtype="int64")

    out = hits.select("id", "digest", "of", tiled("hits", "item_seeds").alias("tiled"), "item_words").select("id", "digest", "of", "tiled.*", "item_words")
    out = out.withColumn("coverage", F.col("covered") / F.col("item_words")).where((F.col("coverage") >= coverage) | (F.col("verbatim") >= excerpt))
    return out.join(names, "of").select("id", "digest", "item", "covered", "item_words", "coverage")


def judge_contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with n_items (items it holds), item (the best covered; of equals the least), coverage and contaminated added.

    Every row comes out once, whatever repeats; columns of those names are replaced.
    """
    pairs = contamination(docs, items, id_col=id_col, text=text, **options)
    by = pairs.groupBy("id", "digest").agg(F.countDistinct("item").alias("n_items"), F.min(F.struct((-F.col("coverage")).alias("c"), "item")).alias("best"))
    by = written(by.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "n_items", F.col("best.item").alias("item"), (-F.col("best.c")).alias("coverage")), "leaks")
    kept = docs.drop("n_items", "item", "coverage", "contaminated").withColumn("__of", F.xxhash64(whole_text(text)))
    out = kept.join(by, kept[id_col].eqNullSafe(F.col("__id")) & (F.col("__of") == F.col("__digest")), "left")
    out = out.withColumn("contaminated", F.col("n_items").isNotNull())
    return out.withColumns({"n_items": F.coalesce("n_items", F.lit(0).cast("long")), "coverage": F.coalesce("coverage", F.lit(0.0))}).drop("__id", "__digest", "__of")
