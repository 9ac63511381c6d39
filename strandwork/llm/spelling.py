"""Spelling variants: words one edit apart, by two-dimensional range reporting in wavelet trees.

1. The vocabulary is counted in Spark. A word is a point: its place in forward order and its
   place in reverse order (of the reversed words).
2. An edit at position i of a word leaves the text before it and the text after it. The words
   that agree with it before i are an interval of forward order, those that agree after i one
   of reverse order; the points in both intervals are the words that differ at i alone. One
   tree a length of words: with the own length a replacement is found, with the next length
   an insertion, and read from the other side a deletion.
3. Words are dealt to blocks by their first half for edits in the second one, and by their
   second half for edits in the first one, so that all points of a query are in its block. A
   half that too many words share is dealt by position and by the text on its other side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm.support import whole_text, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]+"
#: Characters of words that a block has on average; words that may share a half before it is dealt anew.
BLOCK_CHARS = 1 << 19
HOT = 1 << 14
#: Queries that a tree answers at once.
QUERIES = 1 << 19


@dataclass(frozen=True)
class Spelling:
    """hole: runs whose checksum it divides lose a character; length and count: least of a word; factor: how much commoner a form is."""

    hole: int = 97
    length: int = 5
    count: int = 3
    factor: int = 2


class WaveletTree:
    """Distinct integers 0 to n - 1 in a sequence, bit by bit from the highest; a level holds zeros before ones."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        for b in reversed(range(self.bits)):
            one = (values >> b & 1).astype(bool)
            self.zeros.append(np.concatenate(([0], np.cumsum(~one))).astype(np.int32))
            values = np.concatenate((values[~one], values[one]))

    def report(self, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values in [low, high) at places [lo, hi), for arrays of queries."""
        query, value = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for b, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            lo0, hi0, first = zeros[lo], zeros[hi], zeros[-1]
            lo1, hi1 = first + lo - lo0, first + hi - hi0
            up = value + (1 << b)
            left = (lo0 < hi0) & (value < high[query]) & (up > low[query])
            right = (lo1 < hi1) & (up < high[query]) & (up + (1 << b) > low[query])
            lo, hi = np.concatenate((lo0[left], lo1[right])), np.concatenate((hi0[left], hi1[right]))
            value, query = np.concatenate((value[left], up[right])), np.concatenate((query[left], query[right]))
        return query, value


class _Order:
    """Byte strings in order; intervals of those among `points` that share a prefix with a given row."""

    def __init__(self, rows: np.ndarray, points: np.ndarray):
        self.at = np.argsort(rows, kind="stable")
        self.place = np.empty(len(rows), np.int64)
        self.place[self.at] = np.arange(len(rows))
        found = rows[self.at]
        letters = found.view(np.uint8).reshape(len(rows), -1)
        same = letters[1:] == letters[:-1]
        self.shared = np.where(same.all(axis=1), letters.shape[1], same.argmin(axis=1))  # letters shared with the row before
        held = points[self.at]
        self.before = np.concatenate(([0], np.cumsum(held)))
        self.points = self.at[held]  # rows that are points, in order

    def interval(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """[lo, hi) in the order of points that share `depth` letters, for each row."""
        opens = np.concatenate(([True], self.shared < depth))
        edges = np.append(np.flatnonzero(opens), len(opens))
        group = np.cumsum(opens)[self.place] - 1
        return self.before[edges[group]], self.before[edges[group + 1]]


def near_in_block(words: list[bytes], own: np.ndarray, length: int, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): words[i] and words[j] differ by one edit at a position of [lo, hi) of the longer one; each ordered pair once.

    own: rows of `length` letters, which are the tree's points; the others have a letter less.
    """
    rows, backward = np.array(words, f"S{length}"), np.array([w[::-1] for w in words], f"S{length}")
    letters = rows.view(np.uint8).reshape(len(rows), length)
    forth, back = _Order(rows, own), _Order(backward, own)
    rank = np.empty(len(rows), np.int64)  # place of a point in reverse order
    rank[back.points] = np.arange(len(back.points))
    if not len(back.points):
        return
    tree, step = WaveletTree(rank[forth.points]), max(1, QUERIES // len(rows))
    for first in range(lo, hi, step):
        asked: list[tuple[np.ndarray, ...]] = []
        for i in range(first, min(hi, first + step)):
            (a, b), (low, high) = forth.interval(i), back.interval(length - 1 - i)
            least = 1 + own  # a point finds itself
            live = np.flatnonzero((b - a >= least) & (high - low >= least))
            asked.append((live, np.full(len(live), i), a[live], b[live], low[live], high[live]))
        row, position, *ranges = (np.concatenate(x) for x in zip(*asked, strict=True))
        query, value = tree.report(*ranges)
        source, at, found = row[query], position[query], back.points[value]
        swap = own[source]
        wanted = swap & (source != found)
        # an insertion into a run of equal letters counts at its first place alone
        wanted |= ~swap & ((at == 0) | (letters[found, np.maximum(at, 1) - 1] != letters[found, at]))
        source, found, swap = source[wanted], found[wanted], swap[wanted]
        yield np.concatenate((source, found[~swap])), np.concatenate((found, source[~swap]))


def _best(words: list[bytes], n: np.ndarray, source: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, how many are near, commonest of them; of equal ones the least) of rows with a near word."""
    place = np.empty(len(words), np.int64)
    place[np.argsort(np.array(words, np.bytes_), kind="stable")] = np.arange(len(words))
    order = np.lexsort((place[found], -n[found], source))
    own, first, count = np.unique(source[order], return_index=True, return_counts=True)
    return own, count, found[order][first]


_BLOCK = "word string, n_near long, best_n long, best string"


def _solve(block: pa.Table) -> pa.Table:
    """Near words in one block, summed up for each word of it."""
    out: list[tuple] = []
    side, length, lo, hi, role, n = (block.column(c).to_numpy() for c in ("side", "length", "lo", "hi", "role", "n"))
    text = [w.encode("latin-1") for w in block.column("word").to_pylist()]
    for kind in np.unique(np.stack((side, length, lo, hi), axis=1), axis=0):
        at = np.flatnonzero((side == kind[0]) & (length == kind[1]) & (lo == kind[2]) & (hi == kind[3]))
        words = [text[i] for i in at]
        for source, found in near_in_block(words, role[at] == 0, *map(int, kind[1:])):
            for own, count, best in zip(*(x.tolist() for x in _best(words, n[at], source, found)), strict=True):
                out.append((words[own].decode("latin-1"), count, int(n[at[best]]), words[best].decode("latin-1")))
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "best_n", "best"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text: str = "text", op: Spelling = Spelling()) -> DataFrame:
    """(word, n): the words of all texts and how often they occur. A null id counts as empty text, as a null text does."""
    run = F.explode(F.regexp_extract_all(F.translate(whole_text(text), UPPER, LOWER), F.lit(RUN), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("of"), run.alias("run")).where(F.length("run") >= op.length)
    check = F.crc32(F.concat("of", F.lit(":"), "run").cast("binary"))
    spot = F.pmod(check, F.length("run").cast("long")).cast("int")
    torn = F.concat(F.substring("run", F.lit(1), spot), F.substring("run", spot + 2, F.length("run")))
    words = runs.select(F.when(check % op.hole == 0, torn).otherwise(F.col("run")).alias("word")).where(F.length("word") >= op.length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= op.count)


def _ask(side: int, role: int, word: Column, n: Column) -> Column:
    """What a word asks of a block, as a point (role 0) or as a query that lacks a letter of the points' length (role 1)."""
    length = n + role
    half = F.floor(length / 2).cast("int")
    shared = F.substring(word, F.lit(1), half) if side == 0 else F.substring(word, half + 1 - role, n)
    lo, hi = (half, length) if side == 0 else (F.lit(0), half)
    key = F.xxhash64(F.lit(side), length, shared)
    return F.struct(F.lit(side).alias("side"), length.alias("length"), lo.alias("lo"), hi.alias("hi"), F.lit(role).alias("role"), key.alias("key"))


def _dealt_anew(rows: DataFrame) -> DataFrame:
    """Rows of a hot key, once for each position, by the text on the other side of it."""
    i = F.col("i")
    behind = F.substring("word", i + 2 - F.col("role"), F.length("word"))
    rest = F.when(F.col("side") == 0, behind).otherwise(F.substring("word", F.lit(1), i))
    each = rows.withColumn("i", F.explode(F.sequence("lo", F.col("hi") - 1)))
    return each.withColumn("key", F.xxhash64("key", "i", rest)).withColumns({"lo": i, "hi": i + 1}).drop("i")


def near_words(words: DataFrame, hot: int = HOT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(word, n_near, best_n, best) of words(word, n) of letters up to U+00FF: how many are one edit away, and the commonest of them.

    Of equally common ones the least in code-point order. Words without a near one have no row.
    """
    n = F.length("word")
    asks = F.explode(F.array(*[_ask(side, role, F.col("word"), n) for side in (0, 1) for role in (0, 1)])).alias("ask")
    rows = words.select("word", "n", asks).select("word", "n", "ask.*")
    hot_keys = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > hot).select("key"), "hot-halves")
    if not hot_keys.isEmpty():
        split = rows.join(hot_keys, "key", "left_semi").select(*rows.columns)
        rows = rows.join(hot_keys, "key", "left_anti").select(*rows.columns).unionByName(_dealt_anew(split))
    chars = words.agg(F.sum(F.length("word") * 4)).first()[0] or 0
    rows = rows.withColumn("bucket", F.pmod("key", F.lit(max(1, -(-chars // block_chars)))).cast("int")).drop("key")
    found = rows.groupBy("bucket").applyInArrow(_solve, _BLOCK)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms(word, form): the last form that is reached; forms get commoner, so none leads back."""
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(roots.join(on, "root", "left").select("word", "root", "next"), "roots")
        if step.where(F.col("next").isNotNull()).isEmpty():
            return roots
        roots = step.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", op: Spelling = Spelling()) -> DataFrame:
    """(word, form, root, n, n_near, form_n): words of all texts, what each is a variant of, and the last of its forms.

    form is the commonest word one edit away (of equally common ones the least), if it is op.factor
    times as common; null with form_n otherwise. root is the word itself where it has no form. Null,
    empty and letterless texts give no word; a text of any length and a run of any length are taken
    whole. Rows that repeat an id count each; a null id is an empty one. Other columns of docs
    aren't read. An empty table gives an empty result.
    """
    words = written(vocabulary(docs, id_col, text, op), "vocabulary")
    near = words.join(near_words(words), "word", "left")
    is_form = F.col("best_n") >= op.factor * F.col("n")
    named = near.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n"))
    named = written(named, "variants")
    roots = _roots(named.where(F.col("form").isNotNull()))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
