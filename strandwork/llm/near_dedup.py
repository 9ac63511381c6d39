"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact confirmation.

1. Each text becomes a set of hashed word shingles, a digest of that set and a MinHash
   signature. Equal sets form one class, a node, whose number is half the digest; the least
   id that has it represents it.
2. Bands of the signature put representatives into buckets. Each representative is
   first compared with the least one it shares a bucket with, which joins up large groups
   without listing their pairs. Where buckets of more than CELL rows still hold several
   groups, rows are compared with another leader, one a round, as long as rounds join many.
3. What is left are buckets whose members still belong to different groups. Their members
   meet in cells of two blocks of CELL rows each, on average, of fewer if texts are long. The largest group's rows need
   not meet each other, so in a larger bucket they and the others are dealt to blocks apart:
   a row of the largest group is sent once for each block of the others, mostly once. Pairs
   of different groups are compared inside the task, each in the first band it shares: first
   to keep the rows that have a pair to confirm, then, with the full sets of those rows, to
   confirm them. Only links that join groups come out, never the pairs.
4. A comparison reads the signatures a piece at a time and stops as soon as the posterior
   probability of reaching the wanted similarity falls under the miss probability; pairs
   that pass are confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.components import connected
from strandwork.llm.support import bounded_batches, id_bitmap, in_bitmap, whole_text, written
from strandwork.llm.text_kernel import buffers, mix64, shingles, word_hashes

#: Rows of a block in the cells of step 3, partners that share one copy of a leader, and pairs that are compared at once.
CELL = 1024
PAIRS = 1 << 16
#: A text of more shingles counts as several rows of a cell; values of partners' sets that are compared at once.
ROW_SHINGLES = 1024
COMPARED = 1 << 17
_CHUNK = 1 << 16
#: Bytes of text that are hashed into sets at once; a longer text is taken whole.
PART = 1 << 20


@dataclass(frozen=True)
class NearDedup:
    """size: words of a shingle; links need percent * union <= 100 * intersection.

    bands * rows hashes: at similarity 0.75 a pair shares no band with probability 5e-6.
    miss: posterior probability under which a pair is dropped, at each of the
    signature's pieces of step hashes. turns: rounds with other leaders at most; the next one
    is worth while if this share of the compared rows was joined.
    """

    size: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    step: int = 16
    miss: float = 1e-6
    turns: int = 4
    worth: float = 0.1

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def least_matches(op: NearDedup) -> list[tuple[int, int]]:
    """(hashes compared, matches needed): fewer matches leave a posterior P[similarity >= wanted] under miss.

    With a uniform prior the posterior after m matches of n is Beta(m+1, n-m+1), and its
    upper tail at t is P[Bin(n+1, t) <= m].
    """
    t, out = op.percent / 100, []
    for n in range(op.step, op.hashes + 1, op.step):
        total, need = 0.0, n + 1
        for m in range(n + 1):
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= op.miss:
                need = m
                break
        out.append((n, need))
    return out


def _multipliers(n: int) -> np.ndarray:
    return mix64(np.arange(0xD1, 0xD1 + n, dtype=np.uint64)) | np.uint64(1)


def signatures(sets: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """MinHash signatures (values x n, uint32) of non-empty shingle lists."""
    out = np.empty((len(offsets) - 1, n), np.uint32)
    factors = _multipliers(n)
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, "right")) - 1)
        piece, first = sets[offsets[at] : offsets[to]], offsets[at:to] - offsets[at]
        work = np.empty_like(piece)
        for k in range(n):
            np.multiply(piece, factors[k], out=work)
            out[at:to, k] = np.minimum.reduceat(work, first) >> np.uint64(32)
        at = to
    return out


def _digest(own: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about PART bytes of text, so that the arrays worked on stay small."""
    for batch in batches:
        offsets, at = buffers(batch.column("t"))[1], 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def _sketches(op: NearDedup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            sets, offsets = shingles(*word_hashes(batch.column("t")), op.size)
            full = np.flatnonzero(np.diff(offsets))
            sig = np.zeros((len(offsets) - 1, op.hashes), np.uint32)
            if len(full):  # empty values take no place in the offsets
                sig[full] = signatures(sets, np.append(offsets[full], offsets[-1]), op.hashes)
            n, d0, d1 = [], [], []
            for i in range(len(offsets) - 1):
                own = np.unique(sets[offsets[i] : offsets[i + 1]])
                digest = _digest(own)
                n.append(len(own)), d0.append(digest[0]), d1.append(digest[1])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(d0, pa.int64()), pa.array(d1, pa.int64()), pa.array([x.tobytes() for x in sig], pa.binary())], names=["id", "n", "d0", "d1", "sig"])

    return run


def _sets(op: NearDedup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            sets, offsets = shingles(*word_hashes(batch.column("t")), op.size)
            own = [np.unique(sets[offsets[i] : offsets[i + 1]]) for i in range(len(offsets) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(x)[0] for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["id", "set"])

    return run


#: What identifies a row in a cell of step 3, besides its signature.
CELL_COLUMNS = ("key", "band", "i", "j", "id", "label", "block", "n")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return buffers(column)[0].view(np.uint32).reshape(-1, width)


def survivors(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, needs: list[tuple[int, int]]) -> np.ndarray:
    """Which of the pairs (a[left], b[right]) pass every bound; failing pairs are not read on."""
    alive, matches, at = np.arange(len(left)), np.zeros(len(left), np.int32), 0
    for n, need in needs:
        matches = matches + (a[left[alive], at:n] == b[right[alive], at:n]).sum(axis=1, dtype=np.int32)
        passed = matches >= need
        alive, matches, at = alive[passed], matches[passed], n
        if not len(alive):
            break
    return alive


def _prune(op: NearDedup):
    needs = least_matches(op)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _matrix(batch.column("sig_a"), op.hashes), _matrix(batch.column("sig_b"), op.hashes)
            every = np.arange(len(a))
            kept = pa.array(survivors(a, b, every, every, needs))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(kept), batch.column("b").take(kept)], names=["a", "b"])

    return run


def _by_cell(solve) -> Callable:
    """A mapInArrow function over rows sorted by cell (key, i, j): solve gets a table of whole cells and their bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            keys, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
            edge = np.flatnonzero((keys[1:] != keys[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            return solve(t, np.append(0, edge), np.append(edge, len(keys)))

        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            keys, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
            other = np.flatnonzero((keys != keys[-1]) | (i != i[-1]) | (j != j[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last cell may go on in the next batch
            if held and not cut and any(held[-1].column(c)[-1].as_py() != t.column(c)[0].as_py() for c in ("key", "i", "j")):
                yield solved(pa.concat_tables(held))
                held = []
            if cut:
                yield solved(pa.concat_tables([*held, t.slice(0, cut)]))
                held = []
            held.append(t.slice(cut))
        if held:
            yield solved(pa.concat_tables(held))

    return run


def _met(op: NearDedup, t: dict[str, np.ndarray], sig: np.ndarray, needs: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell that pass the bounds: of different groups, here first by band, at most PAIRS compared at once."""
    m, band = len(sig), int(t["band"][0])
    rows = max(1, PAIRS // m)
    for lo in range(0, m, rows):
        left, right = (x.ravel() for x in np.meshgrid(np.arange(lo, min(m, lo + rows)), np.arange(m), indexing="ij"))
        wanted = (t["label"][left] != t["label"][right]) & (t["id"][left] < t["id"][right])
        # sets whose sizes are too far apart can't be similar enough
        wanted &= 100 * np.minimum(t["n"][left], t["n"][right]) >= op.percent * np.maximum(t["n"][left], t["n"][right])
        if t["i"][0] != t["j"][0]:
            wanted &= t["block"][left] != t["block"][right]
        left, right = left[wanted], right[wanted]
        passed = survivors(sig, sig, left, right, needs)
        left, right = left[passed], right[passed]
        if band and len(left):  # a pair is left to the first band that it shares
            at = slice(0, band * op.rows)
            before = (sig[left, at] == sig[right, at]).reshape(len(left), band, op.rows).all(axis=2).any(axis=1)
            left, right = left[~before], right[~before]
        yield left, right


def _cell_columns(t: pa.Table, lo: int, hi: int) -> dict[str, np.ndarray]:
    return {c: t.column(c).to_numpy()[lo:hi] for c in CELL_COLUMNS[1:]}


def _mark_rows(op: NearDedup):
    """Keeps the rows of a cell that have a pair to confirm."""
    needs = least_matches(op)
    names = [*CELL_COLUMNS, "sig"]

    def solve(t: pa.Table, los: np.ndarray, his: np.ndarray) -> pa.RecordBatch:
        sig, wanted = _matrix(t.column("sig"), op.hashes), np.zeros(t.num_rows, bool)
        for lo, hi in zip(los, his, strict=True):
            if hi - lo > 1:
                for left, right in _met(op, _cell_columns(t, lo, hi), sig[lo:hi], needs):
                    wanted[lo + left] = wanted[lo + right] = True
        return t.select(names).filter(pa.array(wanted)).combine_chunks().to_batches()[0] if wanted.any() else pa.RecordBatch.from_pylist([], t.select(names).schema)

    return _by_cell(solve)


def _similar(op: NearDedup, data: np.ndarray, offsets: np.ndarray, row: int, partners: np.ndarray) -> np.ndarray:
    """Whether each partner's sorted set is similar enough to the row's; sets are read COMPARED values at a time."""
    own, sizes = data[offsets[row] : offsets[row + 1]], offsets[partners + 1] - offsets[partners]
    both, at, ends = np.zeros(len(partners), np.int64), 0, np.cumsum(sizes)
    while at < len(partners):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + COMPARED, "right")))
        values = np.concatenate([data[offsets[y] : offsets[y + 1]] for y in partners[at:to]])
        found = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
        both[at:to] = np.add.reduceat(found, ends[at:to] - sizes[at:to] - (ends[at] - sizes[at]), dtype=np.int64)
        at = to
    return 100 * both >= op.percent * (len(own) + sizes - both)


def _link_rows(op: NearDedup):
    """Confirms the pairs of a cell on full sets and returns links that join up its groups, a tree for each joined set."""
    needs = least_matches(op)

    def solve(t: pa.Table, los: np.ndarray, his: np.ndarray) -> pa.RecordBatch:
        sig, found = _matrix(t.column("sig"), op.hashes), []
        data, offsets = buffers(t.column("set"))
        data, offsets = data.view(np.uint64), offsets // 8
        for lo, hi in zip(los, his, strict=True):
            if hi - lo < 2:
                continue
            columns = _cell_columns(t, lo, hi)
            top = {int(x): int(x) for x in columns["label"]}

            def root(x: int, top=top) -> int:
                while top[x] != x:
                    top[x] = top[top[x]]
                    x = top[x]
                return x

            for left, right in _met(op, columns, sig[lo:hi], needs):
                for row in np.unique(left):
                    partners = lo + right[left == row]
                    for y in partners[_similar(op, data, offsets, lo + row, partners)] - lo:
                        a, b = root(int(columns["label"][row])), root(int(columns["label"][y]))
                        if a != b:
                            top[max(a, b)] = min(a, b)
                            found.append((int(columns["id"][row]), int(columns["id"][y])))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return _by_cell(solve)


def _confirm(op: NearDedup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(100 * both >= op.percent * (len(x) + len(y) - both))
            kept = pa.array(np.flatnonzero(kept))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(kept), batch.column("b").take(kept)], names=["a", "b"])

    return run


def _once(df: DataFrame, n: int, tag: str) -> DataFrame:
    """A written df with one row for each id; n: how many ids it has. Rows that repeat id and text make it larger."""
    return df if df.count() <= n else written(df.dropDuplicates(["id"]), tag)


def _sets_of(nodes: DataFrame, classes: DataFrame, texts: DataFrame, op: NearDedup) -> DataFrame:
    """(id, set) of the given nodes; written. A bitmap of their representatives spares most other texts the shuffle."""
    ids = written(classes.join(nodes.withColumnRenamed("id", "d0"), "d0", "left_semi").select(F.col("rep").alias("id")).distinct(), "near")
    near = in_bitmap(texts, "id", id_bitmap(ids, "id"))
    sets = written(near.join(ids.hint("merge"), "id", "left_semi").mapInArrow(_sets(op), "id long, set binary"), "sets")
    return _once(sets, sets.select("id").distinct().count(), "sets")


def _ends(pairs: DataFrame, data: DataFrame, value: str) -> DataFrame:
    """pairs(a, b) with the value of both; a is copied once for every CELL of its partners, so it is no hot key."""
    n = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("copies"))
    heads = n.select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")).join(data.select(F.col("id").alias("a"), F.col(value).alias(f"{value}_a")), "a")
    dealt = pairs.join(n, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("copy"))
    return dealt.join(heads, ["a", "copy"]).join(data.select(F.col("id").alias("b"), F.col(value).alias(f"{value}_b")), "b")


def _confirmed(pairs: DataFrame, reps: DataFrame, classes: DataFrame, texts: DataFrame, op: NearDedup) -> tuple[DataFrame, DataFrame]:
    """(the pairs that pass the bounds, those of them that are links); written."""
    passed = written(_ends(pairs, reps, "sig").mapInArrow(_prune(op), "a long, b long").distinct(), "pairs")
    sets = _sets_of(passed.select(F.explode(F.array("a", "b")).alias("id")).distinct(), classes, texts, op)
    return passed, written(_ends(passed, sets, "set").mapInArrow(_confirm(op), "a long, b long"), "stars")


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups(node, label) once links(a, b) between nodes, with a group or without, have joined them; written."""
    label = lambda x: groups.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    between = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    tops = connected(between).select(F.col("node").alias("label"), F.col("label").alias("top"))
    fresh = tops.join(groups.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("top").alias("label"))
    return written(groups.join(tops, "label", "left").select("node", F.coalesce("top", "label").alias("label")).union(fresh), "groups")


def _members(bands: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the buckets with their groups, (key, m, top) of the buckets that hold several); top: (n, label) of the largest group.

    m and n count rows, and a row of a long text as one for each ROW_SHINGLES of its shingles.
    """
    rows = bands.join(groups.withColumnRenamed("node", "id"), "id", "left").select("key", "band", "id", F.coalesce("label", "id").alias("label"), "weight")
    rows = written(rows, "members")
    of = rows.groupBy("key", "label").agg(F.sum("weight").alias("n"))
    mixed = of.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("n").alias("m"), F.max(F.struct("n", "label")).alias("top"))
    return rows, written(mixed.where("lo < hi").select("key", "m", "top"), "mixed")


def _cells(rows: DataFrame, mixed: DataFrame) -> DataFrame:
    """Rows of mixed buckets, once for each cell (key, i, j) that they are in, with their own block's side of it.

    Blocks 0 to p - 1 hold the largest group, p to p + q - 1 the others; a bucket of up to
    CELL rows is one block. No cell has two blocks of the largest group.
    """
    large = F.col("m") > CELL
    p = F.when(large, F.ceil(F.col("top.n") / CELL)).otherwise(0).cast("int").alias("p")
    q = F.when(large, F.ceil((F.col("m") - F.col("top.n")) / CELL)).otherwise(1).cast("int").alias("q")
    rows = rows.join(mixed.select("key", p, q, F.col("top.label").alias("top")), "key")
    apart, spot = (F.col("p") > 0) & (F.col("label") == F.col("top")), F.xxhash64("id")
    own = F.when(apart, F.pmod(spot, F.greatest("p", F.lit(1)))).otherwise(F.col("p") + F.pmod(spot, F.col("q"))).cast("int")
    rows = rows.withColumns({"own": own, "from": F.when(apart, F.col("p")).otherwise(0)})
    cell = F.transform(F.sequence(F.col("from"), F.col("p") + F.col("q") - 1), lambda k: F.struct(F.least(k, "own").alias("i"), F.greatest(k, "own").alias("j")))
    rows = rows.select("key", "band", "id", "label", "own", F.explode(cell).alias("cell"))
    return rows.select("key", "band", "cell.*", "id", "label", (F.col("own") == F.col("cell.j")).cast("int").alias("block"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", op: NearDedup = NearDedup()) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs.

    component_id is the least id reachable over links, the row's own included; kept is
    whether it is the row's own. Texts are lower-cased (A-Z); one with fewer words than a
    shingle has its whole sequence as its only shingle; one of any length is hashed whole.
    Null or empty texts have no shingle and link with nothing. Rows that repeat an id are in
    one component, with equal texts or not, and each return a row. A null id links with
    nothing, has a null component and is kept. Other columns of docs are not read. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text).cast("binary").alias("t"))
    sketch = written(texts.mapInArrow(_sketches(op), "id long, n long, d0 long, d1 long, sig binary"), "sketch")
    slim = sketch.select("id", "n", "d0", "d1")
    classes = written(slim.where("n > 0 AND id IS NOT NULL").groupBy("d0", "d1").agg(F.min("id").alias("rep")), "classes")
    reps = sketch.where("n > 0").join(classes.withColumnRenamed("rep", "id"), ["id", "d0", "d1"])
    reps = _once(written(reps.select(F.col("d0").alias("id"), F.col("id").alias("rep"), "n", "sig"), "reps"), classes.count(), "reps")

    width = 4 * op.rows
    band = F.transform(F.sequence(F.lit(0), F.lit(op.bands - 1)), lambda k: F.xxhash64(k, F.substring("sig", k * width + 1, F.lit(width))))
    weight = F.expr(f"1 + n div {ROW_SHINGLES}").alias("weight")
    bands = reps.select("id", "rep", weight, F.posexplode(band).alias("band", "key"))
    by_rep = F.struct("rep", "id")
    shared = bands.groupBy("key").agg(F.min(by_rep).alias("first"), F.max(by_rep).alias("last")).where("first < last")
    bands = written(bands.drop("rep").join(shared.select("key", "first"), "key"), "buckets")  # only buckets of two or more

    # step 2: one pair for each representative, with the least it meets
    pairs = bands.groupBy(F.col("id").alias("b")).agg(F.min("first").alias("first")).select("b", F.col("first.id").alias("a")).where("a <> b")
    groups = connected(_confirmed(pairs, reps, classes, texts, op)[1])
    rows, mixed = _members(bands, groups)
    for turn in range(1, op.turns + 1):
        order = F.xxhash64(F.lit(turn), "id")
        large = rows.join(mixed.where(F.col("m") > CELL).select("key"), "key", "left_semi")
        leaders = large.groupBy("key").agg(F.min_by(F.struct("id", "label"), order).alias("leader"))
        pairs = large.join(leaders, "key").where("label <> leader.label").groupBy("id").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "key"), F.col("leader.id").alias("a"))).alias("of"))
        pairs = written(pairs.select(F.col("id").alias("b"), "of.a"), "turn")
        if pairs.isEmpty():
            break
        links = _confirmed(pairs, reps, classes, texts, op)[1]
        if links.isEmpty():
            break
        groups = _joined(groups, links)
        rows, mixed = _members(bands, groups)
        if links.count() < op.worth * pairs.count():
            break

    # step 3: buckets in which different groups still meet
    together = lambda x: x.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    names, schema = [*CELL_COLUMNS, "sig"], "key long, band int, i int, j int, id long, label long, block int, n long, sig binary"
    marked = written(together(_cells(rows, mixed).join(reps.drop("rep"), "id").select(*names)).mapInArrow(_mark_rows(op), schema), "marked")
    sets = _sets_of(marked.select("id").distinct(), classes, texts, op)
    links = together(marked.join(sets, "id").select(*names, "set")).mapInArrow(_link_rows(op), "a long, b long").distinct()
    groups = _joined(groups, links)

    of = written(classes.join(groups.withColumnRenamed("node", "d0"), "d0", "left"), "grouped")
    linked = of.where(F.col("label").isNotNull())
    least = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
    alone = of.where(F.col("label").isNull()).select("d0", "d1", F.col("rep").alias("component_id"))
    of = written(linked.join(least, "label").select("d0", "d1", "component_id").union(alone), "components")
    own = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "id"))
    judged = written(slim.join(of, ["d0", "d1"], "left").select("id", "n", own.alias("own")), "judged")
    # rows that repeat an id with other texts join their components
    split = judged.where("id IS NOT NULL").groupBy("id").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo < hi").select("id", "lo")
    same = connected(judged.join(split, "id").select(F.col("own").alias("a"), F.col("lo").alias("b"))).withColumnRenamed("node", "own")
    own = F.coalesce("label", "own")
    out = judged.join(same, "own", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))
