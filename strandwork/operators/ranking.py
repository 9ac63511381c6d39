"""Scores, ranks, ranges and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandwork import config
from strandwork.operators.settle import settled


#: Words with the same first three letters beyond which these are too common to look them up by.
CROWDED = 64
#: Tasks that words of texts are dealt to, so that one holds a small part of them.
PARTS = 200
#: Tasks that ask for a key beyond which it is summed up once for all tasks that ask for the same.
OFTEN = 64


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys to PARTS tasks at least, which aren't merged into fewer."""
    parts = max(PARTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, *keys)


def _dealt(rows: DataFrame, *keys: str) -> GroupedData:
    """rows grouped by the keys that they are dealt by."""
    return dealt(rows, *keys).groupBy(*keys)


def containing(strings: DataFrame, words: DataFrame) -> DataFrame:
    """(word, s): which distinct words (of three letters or more) stand in which distinct strings s.

    A string that holds a word holds its first three letters, so the join is on those and
    no string meets words it has nothing in common with. Where many words begin alike, it is
    on their first eight letters, or all of shorter ones.
    """
    position = F.sequence(F.lit(1), F.length("s") - 2)
    pieces = strings.select("s").distinct().where("length(s) >= 3").select("s", F.explode(F.array_distinct(F.transform(position, lambda i: F.substr("s", i, F.lit(3))))).alias("__key"))
    keyed = words.select("word").distinct().where("length(word) >= 3").select("word", F.left("word", F.lit(3)).alias("__key"))
    crowded = keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > CROWDED).select("__key")
    plain = pieces.join(keyed.join(crowded, "__key", "left_anti"), "__key").where(F.contains("s", F.col("word"))).select("word", "s")
    starts = lambda s, key: F.filter(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substr(s, i, F.lit(3)) == key)
    longer = F.flatten(F.transform(starts(F.col("s"), F.col("__key")), lambda i: F.transform(F.sequence(F.lit(3), F.least(F.lit(8), F.length("s") - i + 1)), lambda n: F.substr("s", i, n))))
    fine = pieces.join(crowded, "__key", "left_semi").select("s", F.explode(F.array_distinct(longer)).alias("__key"))
    many = keyed.join(crowded, "__key", "left_semi").select("word", F.left("word", F.lit(8)).alias("__key"))
    return plain.union(fine.join(many, "__key").where(F.contains("s", F.col("word"))).select("word", "s"))


def _strings(files: DataFrame, mode: str) -> DataFrame:
    """(path, s, points): the lower-cased strings in which words count."""
    points = lambda arr, n: F.transform(arr, lambda x: F.struct(F.lower(x).alias("s"), F.lit(n).alias("points")))
    own = F.concat(points(F.array("path"), config.PATH_SCORE), points(F.col("symbols"), config.SYMBOL_SCORE))
    ai = F.concat(points(F.col("tags"), config.TAG_SCORE), points(F.col("important"), config.IMPORTANT_SCORE), points(F.array("summary"), config.SUMMARY_SCORE))
    rest = F.when(F.col("complete") & F.lit(mode == "ai"), ai).otherwise(points(F.col("imports"), config.IMPORT_SCORE))
    strings = files.select("path", F.explode(F.concat(own, rest)).alias("x")).groupBy("path", "x.s").agg(F.sum("x.points").alias("points"))
    return strings


def word_points(words: DataFrame, files: DataFrame, *, mode: str = "static") -> DataFrame:
    """(word, path, points): what each of words(word) counts in files, as word_scores has it."""
    strings = _strings(files, mode)
    return _dealt(containing(strings, words).join(strings, "s").select("word", "path", "points"), "word", "path").agg(F.sum("points").alias("points"))


def word_scores(tasks: DataFrame, files: DataFrame, *, mode: str = "static") -> DataFrame:
    """(task_id, path, score) of tasks(task_id, words) over files(path, symbols, imports, tags, important, summary, complete).

    A word counts in the path, in each symbol that holds it, and, where the row is complete
    and mode is ai, in tags, important symbols and summary, else in each import.
    """
    words = tasks.select("task_id", F.explode("words").alias("word"))
    met = words.join(word_points(words, files, mode=mode), "word").select("task_id", "path", "points")
    return _dealt(met, "task_id", "path").agg(F.sum("points").alias("score"))


def top_k(df: DataFrame, k: int, by: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """The first k rows of each group in the given order."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def top_sums(wanted: DataFrame, held: DataFrame, k: int, order: list[Column], *node: str, extra: DataFrame | None = None, spare: int = 0) -> DataFrame:
    """(task_id, node..., score, rank): each task's first k nodes by the sum of n * points over wanted(task_id, key, n) and held(key, node..., points).

    extra(task_id, node..., points) adds to single nodes; it may take points from at most spare
    nodes of a task. Nodes without a score above 0 go; order must be total. n and points are above 0.

    The sums of keys that many tasks ask for are made once for each set of such keys, and
    only the first k of them come to a task: a node that isn't among these, and that nothing else
    of the task touches, has k others before it. So tasks don't meet all nodes of a common key.
    """
    wanted = settled(wanted.groupBy("task_id", "key").agg(F.sum("n").alias("n")))
    common = settled(wanted.groupBy("key").agg(F.count(F.lit(1)).alias("__t")).where(F.col("__t") > OFTEN).select("key"))
    asked = wanted.join(common, "key", "left_semi").groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("__set"))
    asked = settled(asked.withColumn("__class", F.sha2(F.to_json("__set"), 256)))
    classes = asked.groupBy("__class").agg(F.first("__set").alias("__set")).select("__class", F.inline("__set"))
    base = settled(classes.join(held, "key").groupBy("__class", *node).agg(F.sum(F.col("n") * F.col("points")).alias("score")))
    first = top_k(base, k + spare, ["__class"], order, "__rank").drop("__rank")
    of = asked.select("task_id", "__class")
    touched = wanted.join(common, "key", "left_anti").join(held, "key").select("task_id", *node, (F.col("n") * F.col("points")).alias("points"))
    touched = touched if extra is None else touched.union(extra.select("task_id", *node, "points"))
    touched = settled(touched.groupBy("task_id", *node).agg(F.sum("points").alias("points")))
    own = touched.join(of, "task_id", "left").join(base, ["__class", *node], "left").select("task_id", *node, (F.col("points") + F.coalesce("score", F.lit(0))).alias("score"))
    rest = of.join(first, "__class").join(touched.select("task_id", *node), ["task_id", *node], "left_anti").select("task_id", *node, "score")
    return top_k(own.union(rest).where("score > 0"), k, ["task_id"], order)


def additive(hits: DataFrame, *keys: str) -> DataFrame:
    """(keys..., score, reasons) of hits(keys..., pos, points, reason): every hit adds, a reason is told once, at its first place."""
    first = hits.groupBy(*keys, "reason").agg(F.sum("points").alias("points"), F.min("pos").alias("pos"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "reason"))), lambda x: x["reason"]), ",")
    return first.groupBy(*keys).agg(F.sum("points").alias("score"), ordered.alias("reasons"))


def merge_ranges(df: DataFrame, start: str, end: str, *keys: str, gap: int = 1) -> DataFrame:
    """(keys..., start, end): ranges that overlap or lie at most gap apart become one."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__new", F.coalesce((F.col(start) > reach + gap).cast("int"), F.lit(1)))
    df = df.withColumn("__island", F.sum("__new").over(order))
    return df.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def prefix_budget(df: DataFrame, size: str, order: str, budget: int | Column, *keys: str) -> DataFrame:
    """Rows in order up to the first that would exceed the budget; sizes are 0 or more."""
    used = F.sum(size).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("used", used).where(F.col("used") <= budget)


def skip_budget(df: DataFrame, size: str, order: str, budget: int, *keys: str) -> DataFrame:
    """(keys..., order, size, taken, used): a row that doesn't fit is skipped, later smaller ones may fit.

    An ordered fold: what a group takes depends on all before, so its (order, size) pairs
    are folded as one array.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("pos"), F.col(size).cast("long").alias("size"))))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<pos:{df.schema[order].dataType.simpleString()},size:bigint,taken:boolean,used:bigint>>").alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["size"] <= budget
        used = acc["used"] + F.when(fits, x["size"]).otherwise(F.lit(0).cast("long"))
        return F.struct(used.alias("used"), F.concat(acc["rows"], F.array(F.struct(x["pos"].alias("pos"), x["size"].alias("size"), fits.alias("taken"), used.alias("used")))).alias("rows"))

    folded = df.groupBy(*keys).agg(F.aggregate(items, empty, step, lambda acc: acc["rows"]).alias("rows"))
    return folded.select(*keys, F.explode("rows").alias("x")).select(*keys, F.col("x.pos").alias(order), F.col("x.size").alias(size), "x.taken", "x.used")


def line_weights(words: DataFrame, *keys: str) -> DataFrame:
    """(keys..., line_no, weight) of words(keys..., line_no, word), a row an occurrence: rarer and longer words weigh more.

    weight = min(5000, max(1, len**3 * 100 // max(1, floor(sqrt(df))))) * n, summed over a line's
    words. Rows are dealt by keys once, to PARTS tasks at least, which aren't merged into fewer;
    every step after that works where they lie, and only a word's lines are held together.
    """
    parts = max(PARTS, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = words.repartition(parts, *keys).groupBy(*keys, "word").agg(F.collect_list("line_no").alias("__lines"))
    df = F.size(F.array_distinct("__lines"))
    one = F.least(F.lit(5000), F.greatest(F.lit(1), F.floor(F.pow(F.length("word"), F.lit(3)) * 100 / F.greatest(F.lit(1), F.floor(F.sqrt(df))))))
    return met.select(*keys, one.cast("long").alias("__one"), F.explode("__lines").alias("line_no")).groupBy(*keys, "line_no").agg(F.sum("__one").alias("weight"))


def retention(df: DataFrame, order: list[Column], *keys: str, keep: int = config.HISTORY_PER_STATUS) -> DataFrame:
    """df with kept: whether the row is among the newest keep of its group."""
    return df.withColumn("kept", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) <= keep)


def eta(df: DataFrame, seconds: str, order: str, total: Column, *keys: str) -> DataFrame:
    """df with mean_seconds so far and eta_seconds from the second item on."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    done = F.count(F.lit(1)).over(w)
    df = df.withColumn("mean_seconds", F.avg(seconds).over(w)).withColumn("done", done)
    return df.withColumn("eta_seconds", F.when(F.col("done") >= 2, F.col("mean_seconds") * (total - F.col("done"))))


def tripped(df: DataFrame, reason: str, order: str, *keys: str, first: int = 5, most: int = 4) -> DataFrame:
    """(keys..., tripped): whether most or more of the first items failed for one reason."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    by = df.withColumn("__n", nth).where(F.col("__n") <= first).groupBy(*keys, reason).agg(F.count(reason).alias("c"))
    return by.groupBy(*keys).agg((F.max("c") >= most).alias("tripped"))


def reason_histogram(df: DataFrame, reason: str, order: list[str], *keys: str, first: int = 5) -> DataFrame:
    """(reason, n, in_first): how often each reason stands, in all and among each group's first items."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", nth).groupBy(reason).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__n") <= first).alias("in_first"))


def ordered_union(*sources: tuple[DataFrame, str], keys: list[str], value: str, order: str) -> DataFrame:
    """(keys..., value, source, rank): distinct values, sources in the given priority, then by order within one."""
    all_ = None
    for i, (df, name) in enumerate(sources):
        own = df.select(*keys, value, order, F.lit(i).alias("__prio"), F.lit(name).alias("source"))
        all_ = own if all_ is None else all_.union(own)
    first = all_.groupBy(*keys, value).agg(F.min(F.struct("__prio", order, "source")).alias("x"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("x.__prio", f"x.{order}", value))
    return first.select(*keys, value, "x.source", rank.alias("rank"))


def least_level(df: DataFrame, level: str, *keys: str) -> DataFrame:
    """Each key once, at its strongest (least) level: levels become disjoint."""
    return df.groupBy(*keys).agg(F.min(level).alias(level))
