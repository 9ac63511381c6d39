"""Bounded traversal by frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandwork import config
from strandwork.operators import ranking
from strandwork.operators.settle import settled


def bounded_bfs(seeds: DataFrame, edges: DataFrame, *, depth: int = config.BFS_DEPTH, fan_out: int = config.BFS_FAN_OUT, limit: int | None = config.DEFAULT_FILES) -> DataFrame:
    """(task_id, node, depth, rank) reached from seeds(task_id, node, rank) over edges(src, dst, pos).

    A node's first fan_out edges by position are followed; the first discovery counts: by
    depth, then the rank of the node it was found from, then the edge's position. The best
    limit nodes of a task stay.
    """
    nth = F.row_number().over(Window.partitionBy("src").orderBy("pos", "dst"))
    # every level reads them; their size is guessed from a table's, so the hint keeps them from being sent whole to the driver
    edges = settled(edges.withColumn("__n", nth).where(F.col("__n") <= fan_out).select("src", "dst", "__n")).hint("merge")
    reached = seeds.select("task_id", "node", F.lit(0).alias("depth"), F.col("rank").cast("long").alias("rank")).cache()
    frontier = reached
    for d in range(1, depth + 1):
        if limit is not None:  # nearer nodes rank first, so a task that has enough needs no further level
            full = reached.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)
            frontier = frontier.join(full.select("task_id"), "task_id", "left_anti")
        step = frontier.join(edges, F.col("node") == F.col("src")).select("task_id", F.col("dst").alias("node"), F.col("rank").alias("__from"), "__n")
        step = step.join(reached.select("task_id", "node"), ["task_id", "node"], "left_anti")
        step = step.groupBy("task_id", "node").agg(F.min(F.struct("__from", "__n")).alias("x"))
        order = F.row_number().over(Window.partitionBy("task_id").orderBy("x.__from", "x.__n", "node"))
        frontier = step.select("task_id", "node", F.lit(d).alias("depth"), order.cast("long").alias("rank"))
        frontier = settled(frontier if limit is None else frontier.where(F.col("rank") <= limit))
        reached = reached.union(frontier)
    order = F.row_number().over(Window.partitionBy("task_id").orderBy("depth", "rank", "node"))
    out = reached.select("task_id", "node", "depth", order.cast("long").alias("rank"))
    return out if limit is None else out.where(F.col("rank") <= limit)


def seed_neighbourhood(seeds: DataFrame, deps: DataFrame, symbols: DataFrame, *, dep: int = 24, importer: int = 18, shared: int = 14) -> DataFrame:
    """hits(task_id, path, pos, points, reason) next to seeds(task_id, path): what they depend on, what imports them, who shares a symbol."""
    on = seeds.select("task_id", F.col("path").alias("seed"))
    out = on.join(deps, F.col("seed") == F.col("src")).select("task_id", F.col("dst").alias("path"), F.lit(0).alias("pos"), F.lit(dep).alias("points"), F.lit("dependency").alias("reason"))
    back = on.join(deps, F.col("seed") == F.col("dst")).select("task_id", F.col("src").alias("path"), F.lit(1).alias("pos"), F.lit(importer).alias("points"), F.lit("importer").alias("reason"))
    own = on.join(symbols.select(F.col("path").alias("seed"), "name"), "seed")
    same = own.join(symbols, "name").where("path <> seed").select("task_id", "path", F.lit(2).alias("pos"), F.lit(shared).alias("points"), F.lit("shared symbol").alias("reason"))
    return out.union(back).union(same)


def best_neighbours(seeds: DataFrame, deps: DataFrame, symbols: DataFrame, k: int, order: list[Column], *, dep: int = 24, importer: int = 18, shared: int = 14) -> DataFrame:
    """(task_id, path, score, reasons, rank): the first k paths by the points of seed_neighbourhood, as ranking.additive adds and tells them.

    Names that many tasks' seeds define aren't met with all their paths (ranking.top_sums).
    """
    on = settled(seeds.select("task_id", F.col("path").alias("seed")))
    most = on.groupBy("task_id").agg(F.count_distinct("seed").alias("n")).agg(F.max("n")).first()[0] or 0
    tie = lambda seed, other, pos, points, reason: on.join(deps, F.col("seed") == F.col(seed)).select("task_id", F.col(other).alias("path"), F.lit(pos).alias("pos"), F.lit(points).cast("long").alias("points"), F.lit(reason).alias("reason"))
    tied = settled(tie("src", "dst", 0, dep, "dependency").union(tie("dst", "src", 1, importer, "importer")))
    held = settled(symbols.where(F.col("name").isNotNull()).groupBy(F.col("name").alias("key"), "path").agg((F.count(F.lit(1)) * shared).alias("points")))
    own = on.groupBy("task_id", "seed").agg(F.count(F.lit(1)).alias("n")).join(held.select(F.col("path").alias("seed"), "key", "points"), "seed").withColumn("n", F.col("n") * (F.col("points") / shared).cast("long"))
    back = own.select("task_id", F.col("seed").alias("path"), (-F.col("n") * F.col("points")).alias("points"))  # a seed shares no symbol with itself
    best = ranking.top_sums(own.select("task_id", "key", "n"), held, k, order, "path", extra=tied.select("task_id", "path", "points").union(back), spare=most)
    told = tied.groupBy("task_id", "path").agg(F.sum("points").alias("__points"), F.collect_set(F.struct("pos", "reason")).alias("__told"))
    both = best.join(told, ["task_id", "path"], "left")
    none = F.array().cast("array<struct<pos:int,reason:string>>")
    names = F.when(F.col("score") > F.coalesce("__points", F.lit(0)), F.array(F.struct(F.lit(2).alias("pos"), F.lit("shared symbol").alias("reason")))).otherwise(none)
    reasons = F.array_join(F.transform(F.array_sort(F.concat(F.coalesce("__told", none), names)), lambda x: x["reason"]), ",")
    return both.select("task_id", "path", "score", reasons.alias("reasons"), "rank")
