"""Evidence for a task: scores of definitions, plans under caps, closures over calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandwork import config
from strandwork.functions import paths, text
from strandwork.operators import ranking
from strandwork.operators.settle import settled

# Evidence kinds of each role, in order, and how many definitions of each a plan takes.
KINDS = (("domain", "model", 2), ("domain", "domain_flow", 2), ("persistence", "schema", 1), ("persistence", "persistence_crud", 2), ("transport", "transport", 2), ("ui", "ui", 2), ("tests", "tests", 1))


@dataclass(frozen=True)
class Caps:
    total: int = 28
    per_file: int = 6
    files: int = 8
    duplicates_count: bool = False


COVERAGE = Caps()


def path_roles(path: Column, roles=config.ROLE_TERMS) -> Column:
    """Roles of a path by prefix matching; page components are ui, test names tests. Python transport is ui only if a term says so."""
    return F.get(F.transform(F.array(text.tokens(path)), lambda found: _path_roles(path, found, roles)), F.lit(0))  # tokens are made once and named


def _path_roles(path: Column, found: Column, roles) -> Column:
    matches = lambda terms: F.size(text.matching_terms(text.array_of(terms), found)) > 0
    hit = [F.when(matches(terms), F.lit(role)) for role, terms in sorted(roles.items())]
    hit = F.array_compact(F.array(*hit, F.when(paths.suffix(path).isin("tsx", "jsx"), F.lit("ui"))))

    def decided(hit: Column) -> Column:
        not_ui = F.array_contains(hit, "transport") & (paths.suffix(path) == "py") & ~matches(config.EXPLICIT_UI_TERMS)
        kept = F.when(not_ui, F.array_remove(hit, "ui")).otherwise(hit)
        return F.array_sort(F.array_distinct(F.array_compact(F.array_append(kept, F.when(paths.is_test(path), F.lit("tests"))))))

    return F.get(F.transform(F.array(hit), decided), F.lit(0))


def kinds_of(roles: Column) -> Column:
    """(kind, limit) of the roles in fixed order."""
    return F.array_compact(F.array(*[F.when(F.array_contains(roles, role), F.struct(F.lit(kind).alias("kind"), F.lit(limit).alias("limit"))) for role, kind, limit in KINDS]))


def kind_score(kind: Column, *, name_tokens: Column, body: Column, path: Column, roles: Column, terms: Column, lines: Column, existing: Column) -> Column:
    """Evidence of a definition for a kind: name 150, body 24 up to five, path 35 each; a wrong role rejects, size costs."""
    hits = lambda arr: F.size(text.matching_terms(terms, arr))
    wrong = F.when((kind == "tests") != F.array_contains(roles, "tests"), True).when((kind == "transport") & F.array_contains(roles, "ui"), True).when((kind == "ui") & ~F.array_contains(roles, "ui"), True).otherwise(False)
    role_of = F.create_map(*[x for role, k, _ in KINDS for x in (F.lit(k), F.lit(role))])
    in_body = F.size(text.text_matching_terms(terms, body))
    bonus = F.when(F.array_contains(roles, role_of[kind]), 100).otherwise(0)
    size = F.when(lines > 200, 60).when(lines > 80, 20).otherwise(0)
    return F.when(wrong, F.lit(-1000)).otherwise(150 * hits(name_tokens) + 24 * F.least(F.lit(5), in_body) + 35 * hits(text.tokens(path)) + F.when(existing, 90).otherwise(0) + bonus - size)


def surface_scores(surfaces: DataFrame, symbols: DataFrame) -> DataFrame:
    """(task_id, pos, path, name, score) of surfaces(task_id, pos, tokens, roles, single, complex) over symbols(path, name, tokens, file_tokens, semantic_tokens, literals, roles, file_roles, important, presents).

    Both sides meet on shared tokens; literals is a map of word to weight. A task of one
    surface needs literal evidence; roles count for complex tasks only; 70 or more stay.
    """
    every = F.array_distinct(F.concat("tokens", "file_tokens", "semantic_tokens", F.map_keys("literals")))
    keyed = symbols.select("path", "name", F.explode(every).alias("token")).distinct()
    wanted = surfaces.select("task_id", "pos", F.explode("tokens").alias("token"))
    met = wanted.join(keyed, "token").select("task_id", "pos", "path", "name").distinct()
    own = symbols.select("path", "name", *[F.col(c).alias(f"s_{c}") for c in ("tokens", "file_tokens", "semantic_tokens", "literals", "roles", "file_roles", "important", "presents")])
    met = met.join(surfaces, ["task_id", "pos"]).join(own, ["path", "name"])
    shared = lambda c: F.size(F.array_intersect("tokens", c))
    literal = F.aggregate(F.array_intersect("tokens", F.map_keys("s_literals")), F.lit(0), lambda a, w: a + F.col("s_literals")[w])
    score = 70 * shared("s_tokens") + 25 * shared("s_file_tokens") + 15 * shared("s_semantic_tokens") + 240 * literal
    score += F.when(F.size(F.array_except("s_tokens", "tokens")) == 0, 120).otherwise(0) + F.when(F.col("s_presents") & (literal > 0), 180).otherwise(0)
    score += F.when(F.col("complex"), 45 * F.size(F.array_intersect("roles", "s_roles")) + 12 * F.size(F.array_intersect("roles", "s_file_roles"))).otherwise(0) + F.when(F.col("s_important"), 80).otherwise(0)
    return met.withColumn("score", score).where((F.col("score") >= 70) & (~F.col("single") | (literal > 0))).select("task_id", "pos", "path", "name", "score")


def surface_roots(surfaces: DataFrame, symbols: DataFrame, k: int) -> DataFrame:
    """(task_id, pos, path, name, score, rank): the best k symbols for each surface, by surface_scores. Surfaces that say the same are scored once."""
    said = ["tokens", "roles", "single", "complex"]
    asked = surfaces.withColumn("__class", F.sha2(F.to_json(F.struct(*said)), 256))
    once = asked.groupBy("__class").agg(*[F.first(c).alias(c) for c in said]).select(F.col("__class").alias("task_id"), F.lit(0).alias("pos"), *said)
    best = ranking.top_k(surface_scores(once, symbols), k, ["task_id"], [F.desc("score"), F.col("path"), F.col("name")])
    return asked.select("task_id", "pos", "__class").join(best.withColumnRenamed("task_id", "__class").drop("pos"), "__class").select("task_id", "pos", "path", "name", "score", "rank")


def plan(candidates: DataFrame, caps: Caps = COVERAGE, threshold: int = config.EVIDENCE_THRESHOLD) -> DataFrame:
    """(task_id, order_no, kind, path, name, score) taken from candidates(task_id, kind_no, kind, limit, path, name, score, lines).

    An ordered fold per task: kinds in order, within one the best score, fewest lines, path
    and name without case. Caps hold over all kinds. A definition taken before is skipped;
    whether it uses up its kind's limit is the caps' duplicates_count. A task's rows are sorted
    and streamed, so what a task holds is the plan, however many candidates there are.
    """
    rows = candidates.where(F.col("score") >= threshold).select("task_id", "kind_no", "kind", "limit", "path", "name", F.col("score").cast("long").alias("score"), "lines")
    if not caps.duplicates_count:
        # a file that has given its best per_file definitions of a kind, or had them taken before, can give no more
        keys = ["task_id", "kind_no", "path"]
        rows = rows.groupBy(*keys, "kind", "limit", "name").agg(F.max(F.struct("score", (-F.col("lines")).alias("lines"))).alias("x")).select("task_id", "kind_no", "kind", "limit", "path", "name", "x.score", (-F.col("x.lines")).alias("lines"))
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "lines", F.lower("name"), "name"))
        rows = rows.withColumn("__n", nth).where(F.col("__n") <= caps.per_file).drop("__n")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, kind, used, taken, per_file = None, None, 0, set(), {}
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.task_id != task:
                    task, kind, taken, per_file = r.task_id, None, set(), {}
                if r.kind_no != kind:
                    kind, used = r.kind_no, 0
                if used >= r.limit or len(taken) >= caps.total:
                    continue
                if (r.path, r.name) in taken:
                    used += caps.duplicates_count
                elif per_file.get(r.path, 0) < caps.per_file and (r.path in per_file or len(per_file) < caps.files):
                    taken.add((r.path, r.name))
                    per_file[r.path] = per_file.get(r.path, 0) + 1
                    used += 1
                    out.append((task, len(taken) - 1, r.kind, r.path, r.name, r.score))
            yield pd.DataFrame(out, columns=["task_id", "order_no", "kind", "path", "name", "score"])

    rows = rows.repartition("task_id").sortWithinPartitions("task_id", "kind_no", F.desc("score"), "lines", F.lower("path"), F.lower("name"), "path", "name")
    return rows.mapInPandas(fold, f"task_id {rows.schema['task_id'].dataType.simpleString()}, order_no int, kind string, path string, name string, score long")


def rooted_closure(roots: DataFrame, calls: DataFrame | Callable[[DataFrame], DataFrame], *, depth: int = 3, symbols: int = 24, files: int = 12) -> DataFrame:
    """(task_id, path, name, depth, rank) discovered from roots(task_id, path, name, rank) over resolved calls(src_path, src, pos, dst_path, dst).

    Roots are walked through but not among the result, which is in the order of discovery: by
    level, the caller's rank and the call's position. At most `symbols` definitions in at most
    `files` files are discovered: one in a further file is skipped, isn't counted and isn't
    walked through. Each level is kept, at most `symbols` rows a task. A task that has its
    definitions goes no further. calls may be a function too, which gives all calls of given
    definitions(path, name): for relations too large to keep.
    """
    if not callable(calls):
        # every level reads them; the hint keeps them from being sent whole to the driver by a guess of their size
        edges = settled(calls.groupBy("src_path", "src", "dst_path", "dst").agg(F.min("pos").alias("pos"))).hint("merge")
    own = ["task_id", "path", "name"]
    first = F.row_number().over(Window.partitionBy("task_id").orderBy("rank", "path", "name"))
    frontier = known = settled(roots.groupBy(*own).agg(F.min("rank").alias("rank")).withColumn("rank", first))
    found = None
    for level in range(1, depth + 1):
        if found is not None:
            full = found.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= symbols)
            frontier = frontier.join(full.select("task_id"), "task_id", "left_anti")
            if frontier.isEmpty():
                break
        near = calls(frontier.select("path", "name").distinct()) if callable(calls) else edges
        met = frontier.join(near, (F.col("path") == F.col("src_path")) & (F.col("name") == F.col("src")))
        met = met.select("task_id", F.col("dst_path").alias("path"), F.col("dst").alias("name"), F.struct("rank", "pos").alias("at"))
        step = met.join(known.select(*own), own, "left_anti").groupBy(*own).agg(F.min("at").alias("at"))
        none = F.array().cast("array<string>")
        if found is None:
            step = step.withColumns({"held": none, "n": F.lit(0).cast("long")})
        else:
            counts = found.groupBy("task_id").agg(F.collect_set("path").alias("held"), F.count(F.lit(1)).alias("n"))
            step = step.join(counts, "task_id", "left").withColumns({"held": F.coalesce("held", none), "n": F.coalesce("n", F.lit(0))})
        order = F.struct("at", "path", "name")
        step = step.withColumns({"fresh": ~F.array_contains("held", F.col("path")), "opens": F.min(order).over(Window.partitionBy("task_id", "path"))})
        step = step.withColumn("nth", F.dense_rank().over(Window.partitionBy("task_id", "fresh").orderBy("opens")))
        step = step.where(~F.col("fresh") | (F.col("nth") <= files - F.size("held")))
        rank = F.col("n") + F.row_number().over(Window.partitionBy("task_id").orderBy("at", "path", "name"))
        frontier = settled(step.withColumn("rank", rank).where(F.col("rank") <= symbols).select(*own, F.lit(level).alias("depth"), "rank"))
        found = frontier if found is None else found.union(frontier)
        known = known.select(*own).union(frontier.select(*own))
    return found


def scored_hops(roots: DataFrame, edges: DataFrame, points: list[int], top: int = 8) -> DataFrame:
    """(task_id, node, score, rank): nodes one hop further for each of points, scores added over the hops that reach them. Tasks of the same roots are walked once."""
    asked = roots.select("task_id", "node").distinct().groupBy("task_id").agg(F.array_sort(F.collect_list("node")).alias("__set")).withColumn("__class", F.sha2(F.to_json("__set"), 256))
    asked = settled(asked)
    once = asked.groupBy("__class").agg(F.first("__set").alias("__set")).select(F.col("__class").alias("task_id"), F.explode("__set").alias("node"))
    best = _hops(settled(once), edges, points, top).withColumnRenamed("task_id", "__class")
    return asked.select("task_id", "__class").join(best, "__class").select("task_id", "node", "score", "rank")


def _hops(roots: DataFrame, edges: DataFrame, points: list[int], top: int) -> DataFrame:
    edges = edges.hint("merge")  # their size is guessed from a table's, of which they are many times as many: never sent whole to the driver
    frontier, hits = roots.select("task_id", "node").distinct(), None
    for p in points:
        frontier = frontier.join(edges, F.col("node") == F.col("src")).select("task_id", F.col("dst").alias("node")).distinct()
        own = frontier.withColumn("points", F.lit(p))
        hits = own if hits is None else hits.union(own)
    fresh = hits.join(roots.select("task_id", "node"), ["task_id", "node"], "left_anti").groupBy("task_id", "node").agg(F.sum("points").alias("score"))
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("score"), "node"))
    return fresh.withColumn("rank", rank).where(F.col("rank") <= top)


def owner_score(role: Column, *, name: Column, body: Column, roles: Column, path_hits: Column, term_hits: Column) -> Column:
    """How well a definition owns a role: dispatchers own transport, components ui, test classes tests; others are rejected."""
    fits = (
        F.when(role == "transport", F.array_contains(roles, "transport") | body.rlike(r"(?i)\b(?:route|request|response)\b"))
        .when(role == "ui", F.array_contains(roles, "ui") | body.rlike(r"<[A-Za-z][^>]*>")).when(role == "tests", F.array_contains(roles, "tests")).otherwise(False)
    )
    return F.when(~fits, F.lit(-1000)).otherwise(120 + 60 * term_hits + 30 * path_hits + F.when(name.rlike("(?i)^(?:handle|dispatch|render|test)"), 40).otherwise(0))
