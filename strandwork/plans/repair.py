"""Documents for repairs: what failed, what changed and the current source around it, within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandwork import config
from strandwork.functions import text
from strandwork.operators import extract, joins, ranking
from strandwork.operators.settle import settled

REPAIR_BUDGET, FULL_FILE = 140_000, 35_000
BEFORE_ANCHOR, AFTER_ANCHOR = 45, 65
ERROR_LINES = 40


def around(content: Column, anchor: Column, full: int = FULL_FILE) -> Column:
    """A file whole if it is short enough, else the lines around the anchor."""
    rows = F.split(content, "\n")
    first = F.greatest(anchor - BEFORE_ANCHOR, F.lit(1))
    return F.when(F.length(content) <= full, content).otherwise(F.array_join(F.slice(rows, first, anchor + AFTER_ANCHOR - first + 1), "\n"))


def nearby(segmented: DataFrame, errors: DataFrame, *keys: str) -> DataFrame:
    """Lines of segmented diffs from errors(keys..., error_line) on, up to the next file or hunk, at most ERROR_LINES."""
    df = segmented.join(errors, list(keys)).where("line_no >= error_line")
    stop = F.min(F.when((F.col("line_no") > F.col("error_line")) & F.col("kind").isin("header", "hunk"), F.col("line_no"))).over(Window.partitionBy(*keys))
    df = df.withColumn("__stop", stop).where((F.col("__stop").isNull() | (F.col("line_no") < F.col("__stop"))) & (F.col("line_no") < F.col("error_line") + ERROR_LINES))
    return df.drop("__stop")


def document(sections: DataFrame, key: str, budget: int = REPAIR_BUDGET) -> DataFrame:
    """(key, document, taken, skipped) of sections(key, pos, title, body): redacted, in order, those that don't fit skipped."""
    own = sections.select(key, "pos", F.concat(F.lit("## "), F.col("title"), F.lit("\n"), text.redact(F.col("body"))).alias("block"))
    fits = ranking.skip_budget(own.select(key, "pos", F.length("block").alias("size")), "size", "pos", budget, key)
    both = own.join(fits.select(key, "pos", "taken"), [key, "pos"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("taken"), F.struct("pos", "block")))), lambda x: x["block"]), "\n\n")
    return both.groupBy(key).agg(joined.alias("document"), F.count_if("taken").alias("taken"), F.count_if(~F.col("taken")).alias("skipped"))


def relevant_paths(reports: DataFrame, deps: DataFrame, patch_paths: DataFrame, tests: DataFrame, key: str, most_deps: int = 8) -> DataFrame:
    """(key, path, source, rank): traceback files, then failing tests' files, what those depend on (at most eight), then the patch's."""
    at = F.row_number().over(Window.partitionBy(key).orderBy("path")).cast("int")
    traced = extract.traceback_paths(reports, "body", key).select(key, "path").withColumn("at", at)
    tested = tests.select(key, "path").distinct().withColumn("at", at)
    needed = traced.select(key, F.col("path").alias("src")).union(tested.select(key, F.col("path").alias("src"))).join(deps, "src").select(key, F.col("dst").alias("path")).distinct()
    needed = needed.withColumn("at", at).where(F.col("at") <= most_deps)
    patched = patch_paths.select(key, "path").distinct().withColumn("at", at)
    return ranking.ordered_union((traced, "traceback"), (tested, "test"), (needed, "dependency"), (patched, "patch"), keys=[key], value="path", order="at")


def failure_document(reports: DataFrame, files: DataFrame, chosen: DataFrame, key: str, budget: int = REPAIR_BUDGET) -> DataFrame:
    """One document for each report(key, body): the redacted tail of its output, then the chosen files' current source, long ones around the line that the report's traceback names."""
    output = reports.select(key, F.lit(0).alias("pos"), F.lit("Failing output").alias("title"), F.right("body", F.lit(config.CONTEXT_REPORT_CHARS)).alias("body"))
    traced = extract.traceback_paths(reports, "body", key).select(key, "path", "line_no")
    source = chosen.join(files, "path").join(traced, [key, "path"], "left")
    source = source.select(key, F.col("rank").cast("int").alias("pos"), F.concat(F.lit("Source "), F.col("path")).alias("title"), around(F.col("content"), F.coalesce("line_no", F.lit(1))).alias("body"))
    return document(output.union(source), key, budget)


def reclassified(reports: DataFrame, key: str) -> DataFrame:
    """(key, exit_code, failures) read back from saved reports, for a new verdict."""
    fields = extract.report_fields(F.col("body"))
    codes = reports.select(key, fields["exit_code"].alias("exit_code"))
    failing = extract.test_failures(reports, "body", key).groupBy(key).agg(F.array_sort(F.collect_set("test_id")).alias("failures"))
    return codes.join(failing, key, "left").select(key, "exit_code", F.coalesce("failures", F.array().cast("array<string>")).alias("failures"))


def allowances(demands: DataFrame, budget: int, *keys: str) -> DataFrame:
    """(keys..., order_no, allowance) of demands(keys..., order_no, n, size): shares of a budget by demand 1600 + 2800 * n.

    In order, each gets its share of what the ones before have really used (their size, their
    allowance at most) left, in proportion to its demand among those that remain; one at least.
    """
    items = F.array_sort(F.collect_list(F.struct("order_no", (F.lit(1600) + 2800 * F.col("n")).cast("long").alias("need"), F.col("size").cast("long").alias("size"))))
    one = demands.groupBy(*keys).agg(items.alias("items"))
    every = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["need"])
    none = F.array().cast("array<struct<order_no:%s,allowance:bigint>>" % demands.schema["order_no"].dataType.simpleString())
    start = F.struct(F.lit(budget).cast("long").alias("left"), every.alias("remaining"), none.alias("rows"))

    def step(z: Column, x: Column) -> Column:
        share = F.greatest(F.lit(1).cast("long"), F.floor(F.greatest(z["left"], F.lit(0).cast("long")) * x["need"] / z["remaining"]))
        row = F.array(F.struct(x["order_no"].alias("order_no"), share.alias("allowance")))
        return F.struct((z["left"] - F.least(x["size"], share)).alias("left"), (z["remaining"] - x["need"]).alias("remaining"), F.concat(z["rows"], row).alias("rows"))

    return one.select(*keys, F.explode(F.aggregate("items", start, step, lambda z: z["rows"])).alias("x")).select(*keys, "x.order_no", "x.allowance")


def plan_excerpt(numbered: DataFrame, words: Column, key: str) -> DataFrame:
    """(key, start_line, end_line) of an excerpt: the heaviest lines for the words, their surroundings merged, the strongest range first."""
    hits = numbered.select(key, "line_no", F.explode(F.regexp_extract_all(F.lower("line"), F.lit("[a-z0-9_]+"), F.lit(0))).alias("word")).where(F.array_contains(words, F.col("word")))
    weights = ranking.line_weights(hits, key)
    best = ranking.top_k(weights, config.EXCERPT_LINES, [key], [F.desc("weight"), F.col("line_no")])
    no = F.col("line_no")
    spans = best.select(key, F.greatest(no - config.EXCERPT_RADIUS, F.lit(1)).alias("start_line"), (no + config.EXCERPT_RADIUS).alias("end_line"))
    return ranking.merge_ranges(spans, "start_line", "end_line", key)


def missing_requests(requests: DataFrame, definitions: DataFrame, selected: DataFrame, top: int = 6) -> DataFrame:
    """(task_id, path, score, rank): files outside selected that answer requested symbols (100 each) or two words and more of a concept (12 each).

    What is asked for is looked up once, whoever asks, and requests that many tasks make aren't
    met with all files that answer them (ranking.top_sums).
    """
    once = F.when(F.col("kind") == "symbol", F.count(F.lit(1))).otherwise(1).cast("long")  # a concept counts once, however often it is asked for
    # symbols are told apart without regard to case, concepts by their words as they stand
    asked = requests.where("kind IN ('symbol', 'concept') AND value IS NOT NULL").select("task_id", "kind", F.when(F.col("kind") == "symbol", F.lower("value")).otherwise(F.col("value")).alias("value"))
    key = F.concat("kind", F.lit(" "), "value")
    wanted = settled(asked.groupBy("task_id", "kind", "value").agg(once.alias("n")).select("task_id", "kind", "value", key.alias("key"), "n"))
    values = wanted.select("kind", "value", "key").distinct()
    symbol = values.where("kind = 'symbol'").join(definitions.select("path", F.lower("name").alias("value")).distinct(), "value").select("key", "path", F.lit(100).cast("long").alias("points"))
    words = values.where("kind = 'concept'").select("key", F.explode(text.raw_tokens(F.col("value"))).alias("token"))
    own = definitions.select("path", F.explode(text.tokens(F.col("name"))).alias("token")).distinct()
    concept = words.join(own, "token").groupBy("key", "path").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("key", "path", (12 * F.col("n")).alias("points"))
    chosen = settled(selected.select("task_id", "path").distinct())
    most = chosen.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    gone = chosen.withColumn("points", F.lit(-(1 << 40)).cast("long"))  # more than any requests add up to
    return ranking.top_sums(wanted.select("task_id", "key", "n"), settled(symbol.union(concept)), top, [F.desc("score"), F.col("path")], "path", extra=gone, spare=most)


def suites(tests: DataFrame, top: int = 3) -> DataFrame:
    """(task_id, owner, tests, rank) of tests(task_id, owner, name, path_hits, term_hits): suites by path overlap, size, terms, name."""
    by = tests.groupBy("task_id", "owner").agg(F.max("path_hits").alias("path_hits"), F.count(F.lit(1)).alias("tests"), F.sum("term_hits").alias("term_hits"))
    return ranking.top_k(by, top, ["task_id"], [F.desc("path_hits"), F.desc("tests"), F.desc("term_hits"), F.col("owner")]).select("task_id", "owner", "tests", "rank")


def effective_roles(requirements: DataFrame, anchored: DataFrame) -> DataFrame:
    """requirements(task_id, roles) widened by the roles that anchored(task_id, file_roles) files show."""
    shown = anchored.select("task_id", F.explode("file_roles").alias("role")).groupBy("task_id").agg(F.collect_set("role").alias("shown"))
    return requirements.join(shown, "task_id", "left").withColumn("roles", F.array_sort(F.array_union("roles", F.coalesce("shown", F.array().cast("array<string>"))))).drop("shown")


def stable(before: DataFrame, after: DataFrame) -> DataFrame:
    """(stable): whether two (path, hash) readings of the same files agree."""
    return joins.snapshot_diff(before, after).agg((F.count_if(F.col("change") != "unchanged") == 0).alias("stable"))
