"""What a task names or is structurally tied to: symbols, commands, request handlers, callbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.functions import paths
from strandwork.operators import ranking
from strandwork.operators.settle import settled

# Request methods, and the points of each kind of evidence.
METHODS = "GET|POST|PUT|PATCH|DELETE|OPTIONS"
CLASS_POINTS, CALL_POINTS, COMMAND_POINTS = 200, 180, 240
HANDLERS, HANDLER_POINTS, HANDLER_BASE, OPTIONS_POINTS, MISSING_POINTS, PRESENT_POINTS = 3, 20, 120, 50, 80, 40
CALLBACK_BASE, CALLBACK_POINTS, BOUND_POINTS, LITERAL_POINTS = 300, 70, 50, 120


def hinted(symbols: DataFrame, hints: DataFrame, *keys: str) -> DataFrame:
    """(keys..., path, name) of symbols(path, name) that hints(keys..., hint) name, without regard to case."""
    wanted = hints.select(*keys, F.lower("hint").alias("__key")).distinct()
    # both sides are distinct, and a name has one key, so the join has no row twice
    return symbols.select("path", "name").distinct().withColumn("__key", F.lower("name")).join(wanted, "__key").select(*keys, "path", "name")


def explicit(tokens: DataFrame, symbols: DataFrame, top: int = 8) -> DataFrame:
    """(task_id, path, score, rank): files whose symbols(path, name, qualified_name) tokens(task_id, token, kind) name.

    A class token counts by name or qualified name, a call token by name; each distinct token adds its points.
    """
    names = symbols.select("path", "name", F.explode(F.array_distinct(F.array_compact(F.array("name", "qualified_name")))).alias("token"))
    names = names.groupBy("path", "token").agg(F.max(F.coalesce(F.col("token") == F.col("name"), F.lit(False))).alias("own"))
    # files that define the same under the same names score alike: only the first of them are met with tasks
    defined = names.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("token", "own"))).alias("__set")).withColumn("__class", F.sha2(F.to_json("__set"), 256))
    first = settled(ranking.top_k(defined, top, ["__class"], [F.lower("path"), F.col("path")], "__n"))
    held = first.where("__n = 1").select("__class", F.inline("__set"))
    met = tokens.distinct().join(held, "token").where("kind = 'class' OR own")
    points = F.when(F.col("kind") == "class", CLASS_POINTS).otherwise(CALL_POINTS)
    scored = met.groupBy("task_id", "__class").agg(F.sum(points).alias("score")).join(first.select("__class", "path"), "__class").select("task_id", "path", "score")
    return ranking.top_k(scored, top, ["task_id"], [F.desc("score"), F.lower("path"), F.col("path")])


def commands(tasks: DataFrame, known: DataFrame) -> DataFrame:
    """(task_id, path, function_name, score): commands known(path, function_name, name) that a task's text names, by name or else by function."""
    words = tasks.select("task_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_-]+"), F.lit(0)))).alias("word"))
    own = known.select("path", "function_name", F.coalesce("name", "function_name").alias("word")).distinct()
    return words.join(own, "word").select("task_id", "path", "function_name", F.lit(COMMAND_POINTS).alias("score"))


def transport_roots(files: DataFrame, definitions: DataFrame, deps: DataFrame, seeds: DataFrame, top: int = 2) -> DataFrame:
    """(task_id, path, owner, handlers, score, rank): classes that handle requests as the code of seeds(task_id, path) sends them.

    Of files(path, content) the seeds' text tells the methods; definitions(path, name, owner,
    kind) tells the classes with three do_<METHOD> methods or more; deps(src, dst) must tie
    the class's file to a seed. A method that no sibling handles yet counts most.
    """
    asked = F.regexp_extract_all("content", F.lit(rf"(?i)\bmethod\s*[:=]\s*[^\r\n]{{0,80}}?['\"]({METHODS})['\"]"), F.lit(1))
    requested = seeds.join(files, "path").select("task_id", F.explode(asked).alias("method")).groupBy("task_id").agg(F.collect_set(F.upper("method")).alias("requested"))
    classes = definitions.where("kind = 'class' AND owner IS NULL").select("path", F.col("name").alias("owner")).distinct()
    handlers = definitions.where(F.col("owner").isNotNull() & F.col("name").rlike(f"^do_(?:{METHODS})$") & F.lower("path").endswith(".py"))
    owners = handlers.groupBy("path", "owner").agg(F.array_sort(F.collect_set("name")).alias("handlers")).where(F.size("handlers") >= HANDLERS).join(classes, ["path", "owner"], "left_semi")
    near = seeds.join(deps, F.col("path") == F.col("dst")).select("task_id", F.col("src").alias("path")).distinct().join(seeds, ["task_id", "path"], "left_anti")
    met = near.join(owners, "path").join(requested, "task_id")
    methods = F.transform("handlers", lambda h: F.substring(h, 4, 10))
    score = HANDLER_POINTS * F.size("handlers") + HANDLER_BASE + F.when(F.array_contains("handlers", "do_OPTIONS"), OPTIONS_POINTS).otherwise(0)
    score += F.when(F.size(F.array_except("requested", methods)) > 0, MISSING_POINTS).otherwise(PRESENT_POINTS)
    met = met.select("task_id", "path", "owner", "handlers", score.alias("score"))
    return ranking.top_k(met, top, ["task_id"], [F.desc("score"), F.lower("path"), F.lower("owner"), F.col("path"), F.col("owner")])


def alternative_callbacks(bindings: DataFrame, terms: DataFrame, tasks: DataFrame, attempted: DataFrame, top: int = 3) -> DataFrame:
    """(task_id, path, command, callback, score, rank): other callbacks for a parameter whose attempted(task_id, callback) one didn't do.

    bindings(path, command, parameter, callback) outside tests; terms(path, definition, word,
    weight) are the words of the callbacks' strings. What tasks(task_id, text) says in the
    names and strings decides among them.
    """
    bound = bindings.where(~paths.is_test(F.col("path"))).distinct()
    tried = attempted.select("task_id", "callback").distinct()
    parameters = bound.join(tried, "callback").select("task_id", "parameter").distinct()
    met = bound.join(parameters, "parameter").join(tried, ["task_id", "callback"], "left_anti")
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 3))
    literal = terms.groupBy("path", F.col("definition").alias("callback")).agg(F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias("literals"))
    met = met.join(tasks.select("task_id", words.alias("words")), "task_id").join(literal, ["path", "callback"], "left")
    shared = lambda c: F.size(F.array_intersect("words", F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))))
    weight = F.coalesce(F.aggregate("words", F.lit(0), lambda a, w: a + F.coalesce(F.try_element_at("literals", w), F.lit(0))), F.lit(0))
    split = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" "))
    score = CALLBACK_BASE + CALLBACK_POINTS * shared(split("callback")) + BOUND_POINTS * shared(split("command")) + LITERAL_POINTS * F.when(F.col("literals").isNull(), 0).otherwise(weight)
    met = met.select("task_id", "path", "command", "parameter", "callback", score.alias("score"))
    return ranking.top_k(met, top, ["task_id"], [F.desc("score"), F.lower("path"), F.lower("callback"), F.col("command"), F.col("parameter")])


def legacy_score(path: Column, content: Column, words: list[str], *, changed: Column, important: Column) -> Column:
    """A file's score: changed 1000, important 50, each word in the name 100 or else in the path 50, and 5 for each time it stands in the text, ten at most."""
    name, low = F.lower(paths.file_name(path)), F.lower(content)
    score = F.when(changed, 1000).otherwise(0) + F.when(important, 50).otherwise(0)
    for w in words:
        times = F.floor((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w))
        score += F.when(F.contains(name, F.lit(w)), 100).when(F.contains(F.lower(path), F.lit(w)), 50).otherwise(0) + 5 * F.least(F.lit(10), F.coalesce(times, F.lit(0)))
    return score


def contains_points(words: Column, points: dict[str, int]) -> Column:
    """Points for each of a few words that each column holds, without regard to case."""
    held = lambda column: F.size(F.filter(words, lambda w: F.contains(F.lower(column), w)))
    return sum((n * held(column) for column, n in points.items()), F.lit(0))


def shown(df: DataFrame, rendered: DataFrame, key: str, label: str) -> DataFrame:
    """(key, shown): each selected row's label, marked where rendered(key) hasn't got it."""
    there = rendered.select(key, F.lit(True).alias("__there")).distinct()
    return df.join(there, key, "left").select(key, F.concat(label, F.when(F.col("__there").isNull(), " (unavailable)").otherwise("")).alias("shown"))


def mentioned_by(definitions: DataFrame, known: DataFrame, shape: str = "[A-Za-z_$][A-Za-z0-9_$]*") -> DataFrame:
    """(path, other_path, name): definitions(path, text) whose text holds the whole identifier that known(path, name) defines, a name once."""
    words = definitions.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(shape), F.lit(0)))).alias("name"))
    return words.join(known.select(F.col("path").alias("other_path"), "name"), "name").where("path <> other_path").select("path", "other_path", "name")


def one_hop(links: DataFrame, most: int = 4) -> DataFrame:
    """(path, other, rank): what links(path, other_path) tie to a path, either way, the first most."""
    both = links.select("path", F.col("other_path").alias("other")).union(links.select("other_path", "path")).distinct()
    return ranking.top_k(both, most, ["path"], [F.col("other")])


def first_and_more(df: DataFrame, value: str, *keys: str, limit: int = 10) -> DataFrame:
    """(keys..., shown): the first values in order, and how many more there are. No list is longer than limit."""
    nth = ranking.top_k(df.where(F.col(value).isNotNull()).select(*keys, value).distinct(), limit, list(keys), [F.col(value)])
    n = df.groupBy(*keys).agg(F.count_distinct(value).alias("n"))
    joined = nth.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", value))), lambda x: x[value].cast("string")), ", ").alias("first"))
    more = F.when(F.col("n") > limit, F.concat(F.lit(" … and "), (F.col("n") - limit).cast("string"), F.lit(" more"))).otherwise("")
    return n.join(joined, list(keys), "left").select(*keys, F.concat(F.coalesce("first", F.lit("")), more).alias("shown"))


def tree(files: DataFrame, limit: int) -> DataFrame:
    """(path, line): the first paths in order, and a mark after them if there are more."""
    first = files.select("path", F.col("path").alias("line")).orderBy("path").limit(limit)
    more = files.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(F.lit("~").alias("path"), F.lit("[tree truncated]").alias("line"))
    return first.union(more)
