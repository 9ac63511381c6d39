"""Index, retrieve and materialise: the composed pipelines."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandwork import config
from strandwork.functions import paths, text
from strandwork.operators import evidence, extract, graph, joins, python_source, ranking, script_source
from strandwork.operators.settle import settled


@dataclass(frozen=True)
class Index:
    """files(path, content, hash, language), definitions, calls, imports, resolved dependencies(src, dst, pos) and symbols(path, name, definition_name)."""

    files: DataFrame
    definitions: DataFrame
    calls: DataFrame
    imports: DataFrame
    deps: DataFrame
    symbols: DataFrame

    def cached(self) -> Index:
        """The same with its parts kept after first use, as several steps read each."""
        return Index(*(getattr(self, f.name).cache() for f in fields(self)))


def module_name(path):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"/__init__$", ""), "/", ".")


def build_index(files: DataFrame) -> Index:
    """The index of all indexable files(path, content)."""
    files = files.where(paths.is_indexable(F.col("path"))).select("path", "content", F.sha2("content", 256).alias("hash"), paths.suffix(F.col("path")).alias("language"))
    python, script = files.where("language = 'py'"), files.where("language IN ('js', 'jsx', 'ts', 'tsx')")
    columns = ["path", "name", "qualified_name", "owner", "kind", "start_line", "end_line", "line_count", "text"]
    scripts = script_source.definitions(script).withColumns({"qualified_name": F.col("name"), "owner": F.lit(None).cast("string")})
    definitions = python_source.definitions(python).select(*columns).unionByName(scripts.select(*columns))
    imports = python_source.imports(python)
    package = F.when(F.col("path").endswith("__init__.py"), module_name(F.col("path"))).otherwise(F.regexp_replace(module_name(F.col("path")), r"\.?[^.]*$", ""))
    full = imports.select(F.col("path").alias("src"), joins.rebased_import(F.col("imported"), package).alias("imported"))
    modules = python.select(module_name(F.col("path")).alias("module"), "path")
    found = joins.longest_prefix(full, modules, "src").select("src", "path")
    relative = script.select(F.col("path").alias("src"), F.explode(extract.generic_imports(F.col("content"))).alias("target")).where("target LIKE '.%'")
    base = joins.lexical_path(F.concat_ws("/", F.regexp_replace("src", "/?[^/]*$", ""), F.col("target")))
    scripts_found = joins.first_choice(relative.withColumn("base", base), script.select("path"), joins.script_choices(F.col("base")), "src", "base").select("src", "path")
    deps = joins.dependencies(found.union(scripts_found)).select("src", F.posexplode("dependencies").alias("pos", "dst"))
    symbols = python_source.symbols(python).select("path", "name", "definition_name").unionByName(scripts.select("path", "name", F.lit(None).cast("string").alias("definition_name")))
    return Index(files, definitions, python_source.calls(python), imports, deps, symbols)


def resolved_calls(index: Index) -> DataFrame:
    """(src_path, src, pos, dst_path, dst): calls whose owner is clear."""
    calls = index.calls.select(F.col("path").alias("src"), F.coalesce("owner", F.lit("")).alias("owner"), "callee", "receiver", "definition", "pos")
    found = index.definitions.where("NOT (kind = 'class' AND owner IS NOT NULL)").select("path", "name", "owner", "qualified_name")
    clear = joins.unique_owner(calls, found, joins.callable_owners(index.symbols), index.deps)
    one = found.groupBy("path", "name").agg(F.min("qualified_name").alias("one"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    # a self call reaches its own class, whatever else has the name
    dst = F.when(F.col("receiver") == "self", F.concat_ws(".", "owner", "name")).otherwise(F.col("one"))
    met = calls.join(clear, ["src", "owner", "callee", "receiver"]).join(one, ["path", "name"], "left").withColumn("dst", dst).where("dst IS NOT NULL")
    return met.select(F.col("src").alias("src_path"), F.col("definition").alias("src"), "pos", F.col("path").alias("dst_path"), "dst")


def retrieve(index: Index, tasks: DataFrame, limit: int = config.DEFAULT_FILES) -> DataFrame:
    """(task_id, path, source, rank): files for tasks(task_id, text): named ones, ranked seeds, what calls reach, what lies around."""
    symbols = index.definitions.groupBy("path").agg(F.collect_list("qualified_name").alias("symbols"))
    own_imports = index.imports.groupBy("path").agg(F.collect_list("imported").alias("imports"))
    none = F.array().cast("array<string>")
    files = index.files.join(symbols, "path", "left").join(own_imports, "path", "left").select(
        "path", F.coalesce("symbols", none).alias("symbols"), F.coalesce("imports", none).alias("imports"), none.alias("tags"), none.alias("important"), F.lit("").alias("summary"), F.lit(False).alias("complete")
    )
    words = tasks.select("task_id", text.task_words(F.col("text")).alias("words"))
    order = [F.desc("score"), F.lower("path"), F.col("path")]
    wanted = words.select("task_id", F.explode("words").alias("key")).withColumn("n", F.lit(1).cast("long"))
    points = settled(ranking.word_points(wanted.select(F.col("key").alias("word")), files).withColumnRenamed("word", "key"))
    seeds = settled(ranking.top_sums(wanted, points, config.SEEDS, order, "path"))
    named = tasks.select("task_id", F.posexplode(paths.file_tokens(F.col("text"))).alias("at", "token"))
    explicit = joins.file_references(named, index.files.select("path"), "task_id", "at")
    # roots of the call closure: definitions that share a token with the task, most first
    one = F.lit(1).cast("long")
    found = tasks.select("task_id", F.explode(text.tokens(F.col("text"))).alias("key")).distinct().withColumn("n", one)
    own = index.definitions.select("path", F.col("qualified_name").alias("name"), F.explode(text.tokens(F.col("name"))).alias("key")).distinct().withColumn("points", one)
    roots = settled(ranking.top_sums(found, settled(own), 4, [F.desc("score"), F.col("path"), F.col("name")], "path", "name"))
    closure = evidence.rooted_closure(roots, resolved_calls(index).cache())
    around = graph.best_neighbours(seeds, index.deps, index.definitions.select("path", "name"), config.CANDIDATES, order)
    ranked = lambda df, c: df.select("task_id", "path", F.col(c).cast("int").alias("at"))
    chosen = ranking.ordered_union(
        (ranked(explicit, "at"), "explicit"), (ranked(seeds, "rank"), "ranked"), (ranked(roots, "rank"), "root"), (ranked(closure, "rank"), "call"), (ranked(around, "rank"), "neighbour"), keys=["task_id"], value="path", order="at"
    )
    return chosen.where(F.col("rank") <= limit)


def candidates(index: Index, tasks: DataFrame, chosen: DataFrame) -> DataFrame:
    """Scored definitions of the chosen files for every evidence kind of their task, as evidence.plan takes them."""
    wanted = tasks.select("task_id", text.domain_terms(F.col("text")).alias("terms"), text.requirement_roles(text.tokens(F.col("text"))).alias("roles"))
    wanted = wanted.withColumn("__class", F.sha2(F.to_json(F.struct("terms", "roles")), 256))
    asked = settled(chosen.join(wanted, "task_id").select("task_id", "__class", "terms", "roles", "path", (F.col("source") == "explicit").alias("existing")))
    # tasks that want the same score a file's definitions once
    once = asked.groupBy("__class", "path", "existing").agg(F.first("terms").alias("terms"), F.first("roles").alias("roles"))
    own = index.definitions.select("path", "qualified_name", "text", "line_count", text.tokens(F.col("qualified_name")).alias("__name"))
    kinds = F.posexplode(evidence.kinds_of(F.array_union("roles", F.array(F.lit("domain"))))).alias("kind_no", "k")
    each = once.withColumn("__roles", evidence.path_roles(F.col("path"))).join(own, "path").select("*", kinds).select("*", "k.kind", "k.limit")
    score = evidence.kind_score(
        F.col("kind"), name_tokens=F.col("__name"), body=F.col("text"), path=F.col("path"), roles=F.col("__roles"), terms=F.col("terms"), lines=F.col("line_count"), existing=F.col("existing")
    )
    scored = settled(each.select("__class", "path", "existing", "kind_no", "kind", "limit", F.col("qualified_name").alias("name"), score.alias("score"), F.col("line_count").alias("lines")))
    return asked.select("task_id", "__class", "path", "existing").join(scored, ["__class", "path", "existing"]).select("task_id", "kind_no", "kind", "limit", "path", "name", "score", "lines")


def materialise(index: Index, planned: DataFrame, budget: int = config.SOFT_BUDGET) -> DataFrame:
    """(task_id, document, blocks, skipped): the planned definitions' text, redacted, within the budget; what doesn't fit is skipped."""
    planned = settled(planned.select("task_id", "order_no", "path", "name"))
    own = index.definitions.select("path", F.col("qualified_name").alias("name"), F.col("text").alias("body"), "start_line", "end_line").join(planned.select("path", "name").distinct(), ["path", "name"], "left_semi")
    own = own.groupBy("path", "name").agg(F.min_by(F.struct("body", "start_line", "end_line"), "start_line").alias("d"))
    head = F.concat(F.lit("## "), F.col("path"), F.lit(" "), F.col("name"), F.lit(" lines "), F.col("d.start_line").cast("string"), F.lit("-"), F.col("d.end_line").cast("string"), F.lit("\n"))
    blocks = settled(own.select("path", "name", F.concat(head, text.redact(F.col("d.body"))).alias("block")))  # once for all tasks that take it
    sizes = planned.join(blocks.select("path", "name", F.length("block").alias("size")), ["path", "name"])
    fits = ranking.skip_budget(sizes.select("task_id", "order_no", "size"), "size", "order_no", budget, "task_id")
    kept = planned.join(blocks, ["path", "name"]).select("task_id", "order_no", "block").join(fits.select("task_id", "order_no", "taken"), ["task_id", "order_no"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("taken"), F.struct("order_no", "block")))), lambda x: x["block"]), "\n")
    return kept.groupBy("task_id").agg(joined.alias("document"), F.count_if("taken").alias("blocks"), F.count_if(~F.col("taken")).alias("skipped"))


def update_index(old: DataFrame, files: DataFrame, analyse) -> DataFrame:
    """The rows of an index after a change: unchanged files(path, hash) keep theirs, others are analysed, deleted ones go.

    old(path, hash, ...) are the stored rows; analyse turns files(path, content, hash) into
    rows of the same form. A row whose text is what a deleted path had carries renamed_from.
    """
    now = files.select("path", "content", F.sha2("content", 256).alias("hash"))
    same = old.join(now.select("path", "hash"), ["path", "hash"], "left_semi")
    fresh = now.join(old.select("path", "hash"), ["path", "hash"], "left_anti")
    moved = joins.renames(joins.snapshot_diff(old.select("path", "hash"), now.select("path", "hash")))
    rows = analyse(fresh).drop("renamed_from").join(moved, "path", "left")
    return same.select(*rows.columns).unionByName(rows) if "renamed_from" in same.columns else same.withColumn("renamed_from", F.lit(None).cast("string")).unionByName(rows)


def newest(rows: DataFrame) -> DataFrame:
    """Of index rows written over time (path, seq, ...) the last of each path, unless that says it was deleted."""
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seq")))
    rows = rows.withColumn("__n", last).where("__n = 1").drop("__n")
    return rows.where("NOT deleted").drop("deleted") if "deleted" in rows.columns else rows
