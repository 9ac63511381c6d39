"""Joins with a rule: longest prefix, unique match, intervals, snapshots, ordered fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandwork import config


def prefixes(dotted: Column) -> Column:
    """a.b.c as [a, a.b, a.b.c]."""
    parts = F.split(dotted, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def rebased_import(imported: Column, package: Column) -> Column:
    """A relative import on its package, one level up for each dot beyond the first; others as they are."""
    dots = F.length(F.regexp_extract(imported, r"^(\.*)", 1))
    parts = F.split(package, r"\.")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots + 1, F.lit(0))), ".")
    return F.when(dots == 0, imported).otherwise(F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(F.regexp_replace(imported, r"^\.+", ""), F.lit(""))))


def longest_prefix(imports: DataFrame, modules: DataFrame, *keys: str) -> DataFrame:
    """imports(keys..., imported) with the path of the longest module(module, path) that is a prefix; unresolved rows go."""
    each = imports.select(*keys, "imported", F.explode(prefixes(F.col("imported"))).alias("module"))
    hit = each.join(modules, "module").groupBy(*keys, "imported").agg(F.max_by("path", F.struct(F.length("module"), "path")).alias("path"))
    return hit


def first_choice(imports: DataFrame, files: DataFrame, choices: Column, *keys: str) -> DataFrame:
    """imports(keys...) with the first of an array of candidate paths that is a file(path)."""
    each = imports.select(*keys, F.posexplode(choices).alias("__pos", "path"))
    return each.join(files, "path").groupBy(*keys).agg(F.min_by("path", "__pos").alias("path"))


SCRIPT_SUFFIXES = ("ts", "tsx", "js", "jsx")


def script_choices(base: Column) -> Column:
    """Where a relative script import may be: the path itself, with a suffix, or an index file below it."""
    tails = ["", *[f".{s}" for s in SCRIPT_SUFFIXES], *[f"/index.{s}" for s in SCRIPT_SUFFIXES]]
    return F.array(*[F.concat(base, F.lit(t)) for t in tails])


def dependencies(resolved: DataFrame, limit: int = config.MAX_DEPENDENCIES) -> DataFrame:
    """(src, dependencies): distinct targets of resolved(src, path) other than itself, sorted, at most limit."""
    edges = resolved.where("src <> path").groupBy("src").agg(F.array_sort(F.collect_set("path")).alias("dependencies"))
    return edges.withColumn("dependencies", F.slice("dependencies", 1, limit))


def owner_index(symbols: DataFrame) -> DataFrame:
    """(key, path, name): each symbol(path, name, definition_name) under its lower-cased names, distinct."""
    keys = F.array_compact(F.array(F.lower("name"), F.lower("definition_name")))
    return symbols.select(F.explode(keys).alias("key"), "path", "name").distinct()


def callable_owners(symbols: DataFrame) -> DataFrame:
    """(key, path, name): the definition behind each symbol(path, name, definition_name), under its lower-cased names, distinct."""
    keys = F.array_compact(F.array(F.lower("name"), F.lower("definition_name")))
    return symbols.select(F.explode(keys).alias("key"), "path", F.coalesce("definition_name", "name").alias("name")).distinct()


def lexical_path(path: Column) -> Column:
    """A path with its . and .. parts resolved; a .. that leads above the root stays."""
    none = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(kept) > 0)
        return F.when(part.isin("", "."), kept).when(up, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(F.concat(kept, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")


def unique_owner(calls: DataFrame, definitions: DataFrame, owners: DataFrame, deps: DataFrame) -> DataFrame:
    """calls(src, owner, callee, receiver) with the (path, name) of the one definition that fits, by the first rule that has exactly one.

    owner is the class that the call stands in. 1. Of definitions(path, name, owner) in the
    same file: any for a bare call, those of its own class for a self call. A self call goes no
    further. 2. Of owners(key, path, name), by lower-cased name: those in direct
    dependencies(src, dst). 3. All owners, for bare and member calls. Others get no row.
    """
    calls = calls.select("src", "owner", "callee", "receiver").distinct().withColumn("key", F.lower("callee"))
    owners = owners.select("key", "path", "name").distinct()
    # each rule's single owners first, so that no call meets all owners of a common name
    known = definitions.select(F.col("path").alias("src"), F.col("name").alias("callee"), "owner")
    one = lambda df, value, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), value).where("n = 1").drop("n")
    bare = one(known, F.first("src").alias("a"), "src", "callee").withColumn("receiver", F.lit("bare"))
    own = one(known.where(F.col("owner").isNotNull()), F.first("src").alias("b"), "src", "owner", "callee").withColumn("receiver", F.lit("self"))
    target = F.first(F.struct("path", "name"))
    near = one(deps.select("src", F.col("dst").alias("path")).distinct().join(owners, "path"), target.alias("near"), "src", "key")
    free = one(owners, target.alias("free"), "key")
    out = calls.join(bare, ["src", "callee", "receiver"], "left").join(own, ["src", "owner", "callee", "receiver"], "left").join(near, ["src", "key"], "left").join(free, "key", "left")
    here = F.coalesce("a", "b")
    same = F.when(here.isNotNull(), F.struct(here.alias("path"), F.col("callee").alias("name")))
    hit = F.coalesce(same, F.when(F.col("receiver") != "self", F.col("near")), F.when(F.col("receiver").isin("bare", "member"), F.col("free")))
    return out.select("src", "owner", "callee", "receiver", hit.alias("hit")).where("hit IS NOT NULL").select("src", "owner", "callee", "receiver", "hit.*")


def smallest_overlap(ranges: DataFrame, definitions: DataFrame, *keys: str, width: int = 256) -> DataFrame:
    """ranges(keys..., start, end) with the smallest definition(keys..., name, d_start, d_end) they touch.

    Both sides are cut into bins of width, so the join is on keys and bin; ties go to the earlier start, then name.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))).alias("__bin")
    left = ranges.select("*", bins("start", "end"))
    right = definitions.select(*keys, "name", "d_start", "d_end", bins("d_start", "d_end"))
    met = left.join(right, [*keys, "__bin"]).where("start <= d_end AND d_start <= end")
    best = F.struct((F.col("d_end") - F.col("d_start")).alias("size"), "d_start", "name", "d_end")
    return met.groupBy(*keys, "start", "end").agg(F.min(best).alias("x")).select(*keys, "start", "end", "x.name", "x.d_start", "x.d_end")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, old_hash, new_hash, change): added, changed, unchanged or deleted between (path, hash) snapshots."""
    both = old.withColumnRenamed("hash", "old_hash").join(new.withColumnRenamed("hash", "new_hash"), "path", "full_outer")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("changed")
    return both.select("path", "old_hash", "new_hash", change.alias("change"))


def renames(diff: DataFrame) -> DataFrame:
    """(path, renamed_from): added paths whose hash a deleted path had; the last such path counts."""
    gone = diff.where("change = 'deleted'").groupBy(F.col("old_hash").alias("hash")).agg(F.max("path").alias("renamed_from"))
    return diff.where("change = 'added'").join(gone, F.col("new_hash") == F.col("hash")).select("path", "renamed_from")


def stale_paths(wanted: DataFrame, recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(path, reason) of wanted paths whose recorded and current hashes differ: missing, changed or unexpected."""
    df = wanted.select("path").join(recorded.withColumnRenamed("hash", "was"), "path", "left").join(current.withColumnRenamed("hash", "now"), "path", "left")
    reason = F.when(F.col("was").isNotNull() & F.col("now").isNull(), "missing").when(F.col("was").isNull() & F.col("now").isNotNull(), "unexpected").otherwise("changed")
    return df.where(~F.col("was").eqNullSafe(F.col("now"))).select("path", reason.alias("reason"))


def not_covered(sets: DataFrame, scope: DataFrame, *keys: str) -> DataFrame:
    """(keys..., supersedes): whether the group's paths reach beyond scope(keys..., path); an empty scope is never left."""
    known = scope.select(*keys, "path", F.lit(1).alias("__in")).distinct()
    out = sets.join(known, [*keys, "path"], "left").groupBy(*keys).agg(F.count_if(F.col("__in").isNull()).alias("__out"))
    some = scope.select(*keys).distinct().withColumn("__some", F.lit(True))
    return out.join(some, list(keys), "left").select(*keys, (F.col("__some").isNotNull() & (F.col("__out") > 0)).alias("supersedes"))


def unique_by(df: DataFrame, key: str | Column, value: str) -> DataFrame:
    """(key, value) of keys that have exactly one value."""
    key = F.col(key) if isinstance(key, str) else key
    return df.groupBy(key.alias("key")).agg(F.count_distinct(value).alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")


def prioritised(*ranked: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each key the value of the first frame that has one."""
    all_ = None
    for i, df in enumerate(ranked):
        own = df.select(*keys, value, F.lit(i).alias("__rule"))
        all_ = own if all_ is None else all_.union(own)
    return all_.groupBy(*keys).agg(F.min_by(value, F.struct("__rule", value)).alias(value))


def ambiguous(df: DataFrame, key: Column, value: str) -> DataFrame:
    """df's rows whose key has more than one value."""
    n = F.size(F.collect_set(value).over(Window.partitionBy(key)))
    return df.withColumn("__n", n).where("__n > 1").drop("__n")


def file_references(tokens: DataFrame, files: DataFrame, *keys: str) -> DataFrame:
    """tokens(keys..., token) with the file each names: exact path, else path without case, else unique name, else unique stem."""
    name = F.element_at(F.split(F.lower("path"), "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    same = tokens.join(files.select("path", F.col("path").alias("token")), "token")
    cased = tokens.join(unique_by(files, F.lower("path"), "path"), F.lower("token") == F.col("key")).drop("key")
    named = tokens.join(unique_by(files, name, "path"), F.lower("token") == F.col("key")).drop("key")
    rooted = tokens.join(unique_by(files, stem, "path"), F.lower("token") == F.col("key")).drop("key")
    return prioritised(same, cased, named, rooted, keys=[*keys, "token"], value="path")


def mapped_tests(sources: DataFrame, tests: DataFrame) -> DataFrame:
    """sources(path) with the one test(path) named test_<stem>.py, and n_tests; null unless there is exactly one."""
    name = F.element_at(F.split("path", "/"), -1)
    wanted = sources.select("path", F.concat(F.lit("test_"), name).alias("key"))
    own = tests.select(F.col("path").alias("test_path"), name.alias("key"))
    by = wanted.join(own, "key", "left").groupBy("path").agg(F.count("test_path").alias("n_tests"), F.min("test_path").alias("test_path"))
    return by.withColumn("test_path", F.when(F.col("n_tests") == 1, F.col("test_path")))


def failed_hunks(hunks: DataFrame, errors: DataFrame) -> DataFrame:
    """hunks(path, line) that errors(path, line) name by path and line, else by path, else all."""
    exact = hunks.join(errors, ["path", "line"], "left_semi").withColumn("rule", F.lit(1))
    by_path = hunks.join(errors.select("path").distinct(), "path", "left_semi").withColumn("rule", F.lit(2))
    rows = exact.unionByName(by_path).unionByName(hunks.withColumn("rule", F.lit(3)))
    return rows.join(rows.agg(F.min("rule").alias("rule")), "rule").select(*rows.columns)
