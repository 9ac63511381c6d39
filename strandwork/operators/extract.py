"""Extraction by regular expressions and windows: one text to many rows, JVM-side throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandwork import config

#: Declarations of JavaScript and TypeScript: classes, interfaces, functions, enums, types, arrow constants.
DECLARATION = r"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?(?:async[ \t]+)?(class|interface|function|enum|type|const)[ \t]+([A-Za-z_$][A-Za-z0-9_$]*)"
ARROW = r"(?m)^[ \t]*(?:export[ \t]+)?const[ \t]+([A-Za-z_$][A-Za-z0-9_$]*)(?:[ \t]*:[^=\n]+)?[ \t]*=[ \t]*(?:async[ \t]*)?(?:\([^)\n]*\)|[A-Za-z_$][A-Za-z0-9_$]*)(?:[ \t]*:[^=\n]+)?[ \t]*=>"
IMPORT = r"""(?:\bfrom[ \t]+|\brequire\([ \t]*|^[ \t]*import[ \t]+)["']([^"'\n]+)["']"""


def lines(df: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """(keep..., line_no, line), line_no from 1; a last line without characters doesn't count."""
    parts = F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), "\n")
    df = df.select(*keep, F.posexplode(parts).alias("at", "line"), F.size(parts).alias("__n"))
    return df.where(~((F.col("at") == F.col("__n") - 1) & (F.col("line") == ""))).select(*keep, (F.col("at") + 1).alias("line_no"), "line")


def generic_symbols(text: Column) -> Column:
    """Array of (name, kind) of declarations, at most MAX_SYMBOLS; arrow constants are functions, other constants nothing."""
    found = F.regexp_extract_all(text, F.lit(DECLARATION), F.lit(0))
    pairs = F.transform(found, lambda d: F.struct(F.regexp_extract(d, DECLARATION, 2).alias("name"), F.regexp_extract(d, DECLARATION, 1).alias("kind")))
    arrows = F.regexp_extract_all(text, F.lit(ARROW), F.lit(1))
    named = F.transform(F.filter(pairs, lambda p: (p["kind"] != "const") | F.array_contains(arrows, p["name"])), lambda p: F.struct(p["name"].alias("name"), F.when(p["kind"] == "const", "function").otherwise(p["kind"]).alias("kind")))
    return F.slice(F.array_distinct(named), 1, config.MAX_SYMBOLS)


def generic_imports(text: Column) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit("(?m)" + IMPORT), F.lit(1))), 1, config.MAX_IMPORTS)


def named_targets(df: DataFrame, text: str, pattern: str, *keys: str) -> DataFrame:
    """(keys..., target): what the first group of a pattern finds, a row each time."""
    return df.select(*keys, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("target"))


def literal_terms(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys..., word, weight): words of markup text weigh 2, of quoted strings 1; the heavier counts."""
    quoted = F.regexp_extract_all(F.col(text), F.lit("\"([^\"\\n]*)\""), F.lit(1))
    shown = F.regexp_extract_all(F.col(text), F.lit(">([^<>{}]+)<"), F.lit(1))
    words = lambda arr: F.filter(F.regexp_extract_all(F.lower(F.array_join(arr, " ")), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    both = F.concat(F.transform(F.array_distinct(words(quoted)), lambda w: F.struct(w.alias("word"), F.lit(1).alias("weight"))), F.transform(F.array_distinct(words(shown)), lambda w: F.struct(w.alias("word"), F.lit(2).alias("weight"))))
    return df.select(*keys, F.explode(both).alias("x")).groupBy(*keys, "x.word").agg(F.max("x.weight").alias("weight"))


def static_summary(language: Column, path: Column, names: Column) -> Column:
    """One sentence on a file: its language, path and first eight names."""
    return F.left(F.concat(language, F.lit(" file "), path, F.when(F.size(names) > 0, F.concat(F.lit(" with "), F.array_join(F.slice(names, 1, 8), ", "))).otherwise(""), F.lit(".")), F.lit(config.SUMMARY_CHARS))


def static_tags(language: Column, path: Column, names: Column) -> Column:
    """The first ten distinct lower-cased words of two letters or more of language, path and names."""
    words = F.flatten(F.array(F.array(F.lower(language)), F.split(F.lower(path), "[^a-z0-9]+"), F.flatten(F.transform(names, lambda n: F.split(F.lower(F.regexp_replace(n, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+")))))
    clean = F.filter(F.transform(words, lambda w: F.left(w, F.lit(config.TAG_CHARS))), lambda w: F.length(w) >= 2)
    return F.slice(F.array_distinct(clean), 1, config.TAGS)


def test_failures(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys..., test_id): distinct failing tests named by unittest or pytest lines; totals name none."""
    named = F.coalesce(F.nullif(F.regexp_extract("line", r"^(?:FAIL|ERROR): \S+ \(([^)]+)\)", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"^FAILED (\S+::\S+)", 1), F.lit("")))
    return lines(df, text, *keys).select(*keys, named.alias("test_id")).where("test_id IS NOT NULL").distinct()


def report_fields(text: Column) -> dict[str, Column]:
    """status, exit_code, command and duration of a saved report; null where a line is missing."""
    field = lambda name: F.nullif(F.regexp_extract(text, rf"(?m)^{name}: *(.*)$", 1), F.lit(""))
    return {
        "status": field("Status"), "exit_code": field("Exit code").try_cast("int"),
        "command": field("Command"), "duration": F.regexp_replace(field("Duration"), " *s(?:econds)?$", "").try_cast("double"),
    }


def traceback_paths(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys..., path, line_no): files of a traceback, each with the line named first."""
    shape = 'File "([^"]+)", line ([0-9]+)'
    hits = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(shape), F.lit(0))).alias("at", "hit"))
    return hits.groupBy(*keys, F.regexp_extract("hit", shape, 1).alias("path")).agg(F.min_by(F.regexp_extract("hit", shape, 2).cast("int"), "at").alias("line_no"))


def failure_excerpt(numbered: DataFrame, needle: str, *keys: str, before: int = 2, most: int = 180) -> DataFrame:
    """Lines from before the first mention of needle up to the next FAIL or ERROR header, at most most."""
    by = Window.partitionBy(*keys)
    first = F.min(F.when(F.contains("line", F.lit(needle)), F.col("line_no"))).over(by)
    df = numbered.withColumn("__first", first).where(F.col("__first").isNotNull() & (F.col("line_no") >= F.col("__first") - before))
    stop = F.min(F.when((F.col("line_no") > F.col("__first")) & F.col("line").rlike("^(?:FAIL|ERROR)"), F.col("line_no"))).over(by)
    df = df.withColumn("__stop", stop).where(F.col("__stop").isNull() | (F.col("line_no") < F.col("__stop")))
    return df.where(F.col("line_no") < F.col("__first") - before + most).drop("__first", "__stop")


def owner_groups(df: DataFrame, is_owner: Column, order: str, *keys: str) -> DataFrame:
    """df with owner_no: how many owners stand at or before the row; fragments after an owner share its number."""
    return df.withColumn("owner_no", F.sum(is_owner.cast("int")).over(Window.partitionBy(*keys).orderBy(order)))


def hunk_ranges(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys..., pos, start_line, end_line) of the new sides of hunk headers; a count of 0 is one line."""
    shape = r"(?m)^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@"
    hits = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(shape), F.lit(0))).alias("pos", "hit"))
    count = F.greatest(F.coalesce(F.nullif(F.regexp_extract("hit", shape, 2), F.lit("")).cast("int"), F.lit(1)), F.lit(1))
    start = F.regexp_extract("hit", shape, 1).cast("int")
    return hits.select(*keys, "pos", start.alias("start_line"), (start + count - 1).alias("end_line"))
