"""Where line sequences stand in a table of texts: in the text of their path, or anywhere by an index of hashed line windows, joined by each sequence's rarest window.

Sequences are hunks' old sides, or any lists of lines. A window is one, two or four lines; a
sequence asks for the windows of the largest size that fits it. The rarest of them gives its
candidates, and a candidate is an occurrence if its run of positions has every line of the
sequence. Blank lines are ignored through a second numbering, which counts other lines only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.operators.settle import settled

SIZES = (1, 2, 4)


def text_lines(text: str | Column) -> Column:
    """Lines of a text; one newline at its end ends the last line. Null and empty texts have none."""
    text = F.col(text) if isinstance(text, str) else text
    body = F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def is_blank(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\u000b\u000c", "    ")) == ""


def _numbered(found: Column, ignore_blank: bool) -> Column:
    """array<struct<no, line>> of an array of lines, numbered from 1 in all of them."""
    rows = F.transform(found, lambda x, i: F.struct((i + 1).alias("no"), x.alias("line")))
    return F.filter(rows, lambda x: ~is_blank(x["line"])) if ignore_blank else rows


def _windows(rows: Column, size: Column | int) -> Column:
    """array<struct<at, size, hash>>: hashed windows of an array of numbered lines, by their place from 0."""
    size = F.lit(size) if isinstance(size, int) else size
    places = F.when(F.size(rows) >= size, F.sequence(F.lit(0), F.size(rows) - size)).otherwise(F.array().cast("array<int>"))
    line = lambda at: F.transform(F.slice(rows, at + 1, size), lambda x: x["line"])
    return F.transform(places, lambda at: F.struct(at.alias("at"), size.alias("size"), F.xxhash64(size, line(at)).alias("hash")))


def occurrences(needles: DataFrame, texts: DataFrame, *, anywhere: bool = False, ignore_blank: bool = False) -> DataFrame:
    """(id, path, start, end): every place where the lines of needles(id, path, lines) stand in texts(path, text), from 1.

    Looked for in the text of the same path, or anywhere. Places may overlap. With ignore_blank
    blank lines count on neither side and start and end are lines of the whole text. Sequences
    without lines, null texts and null paths have no place; a repeated path is one text more.
    """
    texts = texts.where(F.col("path").isNotNull())
    own = needles.select("id", F.col("path").alias("of"), _numbered(F.col("lines"), ignore_blank).alias("rows")).where(F.size("rows") > 0)
    if not anywhere:  # a text meets its own sequences only, as one array, and is cut and looked through where it lies
        line = lambda c: F.transform(c, lambda x: x["line"])
        asked = own.groupBy(F.col("of").alias("path")).agg(F.collect_list(F.struct("id", line(F.col("rows")).alias("want"))).alias("asks"))
        met = texts.select("path", "text").join(asked, "path").select("path", "asks", _numbered(text_lines("text"), ignore_blank).alias("rows"))
        met = met.select("path", "rows", line(F.col("rows")).alias("found"), "asks")

        def runs(ask: Column) -> Column:
            n = F.size(ask["want"])
            places = F.when(F.size("found") >= n, F.sequence(F.lit(0), F.size("found") - n)).otherwise(F.array().cast("array<int>"))
            here = F.filter(places, lambda i: (F.get("found", i) == F.get(ask["want"], F.lit(0))) & (F.slice("found", i + 1, n) == ask["want"]))
            no = lambda at: F.get("rows", at)["no"]
            return F.transform(here, lambda i: F.struct(ask["id"].alias("id"), no(i).alias("start"), no(i + n - 1).alias("end")))

        return met.select("path", F.explode(F.flatten(F.transform("asks", runs))).alias("x")).select("x.id", "path", "x.start", "x.end").distinct()
    texts = texts.select("path", _numbered(text_lines("text"), ignore_blank).alias("rows"))
    n = F.size("rows")
    size = F.when(n >= SIZES[2], SIZES[2]).when(n >= SIZES[1], SIZES[1]).otherwise(SIZES[0])
    asked = own.select("id", "of", F.explode(_windows(F.col("rows"), size)).alias("w")).select("id", "of", "w.*")
    every = texts.select("path", F.explode(F.concat(*[_windows(F.col("rows"), s) for s in SIZES])).alias("w")).select("path", "w.at", "w.hash")
    counts = every.join(asked.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    rare = asked.join(counts, "hash", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rare = rare.groupBy("id", "of").agg(F.min(F.struct("n", "at", "hash")).alias("r")).where("r.n > 0").select("id", F.col("r.at").alias("skip"), "r.hash")
    met = rare.join(every, "hash").select("id", "path", (F.col("at") - F.col("skip")).alias("first")).where("first >= 0")
    lines = own.select("id", F.size("rows").alias("want"), F.posexplode("rows").alias("k", "row")).select("id", "want", "k", F.col("row.line").alias("line"))
    there = texts.select("path", F.posexplode("rows").alias("place", "row")).select("path", "place", "row.no", F.col("row.line").alias("found"))
    runs = met.distinct().join(lines, "id").withColumn("place", F.col("first") + F.col("k")).join(there, ["path", "place"]).where("line = found")
    runs = runs.groupBy("id", "path", "first", "want").agg(F.count_distinct("k").alias("n"), F.min("no").alias("start"), F.max("no").alias("end"))
    return runs.where("n = want").select("id", "path", "start", "end")


def placed(hunks: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, start, end, how) of hunks(id, path, old_start, lines): where each hunk's old side stands in its text.

    how: declared, if it stands where it says; exact, if it stands in one other place; blank, if
    it does when blank lines are ignored; else ambiguous or missing, without a place.
    """
    exact = occurrences(hunks, texts).join(hunks.select("id", F.col("old_start").alias("said")), "id")
    exact = exact.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.min("end").alias("end"), F.max(F.when(F.col("start") == F.col("said"), F.struct("start", "end"))).alias("own"))
    exact = settled(exact)
    left = hunks.join(exact.select("id"), "id", "left_anti")
    loose = occurrences(left, texts, ignore_blank=True).groupBy("id").agg(F.count(F.lit(1)).alias("m"), F.min("start").alias("b_start"), F.min("end").alias("b_end"))
    both = hunks.select("id").join(exact, "id", "left").join(loose, "id", "left")
    how = F.when(F.col("own").isNotNull(), "declared").when(F.col("n") == 1, "exact").when(F.col("n") > 1, "ambiguous").when(F.col("m") == 1, "blank").when(F.col("m") > 1, "ambiguous").otherwise("missing")
    both = both.withColumn("how", how)
    pick = lambda c: F.when(F.col("how") == "declared", F.col(f"own.{c}")).when(F.col("how") == "exact", F.col(c)).when(F.col("how") == "blank", F.col(f"b_{c}"))
    return both.select("id", pick("start").alias("start"), pick("end").alias("end"), "how")
