"""Patches as relations: line edits keyed by position, applied forward and backward to a table of texts.

A hunk's line has a place on both sides: what it keeps or removes a line of the old text, what
it keeps or adds one of the new text. Places of the new side are the old ones moved by the
lines that earlier hunks add and remove, a running sum. Applying a patch is a merge of a text's
lines with its edits in the order of places; reversing it exchanges the sides.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandwork.operators import diffs, locate, nesting
from strandwork.operators.settle import settled


def hunk_lines(patches: DataFrame, text: str = "patch", *keys: str) -> DataFrame:
    """(keys..., file_no, hunk_no, path, old_start, new_start, pos, kind, line) of unified diffs(keys..., patch).

    path is the new side's, or the old side's of a deleted file, without its prefix.
    """
    rows = diffs.segments(patches, text, *keys)
    side = F.when(F.col("line").startswith("+++ "), 1).otherwise(0)
    path = F.when(side == 1, diffs.paths.header_path(F.col("line"), "+++ ")).otherwise(diffs.paths.header_path(F.col("line"), "--- "))
    path = F.when(F.col("kind") == "header", F.nullif(path, F.lit("/dev/null")))
    file, hunk = Window.partitionBy(*keys, "file_no"), Window.partitionBy(*keys, "file_no", "hunk_no")
    # a patch lies in one task by now, so its files and hunks are told by windows that need no shuffle
    rows = rows.withColumn("path", path).withColumn("path", F.max_by("path", F.when(F.col("path").isNotNull(), side)).over(file))
    rows = rows.withColumn("__head", F.max(F.when(F.col("kind") == "hunk", F.col("line"))).over(hunk))
    start = lambda i: F.regexp_extract("__head", diffs.HUNK, i).cast("int")
    body = rows.where(reduce(and_, [F.col(k).isNotNull() for k in keys], F.col("kind").isin(" ", "-", "+") & F.col("path").isNotNull()))
    body = body.withColumn("path", F.regexp_replace("path", "^[ab]/", ""))
    return body.select(*keys, "file_no", "hunk_no", "path", start(1).alias("old_start"), start(3).alias("new_start"), F.col("line_no").alias("pos"), "kind", F.expr("substring(line, 2)").alias("line"))


def hunks(lines: DataFrame, *keys: str) -> DataFrame:
    """(id, keys..., file_no, hunk_no, path, old_start, lines): the old sides of hunk_lines, with an id over all of them."""
    old = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("pos", "kind", "line"))), lambda x: x["kind"] != "+"), lambda x: x["line"])
    own = [*keys, "file_no", "hunk_no"]
    return lines.groupBy(*own, "path", "old_start").agg(old.alias("lines")).select(F.to_json(F.struct(*own)).alias("id"), *own, "path", "old_start", "lines")


def edits(lines: DataFrame, places: DataFrame, *keys: str) -> DataFrame:
    """(keys..., path, hunk_no, pos, kind, line, old_no, new_no, id) of hunk_lines whose hunks have places(id, start, end, how).

    old_no and new_no are lines of the text before and after; of an added line old_no is the
    line it comes before, of a removed one new_no. A hunk whose old side is empty says the line
    before. Where blank lines were ignored, a hunk's own blank context goes, and an added line
    stays next to the line, other than blank, that it stood next to.
    """
    own = [*keys, "file_no", "hunk_no"]
    rows = lines.withColumn("id", F.to_json(F.struct(*own))).join(places, "id", "left")
    in_hunk = Window.partitionBy(*own).orderBy("pos")
    before, whole = in_hunk.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*own)
    is_old, blank = F.col("kind") != "+", locate.is_blank(F.col("line"))
    empty = F.sum(is_old.cast("int")).over(whole) == 0
    first = F.when(empty, F.col("old_start") + 1).otherwise(F.col("start"))
    nth = F.coalesce(F.sum(is_old.cast("int")).over(before), F.lit(0))
    solid = is_old & ~blank
    loose = (F.col("how") == "blank") & ~empty
    rows = rows.withColumns({"old_no": (first + nth).cast("long"), "__solid": F.when(loose & solid, F.sum(solid.cast("int")).over(in_hunk)), "__loose": F.coalesce(loose, F.lit(False)), "__beside": F.last(F.when(is_old, blank), ignorenulls=True).over(before)})
    return rows.withColumn("__blank", blank)


def _anchored(rows: DataFrame, texts: DataFrame, *keys: str) -> DataFrame:
    """Line numbers of hunks that were placed without their blank lines: its solid lines are those of the place, in order."""
    own = [*keys, "file_no", "hunk_no"]
    loose = rows.where("__loose")
    spans = loose.select("path", "start", "end", *own).distinct()
    there = F.slice(locate.text_lines("text"), F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int"))
    solid = F.filter(F.transform(there, lambda x, i: F.struct((F.col("start") + i).cast("long").alias("no"), locate.is_blank(x).alias("blank"))), lambda x: ~x["blank"])
    met = spans.join(texts.select("path", "text"), "path").select(*own, F.posexplode(solid).alias("k", "x"))
    met = met.select(*own, F.col("x.no").alias("no"), (F.col("k") + 1).cast("long").alias("__solid"))
    at = loose.drop("old_no").join(met, [*own, "__solid"], "left")
    order = Window.partitionBy(*own).orderBy("pos")
    last = F.last("no", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    nxt = F.first("no", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    added = F.when(F.coalesce(F.col("__beside"), F.lit(True)), F.coalesce(nxt, F.col("end") + 1)).otherwise(last + 1)
    at = at.withColumn("old_no", F.when(F.col("kind") == "+", added).otherwise(F.col("no"))).where("NOT (__blank AND kind = ' ')")
    return rows.where("NOT __loose").unionByName(at.select(*rows.columns))


def positioned(lines: DataFrame, texts: DataFrame, *keys: str) -> DataFrame:
    """edits of hunk_lines against texts(path, text), each hunk put where its old side stands; how tells for each.

    Several steps read the edits, so they are kept in the checkpoint folder.
    """
    lines = settled(lines)
    places = settled(locate.placed(settled(hunks(lines, *keys).where(F.size("lines") > 0)), texts))
    rows = _anchored(settled(edits(lines, places, *keys)), texts, *keys)
    empty = F.col("how").isNull()  # a hunk without an old side stands where it says
    rows = rows.withColumn("how", F.when(empty, "declared").otherwise(F.col("how")))
    step = F.when(F.col("kind") == "+", 1).when(F.col("kind") == "-", -1).otherwise(0)
    swept = nesting.running(rows.withColumns({"__step": step, "__side": F.when(F.col("kind") == "+", 0).otherwise(1)}), [*keys, "path"], "old_no", [F.col("__side"), F.col("hunk_no"), F.col("pos")], {"__moved": ("sum", "__step")})
    new = F.col("old_no") + F.col("__moved") - F.when(F.col("kind") == "+", 1).otherwise(0) + F.when(F.col("kind") == "-", 1).otherwise(0)
    return settled(swept.select(*keys, "path", "file_no", "hunk_no", "pos", "kind", "line", "old_no", new.alias("new_no"), "how"))


def reverse(found: DataFrame) -> DataFrame:
    """The edits that undo edits."""
    kind = F.translate("kind", "+-", "-+")
    return found.withColumns({"kind": kind, "old_no": F.col("new_no"), "new_no": F.col("old_no")})


def conflicts(found: DataFrame, texts: DataFrame, *keys: str, loose: bool = False) -> DataFrame:
    """(keys..., path, hunk_no, pos, what): edits that don't fit texts(path, text).

    what: unplaced (its hunk has no place), missing (no such text), differs (another line stands
    there) or overlaps (another edit of the patch keeps or removes the line too). loose: runs of
    blanks are as good as one and those at a line's end as good as none.
    """
    what = F.when(F.lit(loose), F.col("what_wide")).otherwise(F.col("what")).alias("what")
    return _judged(found, texts, *keys).where("wide" if loose else "strict").select(*keys, "path", "hunk_no", "pos", what)


def _judged(found: DataFrame, texts: DataFrame, *keys: str) -> DataFrame:
    """The rows of conflicts with strict and wide: whether an edit is one with regard to blanks and without, by one pass over the texts."""
    plain = lambda c: F.rtrim(F.regexp_replace(c, r"[ \t]+", " "))
    own, out = ["path", "old_no"], [*keys, "path", "hunk_no", "pos"]
    both = lambda what: [F.lit(what).alias("what"), F.lit(what).alias("what_wide"), F.lit(True).alias("strict"), F.lit(True).alias("wide")]
    unplaced = found.where("old_no IS NULL").select(*out, *both("unplaced"))
    old = found.where("old_no IS NOT NULL AND kind <> '+'")
    met = old.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys, *own)))
    asks = met.groupBy("path").agg(F.collect_list(F.struct(*[c for c in dict.fromkeys([*out, "old_no", "line", "__n"]) if c != "path"])).alias("__asks"))
    met = asks.join(texts.select("path", "text"), "path", "left").select("path", "__asks", locate.text_lines("text").alias("__lines"))
    line = lambda no: F.get("__lines", (no - 1).cast("int"))
    met = met.select("path", F.explode(F.transform("__asks", lambda x: F.struct(x.alias("x"), line(x["old_no"]).alias("found")))).alias("y")).select("path", "y.x.*", "y.found")
    met = met.withColumns({"__none": F.col("found").isNull(), "__differs": F.coalesce(F.col("found") != F.col("line"), F.lit(False)), "__twice": F.col("__n") > 1}).where("__none OR __differs OR __twice")
    met = met.withColumn("__wide", F.coalesce(plain("found") != plain("line"), F.lit(False)))
    what = F.when(F.col("__none") | F.col("__differs"), "differs").otherwise("overlaps")
    loose = F.when(F.col("__none") | F.col("__wide"), "differs").otherwise("overlaps")
    met = met.select(*out, what.alias("what"), loose.alias("what_wide"), F.lit(True).alias("strict"), (F.col("__none") | F.col("__wide") | F.col("__twice")).alias("wide"))
    gone = found.join(texts.select("path").distinct(), "path", "left_anti").where("old_no IS NOT NULL AND kind = '+'").select(*out, *both("missing"))
    return unplaced.unionByName(met).unionByName(gone)


def applied(found: DataFrame, texts: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """(path, text, changed): texts(path, text) after the edits of one patch; a path with a conflict of bad(path) stays as it is.

    A path's edits meet its text as one array in the order of places, and the text is cut at
    these where it lies: after an edit come the lines up to the next one. The result ends with a
    newline if the text did, or if it had no lines.
    """
    good = found if bad is None else found.join(bad.select("path").distinct(), "path", "left_anti")
    places = good.where("old_no IS NOT NULL")
    none = F.lit(None).cast("string")
    edit = lambda side, hunk, pos, line: F.struct("old_no", F.lit(side).alias("side"), hunk.cast("long").alias("hunk_no"), pos.cast("long").alias("pos"), line.alias("line"))
    added = F.collect_list(F.when(F.col("kind") == "+", edit(0, F.col("hunk_no"), F.col("pos"), F.col("line"))))
    removed = F.collect_set(F.when(F.col("kind") == "-", edit(1, F.lit(0), F.lit(0), none)))
    # without either, a path whose patch only keeps lines counts as changed
    merged = places.groupBy("path").agg(F.array_sort(F.concat(added, removed)).alias("__edits"))
    done = texts.select("path", "text").join(merged, "path", "left")
    done = done.select("path", "text", "__edits", F.when(F.col("__edits").isNotNull(), locate.text_lines("text")).alias("__lines"))
    lines = lambda start, stop: F.slice("__lines", F.greatest(start, F.lit(1)).cast("int"), F.greatest(stop - F.greatest(start, F.lit(1)), F.lit(0)).cast("int"))
    at = lambda i: F.get("__edits", i)
    beyond = F.size("__lines") + 1
    after = F.transform("__edits", lambda x, i: F.concat(
        F.when(x["side"] == 0, F.array(x["line"])).otherwise(F.array().cast("array<string>")),
        lines(x["old_no"] + x["side"], F.coalesce(at(i + 1)["old_no"], beyond)),
    ))
    body = F.concat(lines(F.lit(1), F.coalesce(at(F.lit(0))["old_no"], beyond)), F.flatten(after))
    ends = F.coalesce(F.col("text"), F.lit("")).isin("") | F.col("text").endswith("\n")
    text = F.when(F.size("__body") == 0, F.lit("")).otherwise(F.concat(F.array_join("__body", "\n"), F.when(ends, "\n").otherwise("")))
    done = done.select("path", "text", F.col("__edits").isNotNull().alias("changed"), F.when(F.col("__edits").isNotNull(), body).alias("__body"))
    return done.select("path", F.when(F.col("changed"), text).otherwise(F.col("text")).alias("text"), "changed")


def already_applied(found: DataFrame, texts: DataFrame, *keys: str) -> DataFrame:
    """(keys..., applied): whether the patch could be taken back from texts: exactly, blank, if only without regard to blanks, or null."""
    back = reverse(found)
    every = found.select(*keys).distinct()
    bad = _judged(back, texts, *keys).groupBy(*keys).agg(F.lit(True).alias("__strict"), F.max(F.when(F.col("wide"), True)).alias("__wide"))
    how = F.when(F.col("__strict").isNull(), "exactly").when(F.col("__wide").isNull(), "blank")
    return every.join(bad, list(keys), "left").select(*keys, how.alias("applied"))
