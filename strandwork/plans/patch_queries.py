"""Queries over patches as relations: hunks cut from documents, drifted, found again, applied and taken back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.operators import locate, patching
from strandwork.operators.settle import settled
from strandwork.plans.registry import query
from strandwork.sources.tables import table


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, text, l, form): documents as files; form: which drift the hunks cut from a file of twelve lines have."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    docs = docs.select("doc_id", F.col("doc_id").cast("string").alias("path"), "text", locate.text_lines("text").alias("l"))
    solid = lambda i: ~locate.is_blank(F.get("l", F.lit(i - 1)))
    form = F.when(F.col("doc_id") % 7 == 1, 1).when((F.col("doc_id") % 7 == 2) & solid(6) & solid(8) & solid(9), 2).when(F.col("doc_id") % 7 == 3, 3).otherwise(0)
    return docs.withColumn("form", F.when(F.size("l") >= 12, form))


def cut_patches(files: DataFrame) -> DataFrame:
    """(doc_id, patch): a unified diff of two hunks for each file of twelve lines.

    The first changes the sixth line and adds one before the ninth, and says a start that is up
    to two lines off; in form 1 a line of its context is wrong, in form 2 it has a blank line
    too many, in form 3 it has no context. The second removes the twelfth line.
    """
    line = lambda mark, i: F.concat(F.lit(mark), F.get("l", F.lit(i - 1)))
    changed, added = F.concat(F.lit("+changed "), "path"), F.lit("+added")
    thin = F.array(line("-", 6), changed)
    fourth = F.when(F.col("form") == 1, F.array(F.lit(" no such line"))).when(F.col("form") == 2, F.array(line(" ", 4), F.lit(" "))).otherwise(F.array(line(" ", 4)))
    whole = F.concat(F.array(line(" ", 3)), fourth, F.array(line(" ", 5), line("-", 6), changed, line(" ", 7), line(" ", 8), added, line(" ", 9)))
    body = F.when(F.col("form") == 3, thin).otherwise(whole)
    said = (F.when(F.col("form") == 3, 6).otherwise(3) + F.col("doc_id") % 3).cast("string")
    head = F.array(F.concat(F.lit("--- a/"), "path"), F.concat(F.lit("+++ b/"), "path"), F.concat(F.lit("@@ -"), said, F.lit(" +"), said, F.lit(" @@")))
    second = F.array(F.lit("@@ -11,2 +12,1 @@"), line(" ", 11), line("-", 12))
    return files.where("form IS NOT NULL").select("doc_id", F.array_join(F.concat(head, body, second), "\n").alias("patch"))


_PLACES = """files AS MATERIALIZED (
        SELECT doc_id, text, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END AS l FROM documents WHERE text IS NOT NULL),
    formed AS MATERIALIZED (
        SELECT *, CASE WHEN len(l) < 12 THEN NULL WHEN doc_id % 7 = 1 THEN 1 WHEN doc_id % 7 = 2 AND trim(l[6]) <> '' AND trim(l[8]) <> '' AND trim(l[9]) <> '' THEN 2 WHEN doc_id % 7 = 3 THEN 3 ELSE 0 END AS form FROM files),
    hunks AS (
        SELECT doc_id, l, 1 AS hunk_no, CASE form WHEN 3 THEN 6 ELSE 3 END + doc_id % 3 AS said,
            CASE form WHEN 3 THEN [l[6]] WHEN 1 THEN [l[3], 'no such line'] || l[5:9] WHEN 2 THEN l[3:4] || [''] || l[5:9] ELSE l[3:9] END AS old FROM formed WHERE form IS NOT NULL
        UNION ALL SELECT doc_id, l, 2, 11, l[11:12] FROM formed WHERE form IS NOT NULL),
    solid AS (
        SELECT *, list_filter(range(1, len(l) + 1), lambda i: trim(l[i]) <> '') AS nos, list_filter(old, lambda x: trim(x) <> '') AS bare FROM hunks),
    found AS (
        SELECT *, list_filter(range(1, len(l) - len(old) + 2), lambda i: l[i:i + len(old) - 1] = old) AS exact,
            CASE WHEN len(bare) = 0 THEN [] ELSE list_filter(range(1, len(nos) - len(bare) + 2), lambda i: list_transform(nos[i:i + len(bare) - 1], lambda k: l[k]) = bare) END AS loose FROM solid),
    places AS MATERIALIZED (
        SELECT doc_id, hunk_no, len(old) AS n, CASE WHEN list_contains(exact, said) THEN 'declared' WHEN len(exact) = 1 THEN 'exact' WHEN len(exact) > 1 THEN 'ambiguous'
                WHEN len(loose) = 1 THEN 'blank' WHEN len(loose) > 1 THEN 'ambiguous' ELSE 'missing' END AS how,
            CASE how WHEN 'declared' THEN said WHEN 'exact' THEN exact[1] WHEN 'blank' THEN nos[loose[1]] END AS start,
            CASE how WHEN 'declared' THEN said + n - 1 WHEN 'exact' THEN exact[1] + n - 1 WHEN 'blank' THEN nos[loose[1] + len(bare) - 1] END AS "end" FROM found)"""
_PATCHED = _PLACES + """,
    pair AS (
        SELECT doc_id, max(CASE WHEN hunk_no = 1 THEN start END) AS s, max(CASE WHEN hunk_no = 1 THEN how END) AS how, max(CASE WHEN hunk_no = 1 THEN "end" END) AS e, max(CASE WHEN hunk_no = 2 THEN start END) AS t FROM places GROUP BY doc_id),
    ready AS (SELECT *, form IS NOT NULL AND s IS NOT NULL AND t IS NOT NULL AND (e < t OR t + 1 < s) AS fits FROM formed LEFT JOIN pair USING (doc_id)),
    done AS (
        SELECT doc_id, fits, text, form,
            CASE WHEN form = 3 THEN l[:s - 1] || ['changed ' || doc_id] || l[s + 1:t] || l[t + 2:]
                WHEN form = 2 AND how = 'blank' THEN l[:5] || ['changed ' || doc_id] || l[7:8] || ['added'] || l[9:t] || l[t + 2:]
                ELSE l[:s + 2] || ['changed ' || doc_id] || l[s + 4:s + 5] || ['added'] || l[s + 6:t] || l[t + 2:] END AS after FROM ready),
    patched AS (
        SELECT doc_id, coalesce(fits, false) AS changed, CASE WHEN fits THEN array_to_string(after, chr(10)) || CASE WHEN ends_with(text, chr(10)) THEN chr(10) ELSE '' END ELSE text END AS text, form FROM done)"""


@query(f"""WITH {_PLACES} SELECT doc_id, hunk_no, start, "end", how FROM places""")
def q_hunk_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where drifted hunks stand in their files: as declared, in one other place, without regard to blank lines, or refused."""
    files = _files(spark, sf_dir)
    hunks = settled(patching.hunks(patching.hunk_lines(cut_patches(files), "patch", "doc_id"), "doc_id"))
    return locate.placed(hunks, files).join(hunks.select("id", "doc_id", "hunk_no"), "id").select("doc_id", "hunk_no", "start", "end", "how")


@query("""WITH l AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS no, unnest(l) AS line, len(l) AS n FROM (
        SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END AS l FROM documents WHERE text IS NOT NULL)),
    runs AS (SELECT doc_id, no, string_agg(line, chr(10)) OVER w AS run, count(*) OVER w AS k FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
    SELECT a.doc_id AS id, b.doc_id, b.no AS start, b.no + 2 AS "end" FROM runs a JOIN runs b ON a.run = b.run WHERE a.no = 2 AND a.k = 3 AND b.k = 3 AND a.doc_id % 5 = 0""")
def q_sequence_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I8: the second to fourth lines of every fifth file, found in any file by their rarest window."""
    files = _files(spark, sf_dir)
    needles = files.where((F.size("l") >= 4) & (F.col("doc_id") % 5 == 0)).select(F.col("doc_id").alias("id"), "path", F.slice("l", 2, 3).alias("lines"))
    return locate.occurrences(needles, files, anywhere=True).select("id", F.col("path").cast("long").alias("doc_id"), "start", "end")


def _patched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, edits of all patches, those that don't fit)."""
    files = _files(spark, sf_dir)
    found = patching.positioned(patching.hunk_lines(cut_patches(files), "patch", "doc_id"), files, "doc_id")
    return files, found, settled(patching.conflicts(found, files, "doc_id"))


@query(f"WITH {_PATCHED} SELECT doc_id, changed, sha256(text) AS hash FROM patched")
def q_patch_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files after their patches; one with a conflict stays as it is."""
    files, found, bad = _patched(spark, sf_dir)
    done = patching.applied(found, files.select("path", "text"), bad)
    return done.select(F.col("path").cast("long").alias("doc_id"), "changed", F.sha2("text", 256).alias("hash"))


@query(f"WITH {_PATCHED} SELECT doc_id, changed AS undone, sha256(d.text) AS hash FROM patched JOIN documents d USING (doc_id)")
def q_patch_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I16: patches applied, then taken back: every file has its text again."""
    files, found, bad = _patched(spark, sf_dir)
    after = patching.applied(found, files.select("path", "text"), bad)
    good = found.join(bad.select("path").distinct(), "path", "left_anti")
    back = patching.applied(patching.reverse(good), after.select("path", "text"))
    return back.select(F.col("path").cast("long").alias("doc_id"), F.col("changed").alias("undone"), F.sha2("text", 256).alias("hash"))


@query(f"""WITH {_PATCHED}
    SELECT doc_id, CASE WHEN NOT changed OR doc_id % 2 = 1 THEN NULL WHEN doc_id % 4 = 0 THEN 'blank' ELSE 'exactly' END AS applied FROM patched WHERE form IS NOT NULL""")
def q_patch_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I16: whether each patch could be taken back from its file: every other file has it, half of these with other blanks."""
    files, found, bad = _patched(spark, sf_dir)
    after = patching.applied(found, files.select("path", "text"), bad).select("path", F.col("text").alias("after"))
    n = F.col("path").cast("long")
    now = files.select("path", "text").join(after, "path").select("path", F.when(n % 2 == 1, F.col("text")).when(n % 4 == 0, F.replace("after", F.lit(" "), F.lit("  "))).otherwise(F.col("after")).alias("text"))
    return patching.already_applied(found, settled(now), "doc_id")
