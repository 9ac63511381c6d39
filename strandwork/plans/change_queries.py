"""Queries over diffs, verdicts, snapshots and retained state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.functions import paths
from strandwork.operators import diffs, verdict
from strandwork.plans.join_queries import PATH
from strandwork.plans.registry import query, spread_sql, values
from strandwork.sources.tables import document_path, spread, table

DIFFS = [
    (1, "--- a/x{n}.py\n+++ b/x{n}.py\n@@ -1,2 +1,3 @@\n one\n-two\n+2\n+3\n@@ -9 +10,1 @@ def f\n-old\n+new\n--- a/y.py\n+++ /dev/null\n@@ -1,1 +0,0 @@\n-gone\n"),
    (2, "--- a/q{n}.sql\n+++ b/q{n}.sql\n@@ -3,4 +3,9 @@\n keep\n--- looks like a header\n+++ so does this\n tail\n"),
    (3, "--- a/../evil\n+++ b/../evil\n@@ -1 +1 @@\n-a\n+b\n--- a/.git/config\n+++ b/.git/config\n@@ -1 +1 @@\n-a\n+b\n"),
    (4, "no diff at all\n"),
]
_ROWS = spread_sql(DIFFS, "id, body")
_SEGMENTS = f"""raw AS (SELECT id, unnest(string_split(rtrim(body, chr(10)), chr(10))) AS line, generate_subscripts(string_split(rtrim(body, chr(10)), chr(10)), 1) AS line_no FROM {_ROWS} t),
    o AS (SELECT *, starts_with(line, '--- ') AND coalesce(starts_with(lead(line, 1) OVER w, '+++ '), FALSE) AND coalesce(starts_with(lead(line, 2) OVER w, '@@ '), FALSE) AS opens FROM raw WINDOW w AS (PARTITION BY id ORDER BY line_no)),
    p AS (SELECT *, coalesce(lag(opens) OVER w, FALSE) AS plus, regexp_matches(line, '^@@ -[0-9]+(,[0-9]+)? \\+[0-9]+(,[0-9]+)? @@') AS is_hunk, sum(opens::INT) OVER (PARTITION BY id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS file_no FROM o WINDOW w AS (PARTITION BY id ORDER BY line_no)),
    q AS (SELECT *, sum(is_hunk::INT) OVER (PARTITION BY id, file_no ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS hunk_no FROM p),
    seg AS (SELECT id, line_no, line, file_no::BIGINT AS file_no, hunk_no::BIGINT AS hunk_no, CASE WHEN opens OR plus THEN 'header' WHEN is_hunk THEN 'hunk' WHEN hunk_no > 0 AND line = '' THEN ' '
        WHEN hunk_no > 0 AND left(line, 1) IN (' ', '-', '+', chr(92)) THEN left(line, 1) ELSE 'other' END AS kind FROM q)"""


def diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.segments(spread(spark, sf_dir, "id int, body string", DIFFS), "body", "id")


@query(f"WITH {_SEGMENTS} SELECT id, line_no, line, file_no, hunk_no, kind FROM seg")
def q_diff_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diff lines with their file, hunk and kind."""
    return diff_rows(spark, sf_dir).withColumn("line_no", F.col("line_no").cast("long"))


@query(f"""WITH {_SEGMENTS}, h AS (SELECT id, file_no, hunk_no, max(line) FILTER (kind = 'hunk') AS head, count(*) FILTER (kind IN (' ', '-')) AS old_actual, count(*) FILTER (kind IN (' ', '+')) AS new_actual,
        count(*) FILTER (kind = '+') AS additions, count(*) FILTER (kind = '-') AS deletions FROM seg WHERE hunk_no > 0 GROUP BY ALL),
    n AS (SELECT *, coalesce(try_cast(regexp_extract(head, '-[0-9]+,([0-9]+)', 1) AS INT), 1) AS old_declared, coalesce(try_cast(regexp_extract(head, '\\+[0-9]+,([0-9]+)', 1) AS INT), 1) AS new_declared FROM h)
    SELECT id, file_no, hunk_no, additions, deletions, old_actual, new_actual, old_declared = old_actual AND new_declared = new_actual AS matches FROM n""")
def q_add_del(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additions, deletions, and whether declared counts hold."""
    return diffs.hunk_counts(diff_rows(spark, sf_dir), "id").select("id", "file_no", "hunk_no", "additions", "deletions", "old_actual", "new_actual", "matches")


@query(f"""WITH {_SEGMENTS}, h AS (SELECT id, file_no, hunk_no, try_cast(regexp_extract(max(line) FILTER (kind = 'hunk'), '-([0-9]+)', 1) AS INT) AS old_start, count(*) FILTER (kind IN (' ', '-')) AS n FROM seg WHERE hunk_no > 0 GROUP BY ALL),
    l AS (SELECT *, coalesce(old_start >= lag(old_start + n) OVER (PARTITION BY id, file_no ORDER BY hunk_no), TRUE) AS ok FROM h) SELECT id, file_no, bool_and(ok) AS ordered FROM l GROUP BY ALL""")
def q_hunk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether the hunks of a file are in order and apart."""
    return diffs.ordered_hunks(diffs.hunk_counts(diff_rows(spark, sf_dir), "id"), "id")


@query(f"""WITH {_SEGMENTS}, named AS (SELECT DISTINCT id, regexp_replace(trim(string_split(substr(line, 5), chr(9))[1]), '^[ab]/', '') AS path FROM seg WHERE kind = 'header')
    SELECT id, path, starts_with(path, '/') OR list_contains(string_split(path, '/'), '..') OR list_contains(string_split(path, '/'), '.git') AS unsafe FROM named WHERE path <> '/dev/null'""")
def q_patch_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths a diff touches, and which are unsafe."""
    return diffs.patch_paths(diff_rows(spark, sf_dir), "id").withColumn("unsafe", paths.is_unsafe_patch_path(F.col("path")))


@query()
def q_diff_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict parse and canonical text, or the error and its line."""
    out = spread(spark, sf_dir, "id int, body string", DIFFS).select("id", diffs.parsed(F.col("body")).alias("p"))
    return out.select("id", "p.canonical", F.array_join("p.mismatches", ";").alias("mismatches"), "p.files", "p.hunks", "p.error", "p.error_line")


SEQUENCES = [(1, "a\nb{n}\nc\nd", "b{n}\nc"), (2, "a\nb\na\nb", "a\nb"), (3, "a\nb", "z"), (4, "a", "a\nb")]


@query(f"SELECT * FROM {spread_sql([(1, 1), (2, None), (3, None), (4, None)], "id, found_at")} t")
def q_unique_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I8: where a line sequence stands exactly once."""
    df = spread(spark, sf_dir, "id int, source string, needle string", SEQUENCES)
    return df.select("id", diffs.unique_start(F.split("source", "\n"), F.split("needle", "\n")).alias("found_at"))


_RUNS = """b AS (SELECT user_id, list_sort(list(DISTINCT event_type || ':' || floor(value / 10)::INT)) AS ids FROM events WHERE event_type IN ('error', 'click') AND ts < TIMESTAMP '2024-01-16' GROUP BY user_id),
    a AS (SELECT user_id, list_sort(list(DISTINCT event_type || ':' || floor(value / 10)::INT)) AS ids FROM events WHERE event_type IN ('error', 'click') AND ts >= TIMESTAMP '2024-01-16' GROUP BY user_id),
    t AS (SELECT user_id, list_sort(list(DISTINCT event_type || ':' || floor(value / 10)::INT)) AS ids FROM events WHERE event_type = 'error' GROUP BY user_id)"""


@query(f"""WITH {_RUNS}, u AS (SELECT DISTINCT user_id FROM events), j AS (SELECT u.user_id, b.ids AS b, a.ids AS a, coalesce(t.ids, []) AS t FROM u LEFT JOIN b USING (user_id) LEFT JOIN a USING (user_id) LEFT JOIN t USING (user_id))
    SELECT user_id, CASE WHEN a IS NULL THEN 'unavailable' WHEN b IS NULL THEN 'unclear' WHEN list_has_any(a, t) AND user_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'repair_failed'
            WHEN len(list_filter(a, lambda x: NOT list_contains(b, x))) > 0 THEN 'regressions' WHEN list_has_any(a, b) THEN 'existing' ELSE 'unclear' END AS status,
        len(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS new_failures, len(list_filter(coalesce(a, []), lambda x: list_contains(coalesce(b, []), x))) AS old_failures,
        len(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))) AS fixed FROM j""")
def q_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's failures before and after, and the verdict."""
    events = table(spark, sf_dir, "events")
    name = F.concat_ws(":", "event_type", F.floor(F.col("value") / 10).cast("int").cast("string"))
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    some = F.col("event_type").isin("error", "click")
    ids = lambda cond: F.array_sort(F.collect_set(F.when(cond, name)))
    by = events.groupBy("user_id").agg(ids(some & ~late).alias("b"), ids(some & late).alias("a"), ids(F.col("event_type") == "error").alias("t"))
    partial = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"), F.lit(True).alias("fixing")).distinct()
    by = by.join(partial, "user_id", "left")
    none = F.array().cast("array<string>")
    code = lambda x: F.when(F.size(x) > 0, F.lit(1))
    status = verdict.verdict(
        baseline_code=code("b"), baseline_ids=F.col("b"), targeted_code=F.lit(None).cast("int"), targeted_ids=none, full_code=code("a"), full_ids=F.col("a"),
        targets=F.when(F.col("fixing"), F.col("t")).otherwise(none), pending=F.lit(False), infrastructure=F.lit(False),
    )
    sets = verdict.failure_sets(F.col("b"), F.col("a"))
    return by.select("user_id", status.alias("status"), F.size(sets["new"]).cast("long").alias("new_failures"), F.size(sets["existing"]).cast("long").alias("old_failures"), F.size(sets["fixed"]).cast("long").alias("fixed"))


CASES = [
    # name, pending, infrastructure, baseline code and ids, targeted code and ids, full code and ids, targets, status
    ("waits", True, False, 0, "", None, "", None, "", "", "pending"), ("no machine", False, True, 0, "", 0, "", None, "", "", "infrastructure_error"),
    ("nothing ran", False, False, 0, "", None, "", None, "", "", "unavailable"), ("same again", False, False, 1, "a", 1, "a", None, "", "a", "repair_failed"),
    ("target broke", False, False, 0, "", 1, "b", 1, "b", "", "targeted_failed"), ("mended", False, False, 1, "a", 0, "", 0, "", "a", "repair_passed"),
    ("green", False, False, 0, "", None, "", 0, "", "", "passed"), ("no baseline", False, False, None, "", 0, "", 1, "x", "", "unclear"),
    ("nameless baseline", False, False, 1, "", 0, "", 1, "x", "", "unclear"), ("worse", False, False, 0, "", 0, "", 1, "x", "", "regressions"),
    ("as before", False, False, 1, "x,y", 0, "", 1, "x", "", "existing"), ("full names target", False, False, 1, "x", 0, "", 1, "x", "x", "repair_failed"),
]


@query(f"SELECT name, status FROM {spread_sql([(c[0], c[-1]) for c in CASES], "name, status")} t")
def q_verdict_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for every rule of the decision table."""
    df = spread(spark, sf_dir, "name string, pending boolean, infra boolean, bc int, b string, tc int, t string, fc int, f string, targets string", [c[:-1] for c in CASES])
    ids = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    status = verdict.verdict(
        baseline_code=F.col("bc"), baseline_ids=ids("b"), targeted_code=F.col("tc"), targeted_ids=ids("t"), full_code=F.col("fc"), full_ids=ids("f"), targets=ids("targets"), pending=F.col("pending"), infrastructure=F.col("infra")
    )
    return df.select("name", status.alias("status"))


@query(f"""WITH rows AS (SELECT lang, sha256({PATH} || chr(9) || sha256(text)) AS row FROM documents), b AS (SELECT lang, left(row, 3) AS bucket, count(*) AS n, sha256(string_agg(row, ',' ORDER BY row)) AS h FROM rows GROUP BY ALL)
    SELECT lang, sum(n)::BIGINT AS n, sha256(string_agg(h, ',' ORDER BY bucket)) AS digest FROM b GROUP BY lang""")
def q_snapshot_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of the files of each language."""
    files = table(spark, sf_dir, "documents").select("lang", document_path().alias("path"), F.sha2("text", 256).alias("hash"))
    return verdict.digest(files, "lang")


@query("""WITH newest AS (SELECT o_custkey, max(o_orderdate) AS saved_at FROM orders GROUP BY o_custkey)
    SELECT c_custkey AS o_custkey, coalesce(TIMESTAMP '1995-06-15' - saved_at BETWEEN INTERVAL 0 SECOND AND INTERVAL 15552000 SECOND, FALSE) AS usable FROM customer LEFT JOIN newest ON c_custkey = o_custkey""")
def q_baseline_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a customer's newest entry is young enough at a fixed time."""
    cache = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").alias("saved_at"))
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return verdict.usable_baseline(wanted, cache, F.lit("1995-06-15").cast("timestamp"), ["o_custkey"], 180 * 86_400)


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '%LOW' AND TIMESTAMP '1997-01-01' - o_orderdate > INTERVAL 86400 SECOND AND o_orderstatus <> 'O'""")
def q_stale_temporaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by name pattern and age that aren't active."""
    entries = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("modified"), (F.col("o_orderstatus") == "O").alias("active"))
    return verdict.stale_temporaries(entries, F.lit("1997-01-01").cast("timestamp"), "LOW$").select("o_orderkey")


@query("""WITH p AS (SELECT o_custkey, max(o_orderkey) AS run_id FROM orders GROUP BY o_custkey), own AS (SELECT o_custkey, o_orderkey AS run_id, o_orderstatus AS state FROM orders WHERE o_totalprice > 100000)
    SELECT p.o_custkey, p.run_id, coalesce(own.state, 'running') AS state FROM p LEFT JOIN own USING (o_custkey, run_id)""")
def q_latest_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest run of each customer, its own state where it has one."""
    orders = table(spark, sf_dir, "orders")
    pointers = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("run_id")).withColumn("state", F.lit("running"))
    runs = orders.where("o_totalprice > 100000").select("o_custkey", F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("state"))
    return verdict.latest_pointer(pointers, runs, "o_custkey")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'new_file' WHEN d.lang <> 'en' THEN 'source_changed' WHEN l.toxic = 1 THEN 'model_changed' WHEN d.source = 'src3' THEN 'analyzer_version_changed'
    WHEN l.quality = 1 THEN 'current' ELSE 'pending' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q_semantic_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows are current and why the others wait."""
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    state = verdict.semantic_state(F.when(F.col("quality") == 1, "complete").otherwise("pending"), F.col("lang") == "en", F.col("toxic") != 1, F.col("source") != "src3", F.col("quality").isNotNull())
    return df.select("doc_id", state.alias("state"))


@query("""SELECT doc_id FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars <= 5000)""")
def q_publish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required rows that are not rendered."""
    rendered = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") <= 5000, "exact").otherwise("cut").alias("state"))
    return verdict.missing_required(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), rendered, ["doc_id"])


@query("""WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS rounds FROM r WHERE n <= 5 GROUP BY conv_id""")
def q_last_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five rounds of each conversation."""
    by = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return by.select("conv_id", F.array_join(F.transform(verdict.last_rounds(F.col("turns")), lambda x: x.cast("string")), ",").alias("rounds"))
