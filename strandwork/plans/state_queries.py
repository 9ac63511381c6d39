"""Queries over stored maps, history, repair documents and the remaining scalar forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork import config
from strandwork.functions import paths, text, times
from strandwork.operators import diffs, evidence, extract, history, lifecycle
from strandwork.plans import repair
from strandwork.plans.change_queries import diff_rows
from strandwork.plans.registry import query, spread_sql, values
from strandwork.plans.source_queries import SOURCES, indexed, sources
from strandwork.plans.text_queries import REPORTS, _WORDS
from strandwork.sources import repository
from strandwork.sources.tables import spread, table

MAPS = [
    (1, '{"version":3,"files":{"a{n}.py":{"hash":"1","tags":["x"]},"b{n}.py":{"hash":"2"}}}'), (2, "not json"), (3, '{"version":2,"files":{"c":{"hash":"3"}}}'), (4, '{"files":[]}'), (5, ""),
]


@query(f"SELECT * FROM {spread_sql([(1, 'a{n}.py', '1', 1), (1, 'b{n}.py', '2', 0)], 'map_id, path, hash, tags')} t")
def q_load_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored maps as rows; bad text, another version and another shape give none."""
    rows = repository.maps(spread(spark, sf_dir, "map_id int, body string", MAPS), "body", "map_id")
    return rows.select("map_id", "path", "entry.hash", F.greatest(F.coalesce(F.size("entry.tags"), F.lit(0)), F.lit(0)).alias("tags"))


CHANGES = [(1, "src/a{n}.py\x00keys/k.pem\x00"), (1, "src/b.ts\x00"), (1, "new{n}.py\x00.env\x00"), (2, ""), (3, "only/x{n}.js\x00")]
SCANNED = [(1, "src/a{n}.py"), (1, ".workspace/x.py"), (1, "readme.md"), (2, "z.py")]


@query(f"SELECT * FROM {spread_sql([(1, 'src/a{n}.py'), (1, 'src/b.ts'), (1, 'new{n}.py'), (2, 'z.py'), (3, 'only/x{n}.js')], 'repo_id, path')} t")
def q_index_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned and changed paths of repositories, indexable ones, from NUL-separated output."""
    changed = repository.nul_rows(spread(spark, sf_dir, "repo_id int, out string", CHANGES), "out", "repo_id").where(~paths.is_ignored(F.col("path")))
    scanned = repository.without_workspace(spread(spark, sf_dir, "repo_id int, path string", SCANNED), ".workspace")
    return repository.index_scope(scanned, changed, "repo_id")


TOPS = [(1, "pyproject.toml"), (1, "package.json"), (1, "src/x.py"), (2, "setup.py"), (2, "composer.json"), (3, "readme.md"), (4, "build.gradle.kts"), (4, "pom.xml"), (5, "sub/pom.xml"), (5, "composer.json")]


@query(f"SELECT * FROM {spread_sql([(1, 'npm test'), (2, 'pytest'), (4, 'mvn test'), (5, 'composer test')], 'repo_id, command')} t")
def q_test_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test command that the files of each repository suggest, the first detector that fits."""
    return repository.test_command(spread(spark, sf_dir, "repo_id int, path string", TOPS), "repo_id")


WORK_ITEMS = [
    (1, "Store the invoice ledger; open `src/app/main.py`, lib\\util.ts and the page"), (2, "fix it"), (3, "Render widgets for customers"),
]


@query(f"""SELECT * FROM {spread_sql([(1, 'src/app/main.py,lib/util.ts', 'invoice,ledger,main,open,util', 'persistence,domain,ui'), (2, '', '', 'domain'), (3, '', 'customers,widgets', 'ui')], "id, files, terms, roles")} t""".replace("'persistence,domain,ui'", "'domain,persistence,ui'"))
def q_requirement_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, domain terms and roles of requirements."""
    t = F.col("task")
    return spread(spark, sf_dir, "id int, task string", WORK_ITEMS).select("id", F.array_join(paths.file_tokens(t), ",").alias("files"), F.array_join(F.array_sort(text.domain_terms(t)), ",").alias("terms"), F.array_join(text.requirement_roles(text.tokens(t)), ",").alias("roles"))


ROLE_PATHS = [("src{n}/api/routes.py",), ("web{n}/Button.tsx",), ("tests/test_store{n}.py",), ("lib{n}/plain.py",)]


@query(f"SELECT * FROM {spread_sql([('src{n}/api/routes.py', 'transport', 'transport'), ('web{n}/Button.tsx', 'ui', 'ui'), ('tests/test_store{n}.py', 'persistence,tests', 'schema,persistence_crud,tests'), ('lib{n}/plain.py', '', '')], "path, roles, kinds")} t")
def q_path_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of paths and the evidence kinds they ask for."""
    roles = evidence.path_roles(F.col("path"))
    kinds = F.array_join(F.transform(evidence.kinds_of(F.col("r")), lambda k: k["kind"]), ",")
    found = spread(spark, sf_dir, "path string", ROLE_PATHS).select("path", F.explode_outer(F.array(roles)).alias("r"))  # so that roles are made once
    return found.select("path", F.array_join("r", ",").alias("roles"), kinds.alias("kinds"))


@query(f"""WITH t AS (SELECT DISTINCT unnest(list_filter({_WORDS}, lambda w: length(w) >= 8)) AS term FROM benchmark), l AS (SELECT list(term) AS terms FROM t)
    SELECT doc_id, len(list_filter(terms, lambda x: contains(lower(text), x))) AS terms FROM documents, l""")
def q_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the tasks' longer words a text holds."""
    words = F.filter(text.task_words(F.col("text"), synonyms={}), lambda w: F.length(w) >= 8)
    from strandwork.operators import ranking

    terms = table(spark, sf_dir, "benchmark").select(F.explode(words).alias("word")).distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(text.WORD), F.lit(0)))).alias("s"))
    met = ranking.containing(docs, terms).join(docs, "s").groupBy("doc_id").agg(F.count_distinct("word").alias("terms"))
    return table(spark, sf_dir, "documents").select("doc_id").join(met, "doc_id", "left").select("doc_id", F.coalesce("terms", F.lit(0)).cast("long").alias("terms"))


NAMES = [("20240102-030405.diff",), ("plain{n}",), ("20240102-030405-000123",)]


@query(f"SELECT * FROM {spread_sql([('20240102-030405.diff', '2024-01-02 03:04:05'), ('plain{n}', 'plain{n}'), ('20240102-030405-000123', '2024-01-02 03:04:05')], "name, shown")} t")
def q_shown_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as display times."""
    return spread(spark, sf_dir, "name string", NAMES).select("name", times.shown_time(F.col("name")).alias("shown"))


@query("SELECT doc_id, strlen(text) BETWEEN 1 AND 60000 AND regexp_matches(text, '[A-Z][a-z]+') AS eligible FROM documents")
def q_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a symbol and of a size that may be analysed."""
    from strandwork.operators.semantic import is_eligible
    from strandwork.sources.tables import capitalised

    return table(spark, sf_dir, "documents").select("doc_id", is_eligible(F.octet_length("text"), capitalised(F.col("text"))).alias("eligible"))


_ACTIONS = {"view": "begin", "click": "finalize", "purchase": "pass", "error": "fail", "signup": "undo"}
_ACTION_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ACTIONS.items()) + " END"


@query(f"""WITH RECURSIVE ev AS (
        SELECT user_id * 8 + event_id % 8 AS entry, epoch_us(ts) // 1000 AS at_ms, {_ACTION_SQL} AS action,
            row_number() OVER (PARTITION BY user_id * 8 + event_id % 8 ORDER BY epoch_us(ts) // 1000, event_id) AS r FROM events),
    w AS (
        SELECT DISTINCT entry, 0::BIGINT AS r, 'NONE' AS status, 'NOT_RUN' AS tests, NULL::BIGINT AS since, 0 AS refused FROM ev
        UNION ALL
        SELECT entry, nr, CASE WHEN NOT fits OR action IN ('pass', 'fail') THEN s0 WHEN action = 'begin' THEN 'PENDING' WHEN action = 'finalize' THEN 'APPLIED' ELSE 'UNDONE' END,
            CASE WHEN NOT fits THEN tests WHEN action = 'begin' THEN 'NOT_RUN' WHEN action = 'pass' THEN 'PASSED' WHEN action = 'fail' THEN 'FAILED' ELSE tests END,
            CASE WHEN NOT fits OR action IN ('pass', 'fail') THEN since ELSE at_ms END, refused + CASE WHEN fits THEN 0 ELSE 1 END
        FROM (
            SELECT *, coalesce(action = 'begin' AND s0 IN ('NONE', 'UNDONE', 'EXPIRED') OR action = 'finalize' AND s0 = 'PENDING' OR action IN ('pass', 'fail', 'undo') AND s0 = 'APPLIED', false) AS fits
            FROM (SELECT w.*, e.r AS nr, e.at_ms, e.action, CASE WHEN w.status = 'PENDING' AND e.at_ms - w.since > 86400000 THEN 'EXPIRED' ELSE w.status END AS s0 FROM w JOIN ev e ON e.entry = w.entry AND e.r = w.r + 1))),
    last AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY entry ORDER BY r DESC) = 1)
    SELECT entry, CASE WHEN status = 'PENDING' AND (SELECT max(at_ms) FROM ev) - since > 86400000 THEN 'EXPIRED' ELSE status END AS status, tests AS test_status, since, refused FROM last""")
def q_history_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries begun, applied, tested and undone by events; what is out of order is refused, what waits a day expires."""
    found = table(spark, sf_dir, "events")
    action = F.create_map(*[F.lit(x) for pair in _ACTIONS.items() for x in pair])[F.col("event_type")]
    rows = found.select((F.col("user_id") * 8 + F.col("event_id") % 8).alias("entry"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "event_id", action.alias("action"))
    now = F.lit(rows.agg(F.max("at")).first()[0])
    return lifecycle.replayed(rows, "entry", now=now)


@query(f"SELECT * FROM {spread_sql([('r1-{n}', False), ('r2-{n}', True), ('r3-{n}', False)], "run_id, current")} t")
def q_completed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run is current only if it is the newest and its snapshot still stands."""
    runs = spread(spark, sf_dir, "run_id string, snapshot string", [("r1-{n}", "s1-{n}"), ("r2-{n}", "s2-{n}"), ("r3-{n}", "s3-{n}")])
    return history.completed_run(spread(spark, sf_dir, "run_id string", [("r2-{n}",), ("r3-{n}",)]), runs, spread(spark, sf_dir, "snapshot string", [("s1-{n}",), ("s2-{n}",)])).select("run_id", "current")


@query(f"SELECT * FROM {spread_sql([('r1-{n}', 1, 'pkg.tests.A{n}.test_a,pkg.tests.B.test_b'), ('r2-{n}', 0, ''), ('r3-{n}', None, 'tests/test_x{n}.py::test_one,tests/test_y.py::T::test_two'), ('r4-{n}', None, '')], "run_id, exit_code, failures")} t")
def q_reclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes and failures read back from saved reports."""
    out = repair.reclassified(spread(spark, sf_dir, "run_id string, body string", REPORTS), "run_id")
    return out.withColumn("failures", F.array_join("failures", ","))


TRACES = [("r{n}", 'FAIL: x (t.T.x)\n  File "t{n}/shop/store.py", line 6, in save_invoice\ntoken = "0123456789abcdef"\n')]


@query(f"""SELECT * FROM {spread_sql([('r{n}', 't{n}/shop/store.py', 'traceback', 1), ('r{n}', 't{n}/tests/test_store.py', 'test', 2), ('r{n}', 't{n}/shop/models.py', 'dependency', 3), ('r{n}', 't{n}/shop/api.py', 'patch', 4)], "run_id, path, source, rank")} t""")
def q_relevant_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a repair: traceback, tests, what they depend on, the patch."""
    one = lambda p: spread(spark, sf_dir, "run_id string, path string", [("r{n}", p)])
    return repair.relevant_paths(spread(spark, sf_dir, "run_id string, body string", TRACES), indexed(spark, sf_dir).deps.select("src", "dst"), one("t{n}/shop/api.py"), one("t{n}/tests/test_store.py"), "run_id")


@query("SELECT 'r' || s_suppkey AS run_id, 5::BIGINT AS taken, 0::BIGINT AS skipped, TRUE AS redacted, TRUE AS whole FROM supplier")
def q_failure_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of failing output and current source, redacted, in its budget."""
    reports = spread(spark, sf_dir, "run_id string, body string", TRACES)
    doc = repair.failure_document(reports, sources(spark, sf_dir), q_relevant_paths(spark, sf_dir), "run_id")
    return doc.select("run_id", "taken", "skipped", (~F.contains("document", F.lit("0123456789abcdef"))).alias("redacted"), F.contains("document", F.lit(SOURCES[2][1].strip())).alias("whole"))


@query("SELECT (s_suppkey * 100 + 1)::INT AS id, 3::BIGINT AS lines FROM supplier")
def q_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a diff from an error on up to the next section."""
    near = repair.nearby(diff_rows(spark, sf_dir), spread(spark, sf_dir, "id int, error_line int", [(1, 8)]), "id")
    return near.groupBy("id").agg(F.count(F.lit(1)).alias("lines"))


GIT_LINES = [
    (1, "diff --git a/x{n}.py b/x{n}.py"), (2, 'diff --git "a/with space" "b/with space"'), (3, "diff --git a/only"), (4, "diff --git 'a/it{n}' b/\"q\\\"d\".c"), (5, 'diff --git "a/open b/c'), (6, "diff --git a b c"), (7, "index 1..2"),
]
GIT_PATHS = [(1, "a/x{n}.py|b/x{n}.py"), (2, "a/with space|b/with space"), (3, None), (4, 'a/it{n}|b/q"d.c'), (5, None), (6, None), (7, None)]


@query(f"SELECT * FROM {spread_sql(GIT_PATHS, 'id, paths')} t")
def q_git_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20: the two paths of shell-quoted headers."""
    rows = spread(spark, sf_dir, "id int, line string", GIT_LINES)
    pair = diffs.git_path_pair(F.col("line"))
    return rows.select("id", F.when(pair.isNotNull(), F.array_join(pair, "|")).alias("paths"))


@query("""WITH RECURSIVE d AS (SELECT conv_id, turn, 1600 + 2800 * (length(coalesce(text, '')) % 5) AS need, length(coalesce(text, '')) * 40 AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
    t AS (SELECT *, sum(need) OVER (PARTITION BY conv_id ORDER BY r DESC) AS remaining FROM d),
    s AS (SELECT DISTINCT conv_id, 0::BIGINT AS turn, 0::BIGINT AS r, 90000::BIGINT AS budget, 0::BIGINT AS allowance FROM d
        UNION ALL SELECT conv_id, turn, r, budget - least(size, share), share
        FROM (SELECT t.conv_id, t.turn, t.r, s.budget, t.size, greatest(1, greatest(0, s.budget) * t.need // t.remaining)::BIGINT AS share FROM s JOIN t ON t.conv_id = s.conv_id AND t.r = s.r + 1))
    SELECT conv_id, turn, allowance FROM s WHERE r > 0""")
def q_allowances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a budget shared by demand, what one doesn't use handed on."""
    length = F.length(F.coalesce("text", F.lit("")))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("order_no"), (length % 5).alias("n"), (length * 40).alias("size"))
    return repair.allowances(turns, config.SOFT_BUDGET, "conv_id").withColumnRenamed("order_no", "turn")


_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"


@query(f"""WITH {_LINES}, hit AS (SELECT doc_id, line_no, unnest(regexp_extract_all(lower(line), '[a-z0-9_]+')) AS word FROM lines), w AS (SELECT * FROM hit WHERE word IN ('token', 'license', 'licensed', 'thorea')),
    n AS (SELECT doc_id, line_no, word, count(*) AS n FROM w GROUP BY ALL), d AS (SELECT *, count(*) OVER (PARTITION BY doc_id, word) AS df FROM n),
    s AS (SELECT doc_id, line_no, sum(least(5000, greatest(1, power(length(word), 3)::BIGINT * 100 // greatest(1, floor(sqrt(df))::BIGINT))) * n) AS weight FROM d GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, line_no) AS r FROM s), r AS (SELECT doc_id, greatest(line_no - 32, 1) AS start_line, line_no + 32 AS end_line FROM b WHERE r <= 64),
    f AS (SELECT *, CASE WHEN start_line > max(end_line) OVER (PARTITION BY doc_id ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS fresh FROM r),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM f)
    SELECT doc_id, min(start_line) AS start_line, max(end_line) AS end_line FROM g GROUP BY doc_id, island""")
def q_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line ranges of an excerpt: heaviest lines for some words, surroundings, merged."""
    numbered = extract.lines(table(spark, sf_dir, "documents"), "text", "doc_id")
    out = repair.plan_excerpt(numbered, text.array_of(["token", "license", "licensed", "thorea"]), "doc_id")
    return out.select("doc_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


REQUESTS = [(1, "symbol", "save_invoice"), (1, "concept", "open invoice table"), (1, "symbol", "missing"), (2, "symbol", "API")]


@query("""WITH hit AS (
        SELECT t.s_suppkey * 100 + 1 AS task_id, 't' || f.s_suppkey || '/shop/store.py' AS path, 136 AS score FROM supplier t, supplier f
        UNION ALL SELECT t.s_suppkey * 100 + 2, 't' || f.s_suppkey || '/web/api.ts', 100 FROM supplier t, supplier f)
    SELECT task_id::INT AS task_id, path, score, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, path) AS rank FROM hit QUALIFY rank <= 6""")
def q_missing_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested symbols and concepts to files not selected yet."""
    selected = spread(spark, sf_dir, "task_id int, path string", [(1, "t{n}/shop/api.py")])
    return repair.missing_requests(spread(spark, sf_dir, "task_id int, kind string, value string", REQUESTS), indexed(spark, sf_dir).definitions, selected)


TESTS = [(1, "A", "t1", 1, 2), (1, "A", "t2", 0, 1), (1, "B", "t3", 1, 9), (1, "C", "t4", 0, 0), (1, "D", "t5", 2, 0)]


@query(f"SELECT * FROM {spread_sql([(1, 'D', 1, 1), (1, 'A', 2, 2), (1, 'B', 1, 3)], "task_id, owner, tests, rank")} t")
def q_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test suites by path overlap, size, terms and name, the best three."""
    return repair.suites(spread(spark, sf_dir, "task_id int, owner string, name string, path_hits int, term_hits int", TESTS))


@query(f"SELECT * FROM {spread_sql([(1, 'domain,transport,ui'), (2, 'tests')], "task_id, roles")} t")
def q_effective_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9: roles widened by what anchored files show."""
    wanted = spread(spark, sf_dir, "task_id int, roles array<string>", [(1, ["domain"]), (2, ["tests"])])
    return repair.effective_roles(wanted, spread(spark, sf_dir, "task_id int, file_roles array<string>", [(1, ["ui"]), (1, ["transport", "ui"])])).select("task_id", F.array_join("roles", ",").alias("roles"))


OWNERS = [("transport", "handle_save{n}", "reads the request", "transport", 1, 2), ("transport", "plain{n}", "nothing", "domain", 1, 2), ("ui", "Card{n}", "<div>", "domain", 0, 1), ("tests", "test_a{n}", "x", "tests", 0, 0)]


@query(f"SELECT * FROM {spread_sql([('handle_save{n}', 310), ('plain{n}', -1000), ('Card{n}', 180), ('test_a{n}', 160)], "name, score")} t")
def q_owner_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well definitions own a role."""
    df = spread(spark, sf_dir, "role string, name string, body string, roles string, path_hits int, term_hits int", OWNERS)
    return df.select("name", evidence.owner_score(F.col("role"), name=F.col("name"), body=F.col("body"), roles=F.split("roles", ","), path_hits=F.col("path_hits"), term_hits=F.col("term_hits")).alias("score"))


SAFE = [(1, "src/a{n}.py", "+token = 'abcdefghij'"), (1, ".env", "+SECRET=1"), (1, "b.py", "+x"), (2, "only{n}.py", "+y"), (3, ".env", "+z"), (3, ".env.x", None)]


@query(f"SELECT * FROM {spread_sql([(1, 1, 'src/a{n}.py', '+token = [REDACTED]'), (1, 2, 'b.py', '+x'), (1, 3, '1 omitted', None), (2, 1, 'only{n}.py', '+y'), (3, 1, '2 omitted', None)], 'repo_id, pos, path, body')} t")
def q_safe_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each diff's files without ignored ones, redacted, and how many were left out."""
    return diffs.safe_files(spread(spark, sf_dir, "repo_id int, path string, body string", SAFE), "repo_id")
