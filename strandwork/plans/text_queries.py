"""Queries over scalar functions, scans and regex extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork import config
from strandwork.functions import paths, text, times
from strandwork.operators import extract, ranking
from strandwork.plans.registry import query, spread_sql, values
from strandwork.sources.tables import capitalised, documents_as_files, spread, table

PATH = "source || '/' || lang || '/' || doc_id || '.txt'"
PATHS = [
    ("src/app/main{n}.py",), ("src/app/Main{n}.TSX",), ("node_modules/left{n}/index.js",), ("pkg{n}.egg-info/PKG-INFO",), (".env",),
    ("conf{n}/.env.local",), ("keys/server{n}.PEM",), ("Build/out{n}.js",), ("docs{n}/readme.md",), ("pyproject.toml",), ("deep/a/b{n}/c/Service.kt",),
    ("tests/test_main{n}.py",), ("web/button{n}.spec.ts",), ("Makefile",), ("secrets.json",), ("../outside{n}.py",), ("src/.hidden{n}",), ("a{n}/build.gradle.kts",),
]


def _list(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_NAME = "lower(list_extract(string_split(path, '/'), -1))"
_SUFFIX = f"lower(regexp_extract(list_extract(string_split(path, '/'), -1), '^.+\\.([^.]+)$', 1))"
_IGNORED = f"""(path LIKE '/%' OR list_contains(string_split(path, '/'), '..')
    OR len(list_filter(string_split(lower(path), '/'), lambda p: p IN {_list(config.EXCLUDED_DIRECTORIES)} OR ends_with(p, '.egg-info'))) > 0
    OR {_NAME} = '.env' OR starts_with({_NAME}, '.env.') OR {_NAME} IN {_list(config.SECRET_NAMES)} OR {_SUFFIX} IN {_list(config.SECRET_SUFFIXES)})"""


@query(f"""SELECT {PATH} AS path, length(text) AS n_chars FROM documents
    WHERE NOT list_contains({_list(config.EXCLUDED_DIRECTORIES).replace('(', '[', 1)[:-1]}], lower(source))""")
def q_scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2, A4: documents as files, excluded directories pruned."""
    files = documents_as_files(spark, sf_dir)
    return files.where(~paths.is_ignored(F.col("path"))).select("path", F.length("text").cast("long").alias("n_chars"))


@query(f"""SELECT path, {_IGNORED} AS ignored,
        NOT {_IGNORED} AND {_SUFFIX} IN {_list(config.INDEXED_SUFFIXES)} AS indexable,
        {_NAME} IN {_list(config.PROJECT_FILES)} OR {_SUFFIX} IN {_list(config.SOURCE_SUFFIXES)} AS source_file,
        starts_with(lower(list_extract(string_split(path, '/'), -1)), 'test_')
            OR regexp_matches(lower(path), '(_test\\.py|\\.(test|spec)\\.(ts|js))$') AS test_file
    FROM {spread_sql(PATHS, "path")} t""")
def q_path_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each path is."""
    p = F.col("path")
    return spread(spark, sf_dir, "path string", PATHS).select(
        "path", paths.is_ignored(p).alias("ignored"), paths.is_indexable(p).alias("indexable"), paths.is_source(p).alias("source_file"), paths.is_test(p).alias("test_file")
    )


@query(f"SELECT {PATH} AS path, sha256(text) AS sha256, strlen(text) AS bytes FROM documents")
def q_snapshot_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and hash of every file from one read."""
    return documents_as_files(spark, sf_dir).select("path", F.sha2(F.col("text"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


_WORDS = f"""list_distinct(list_filter(list_transform(regexp_extract_all(text, '{text.WORD}'), lambda w: lower(w)),
    lambda w: length(w) >= 3 AND w NOT IN {_list(config.STOP_WORDS)}))"""


@query(f"""WITH words AS (SELECT item_id, unnest(list_sort({_WORDS})[1:12]) AS word FROM benchmark),
    hits AS (SELECT w.word, d.doc_id, row_number() OVER (PARTITION BY w.word ORDER BY d.doc_id) AS nth
        FROM (SELECT DISTINCT word FROM words) w JOIN documents d ON contains(lower(d.text), w.word))
    SELECT word, count(*) AS files, max(doc_id) AS last_doc FROM hits WHERE nth <= 80 GROUP BY word""")
def q_textscan_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the first twelve words of each task, up to 80 files whose text holds the word."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.slice(F.array_sort(text.task_words(F.col("text"), synonyms={})), 1, 12)).alias("word")).distinct()
    # a word stands in a text if it stands in one of its runs of word characters
    runs = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(text.WORD), F.lit(0)))
    runs = table(spark, sf_dir, "documents").select("doc_id", F.explode(runs).alias("s"))
    hits = ranking.containing(runs, words).join(runs, "s").select("word", "doc_id").distinct()
    best = ranking.top_k(hits, 80, ["word"], [F.col("doc_id")])
    return best.groupBy("word").agg(F.count(F.lit(1)).alias("files"), F.max("doc_id").alias("last_doc"))


REPORTS = [
    ("r1-{n}", "Status: FAILED\nExit code: 1\nCommand: runner -q\nDuration: 2.50 s\n\nFAIL: test_a (pkg.tests.A{n}.test_a)\nERROR: test_b (pkg.tests.B.test_b)\nFAILED (failures=1, errors=1)\n"),
    ("r2-{n}", "Status: PASSED\nExit code: 0\nCommand: npm test\nDuration: 10 s\n"),
    ("r3-{n}", "Status: FAILED\nCommand: pytest\nFAILED tests/test_x{n}.py::test_one - boom\nFAILED tests/test_x{n}.py::test_one - boom\nFAILED tests/test_y.py::T::test_two\n2 failed\n"),
    ("r4-{n}", "nothing to see"),
]
_REPORTS = spread_sql(REPORTS, "run_id, body")


@query(f"""SELECT run_id, nullif(regexp_extract(body, '(?m)^Status: *(.*)$', 1), '') AS status,
        try_cast(nullif(regexp_extract(body, '(?m)^Exit code: *(.*)$', 1), '') AS INT) AS exit_code,
        nullif(regexp_extract(body, '(?m)^Command: *(.*)$', 1), '') AS command,
        CAST(round(1000 * try_cast(regexp_replace(regexp_extract(body, '(?m)^Duration: *(.*)$', 1), ' *s$', '') AS DOUBLE)) AS BIGINT) AS millis
    FROM {_REPORTS} t""")
def q_report_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved reports back into rows."""
    f = extract.report_fields(F.col("body"))
    return spread(spark, sf_dir, "run_id string, body string", REPORTS).select("run_id", f["status"].alias("status"), f["exit_code"].alias("exit_code"), f["command"].alias("command"), F.round(f["duration"] * 1000).cast("long").alias("millis"))


@query(f"""WITH lines AS (SELECT run_id, unnest(string_split(body, chr(10))) AS line FROM {_REPORTS} t)
    SELECT DISTINCT run_id, coalesce(nullif(regexp_extract(line, '^(FAIL|ERROR): \\S+ \\(([^)]+)\\)', 2), ''), nullif(regexp_extract(line, '^FAILED (\\S+::\\S+)', 1), '')) AS test_id
    FROM lines WHERE test_id IS NOT NULL""")
def q_failing_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct failing tests of each report."""
    return extract.test_failures(spread(spark, sf_dir, "run_id string, body string", REPORTS), "body", "run_id")


SCRIPTS = [
    ("a{n}.ts", "import x from './b'\nexport class Alpha{n} {}\nexport const run = async (a, b) => a\nconst plain = 3\ninterface Shape {}\n"),
    ("b{n}.js", "const fs = require('fs')\nfunction beta() {}\nexport default function gamma() {}\nimport 'side'\n"),
]


@query(f"""SELECT * FROM {spread_sql([('a{n}.ts', 'Alpha{n}', 'class'), ('a{n}.ts', 'run', 'function'), ('a{n}.ts', 'Shape', 'interface'), ('b{n}.js', 'beta', 'function'), ('b{n}.js', 'gamma', 'function'),
    ('a{n}.ts', './b', 'import'), ('b{n}.js', 'fs', 'import'), ('b{n}.js', 'side', 'import')], "path, name, kind")} t""")
def q_script_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: declarations and imports of scripts."""
    df = spread(spark, sf_dir, "path string, content string", SCRIPTS)
    names = df.select("path", F.explode(extract.generic_symbols(F.col("content"))).alias("s")).select("path", "s.name", "s.kind")
    return names.union(df.select("path", F.explode(extract.generic_imports(F.col("content"))).alias("name"), F.lit("import").alias("kind")))


@query("""WITH quoted AS (SELECT page_id, unnest(regexp_extract_all(html, '"([^"\\n]*)"', 1)) AS s, 1 AS weight FROM pages),
    shown AS (SELECT page_id, unnest(regexp_extract_all(html, '>([^<>{}]+)<', 1)) AS s, 2 AS weight FROM pages),
    words AS (SELECT page_id, unnest(regexp_extract_all(lower(s), '[a-z0-9]+')) AS word, weight FROM (FROM quoted UNION ALL FROM shown)),
    best AS (SELECT page_id, word, max(weight) AS weight FROM words WHERE length(word) >= 3 GROUP BY ALL)
    SELECT page_id, count(*) AS words, sum(weight)::BIGINT AS weight FROM best GROUP BY page_id""")
def q_literal_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted words of quoted and shown text, the heavier weight kept."""
    terms = extract.literal_terms(table(spark, sf_dir, "pages"), "html", "page_id")
    return terms.groupBy("page_id").agg(F.count(F.lit(1)).alias("words"), F.sum("weight").alias("weight"))


_CAPS = "list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))"
_FIRST = """list_transform(list_filter(list_transform(regexp_extract_all(text, '[A-Z][a-z]+'), lambda x, i: {'x': x, 'i': i}),
    lambda y: list_position(regexp_extract_all(text, '[A-Z][a-z]+'), y.x) = y.i), lambda y: y.x)"""


@query(f"""SELECT doc_id, left(lang || ' file ' || {PATH} || CASE WHEN len(s) > 0 THEN ' with ' || array_to_string(s[1:8], ', ') ELSE '' END || '.', 600) AS summary
    FROM (SELECT *, {_FIRST} AS s FROM documents)""")
def q_static_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence for each file."""
    files = documents_as_files(spark, sf_dir).withColumn("names", capitalised(F.col("text")))
    return files.select("doc_id", extract.static_summary(F.col("lang"), F.col("path"), F.col("names")).alias("summary"))


@query(f"""WITH w AS (SELECT doc_id, [lower(lang)] || string_split_regex(lower({PATH}), '[^a-z0-9]+') || list_transform({_FIRST}, lambda x: lower(x)) AS words FROM documents),
    each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
    firsts AS (SELECT doc_id, word, min(i) AS i FROM each WHERE length(word) >= 2 GROUP BY ALL),
    ten AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM firsts)
    SELECT doc_id, string_agg(word, ',' ORDER BY i) AS tags FROM ten WHERE n <= 10 GROUP BY doc_id""")
def q_static_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten tags of each file."""
    files = documents_as_files(spark, sf_dir).withColumn("names", capitalised(F.col("text")))
    return files.select("doc_id", F.array_join(extract.static_tags(F.col("lang"), F.col("path"), F.col("names")), ",").alias("tags"))


RESPONSES = [
    (1, '{"summary": "short {n}", "tags": ["a", "b"], "important_symbols": ["X"]}'), (2, ""), (3, "not json"), (4, '{"tags": []}'),
    (5, '{"summary": "s", "tags": "one", "important_symbols": []}'), (6, None), (7, '["list"]'),
]


@query(f"""SELECT id, CASE WHEN trim(coalesce(body, '')) = '' THEN 'empty_response' WHEN NOT json_valid(body) THEN 'invalid_json'
        WHEN json_type(body) <> 'OBJECT' OR json_extract_string(body, '$.summary') IS NULL THEN 'schema_validation_error' ELSE 'complete' END AS status,
        CASE WHEN json_valid(body) THEN left(json_extract_string(body, '$.summary'), 600) END AS summary,
        coalesce(CASE WHEN json_valid(body) THEN CASE json_type(body, '$.tags') WHEN 'ARRAY' THEN json_array_length(body, '$.tags') WHEN 'VARCHAR' THEN 1 ELSE 0 END END, 0)::BIGINT AS tags
    FROM {spread_sql(RESPONSES, "id, body")} t""")
def q_json_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses as validated rows or a reason."""
    from strandwork.operators.json_objects import validated

    out = spread(spark, sf_dir, "id int, body string", RESPONSES).select("id", validated(F.col("body")).alias("v"))
    return out.select("id", "v.status", "v.summary", F.size("v.tags").cast("long").alias("tags"))


_LINES = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"""


@query(f"""WITH {_LINES}, firsts AS (SELECT doc_id, min(line_no) AS f FROM lines WHERE contains(line, 'token') GROUP BY doc_id),
    near AS (SELECT l.*, f FROM lines l JOIN firsts USING (doc_id) WHERE line_no >= f - 2 AND line_no < f - 2 + 180)
    SELECT doc_id, count(*) AS lines, min(line_no) AS start_line, max(line_no) AS end_line FROM near n
    WHERE line_no < coalesce((SELECT min(line_no) FROM lines s WHERE s.doc_id = n.doc_id AND s.line_no > n.f AND regexp_matches(s.line, '^(FAIL|ERROR)')), 1000000000)
        AND NOT (line = '' AND line_no = (SELECT max(line_no) FROM lines s WHERE s.doc_id = n.doc_id))
    GROUP BY doc_id""")
def q_failure_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines around the first mention of a word."""
    numbered = extract.lines(table(spark, sf_dir, "documents"), "text", "doc_id")
    cut = extract.failure_excerpt(numbered, "token", "doc_id")
    return cut.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.min("line_no").cast("long").alias("start_line"), F.max("line_no").cast("long").alias("end_line"))


@query("""WITH g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS owner_no FROM conversations)
    SELECT conv_id, owner_no::BIGINT AS owner_no, count(*) AS parts, string_agg(text, ' ' ORDER BY turn) AS owner_text FROM g GROUP BY ALL""")
def q_owner_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each owner's text with the fragments after it."""
    groups = extract.owner_groups(table(spark, sf_dir, "conversations"), F.col("role") == "user", "turn", "conv_id")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    return groups.groupBy("conv_id", "owner_no").agg(F.count(F.lit(1)).alias("parts"), joined.alias("owner_text"))


_STEM = """list_filter([w, CASE WHEN ends_with(w, 'ies') AND length(w) > 5 THEN left(w, -3) || 'y' END, CASE WHEN ends_with(w, 'ing') AND length(w) > 5 THEN left(w, -3) END,
    CASE WHEN ends_with(w, 'ed') AND length(w) > 4 THEN left(w, -2) END, CASE WHEN ends_with(w, 's') AND length(w) > 4 THEN left(w, -1) END], lambda x: x IS NOT NULL)"""


def _tokens_sql(x: str) -> str:
    return f"""list_distinct(flatten(list_transform(list_transform(list_filter(regexp_extract_all(replace({x}, '_', ' '), '{text.PLAIN_WORD}'), lambda w: length(w) >= 3),
        lambda w: lower(replace(w, 'ß', 'ss'))), lambda w: {_STEM})))"""


@query(f"SELECT item_id, array_to_string(list_sort({_WORDS}), ' ') AS words, array_to_string(list_sort({_tokens_sql('text')}), ' ') AS tokens FROM benchmark")
def q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and stemmed tokens of every task."""
    t = F.col("text")
    join = lambda x: F.array_join(F.array_sort(x), " ")
    return table(spark, sf_dir, "benchmark").select("item_id", join(text.task_words(t, synonyms={})).alias("words"), join(text.surface_tokens(t)).alias("tokens"))


@query(f"""SELECT page_id, array_to_string(list_sort({_tokens_sql("regexp_replace(replace(url, '_', ' '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')")}), ' ') AS tokens FROM pages""")
def q_camel_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of identifiers, camel case and underscores apart."""
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(text.tokens(F.col("url"))), " ").alias("tokens"))


TASKS = [
    (1, "Add an endpoint to save invoices; show a button on the page and update the tests."), (2, "Fix typo {n}"),
    (3, "1. Create the ledger table\n2. Render the screen, and add fixtures\n3. Use the store"), (4, "Do not change the request handler"), (5, "rename Widgets and Dialogs"),
]


def _roles_sql(tokens: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN list_has_any({tokens}, {list(terms)!r}) THEN '{role}' END" for role, terms in sorted(config.ROLE_TERMS.items())) + "], lambda x: x IS NOT NULL)"


@query(f"""SELECT id, array_to_string({_roles_sql(_tokens_sql('task'))}, ',') AS roles,
        regexp_matches(task, '(?i)\\b(do not|don''t|never|without) (change|changing|modify|modifying|touch|touching)\\b|\\binspect first\\b|\\bfollow\\b.*\\bpatterns?\\b') AS support_only
    FROM {spread_sql(TASKS, "id, task")} t""")
def q_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles a task names, and whether it only constrains."""
    t = F.col("task")
    return spread(spark, sf_dir, "id int, task string", TASKS).select("id", F.array_join(text.surface_roles(text.surface_tokens(t)), ",").alias("roles"), text.is_support_only(t).alias("support_only"))


_VERBS = "|".join(config.ACTION_WORDS)


@query(f"""WITH p AS (SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^[ \\t]*([-*•]|[0-9]+[.)])[ \\t]+', '', 'g'),
            '(?i),[ \\t]+({_VERBS})\\b', chr(10) || '\\1', 'g'), '(?i)\\b(?:and|och)[ \\t]+({_VERBS})\\b', chr(10) || '\\1', 'g'), ';|\\n+|[.!?]+[ \\t\\n]+') AS parts FROM documents),
    each AS (SELECT doc_id, trim(unnest(parts), ' ' || chr(9) || chr(13) || chr(10)) AS part, generate_subscripts(parts, 1) AS i FROM p),
    firsts AS (SELECT doc_id, part, min(i) AS i FROM each WHERE part <> '' GROUP BY ALL),
    twelve AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM firsts)
    SELECT doc_id, count(*) AS surfaces, string_agg(part, chr(10) ORDER BY i) AS joined FROM twelve WHERE n <= 12 GROUP BY doc_id""")
def q_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered distinct clauses of every text, at most twelve."""
    s = table(spark, sf_dir, "documents").select("doc_id", text.task_surfaces(F.col("text")).alias("s")).where("size(s) > 0")
    return s.select("doc_id", F.size("s").cast("long").alias("surfaces"), F.array_join("s", "\n").alias("joined"))


@query("""WITH terms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark),
    tokens AS (SELECT DISTINCT unnest(regexp_extract_all(lower(url), '[a-z]+')) AS token FROM pages)
    SELECT term, token FROM terms, tokens WHERE term = token OR (least(length(term), length(token)) >= 4 AND (starts_with(term, token) OR starts_with(token, term)))""")
def q_prefix_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of tasks and tokens of urls that match by prefix."""
    words = lambda name, column, alias: table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all(F.lower(column), F.lit("[a-z]+"), F.lit(0))).alias(alias)).distinct()
    # a match is equal or shares its first four letters: joined on the first four
    key = lambda c: F.left(F.col(c), F.lit(4)).alias("key")
    terms, found = words("benchmark", "text", "term"), words("pages", "url", "token")
    met = terms.select("term", key("term")).join(found.select("token", key("token")), "key")
    return met.where(text.term_matches(F.col("term"), F.col("token"))).select("term", "token")


@query(f"""SELECT doc_id AS id, 'document' AS kind, sha256({text.redact_sql('text')}) AS sha256, length({text.redact_sql('text')}) AS n_chars FROM documents
    UNION ALL SELECT page_id, 'page', sha256({text.redact_sql('html')}), length({text.redact_sql('html')}) FROM pages""")
def q_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: secrets replaced in every text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), text.redact(F.col("text")).alias("t"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("page"), text.redact(F.col("html")))
    return docs.union(pages).select("id", "kind", F.sha2("t", 256).alias("sha256"), F.length("t").cast("long").alias("n_chars"))


ENTRIES = [("20240102-030405-applied{n}", None), ("20240102-030405-000123.diff", None), ("misc", "2024-05-06T07:08:09+00:00"), ("notes{n}", None), ("20241399-000000", None)]


@query(f"""SELECT name, coalesce(CAST(stamp AS TIMESTAMPTZ)::TIMESTAMP,
        try_strptime(regexp_extract(name, '^([0-9]{{8}}-[0-9]{{6}}-[0-9]{{6}})', 1), '%Y%m%d-%H%M%S-%f'),
        try_strptime(regexp_extract(name, '^([0-9]{{8}}-[0-9]{{6}})', 1), '%Y%m%d-%H%M%S'), TIMESTAMP '1970-01-01') AS entry_at
    FROM {spread_sql(ENTRIES, "name, stamp")} t""")
def q_history_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry's time from metadata, else from its name."""
    at = times.entry_time([F.col("stamp")], F.col("name"), F.lit(None).cast("timestamp"))
    return spread(spark, sf_dir, "name string, stamp string", ENTRIES).select("name", at.cast("timestamp_ntz").alias("entry_at"))


@query("""SELECT doc_id, CASE WHEN length(text) > 2000 THEN '[cut]' || right(text, 2000) ELSE text END AS tail,
        CASE WHEN length(text) * 40 <= 90000 THEN 90000 ELSE least(180000, greatest(90000, length(text) * 40 + 12000)) END AS budget FROM documents""")
def q_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last characters kept, and a budget that grows with what is required."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.keep_tail(t, 2000, "[cut]").alias("tail"), text.context_budget(F.length(t) * 40).cast("long").alias("budget"))


PATCHES = [(1, "\n```diff\n--- a/x{n}\n+++ b/x\n```\n"), (2, "--- a/y\n+++ b/y"), (3, "```\nplain\n```"), (4, "\n\n  \nbody\n\n")]


PATCH_TEXTS = [(1, "--- a/x{n}\n+++ b/x\n"), (2, "--- a/y\n+++ b/y\n"), (3, "plain\n"), (4, "body\n")]


@query(f"SELECT * FROM {spread_sql(PATCH_TEXTS, 'id, patch')} t")
def q_patch_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patch text without fence, ending with a new line."""
    return spread(spark, sf_dir, "id int, body string", PATCHES).select("id", paths.normalized_patch(F.col("body")).alias("patch"))


SETTINGS = [("a{n}", " Yes ", "12"), ("b{n}", "0", "-3"), ("c{n}", None, "x"), ("d{n}", "ON", None)]


@query(f"""SELECT name, coalesce(lower(trim(flag)) IN ('1', 'true', 'yes', 'on'), FALSE) AS flag, coalesce(nullif(greatest(try_cast(number AS INT), 0), 0), 7) AS number,
        nullif(left(trim(flag), 500), '') AS clipped FROM {spread_sql(SETTINGS, "name, flag, number")} t""")
def q_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags, positive numbers and clipped text of settings."""
    return spread(spark, sf_dir, "name string, flag string, number string", SETTINGS).select("name", text.truthy(F.col("flag")).alias("flag"), text.positive_int(F.col("number"), 7).alias("number"), text.clipped_or_null(F.col("flag")).alias("clipped"))
