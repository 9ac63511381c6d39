"""Queries over named targets, structural ties, generated source trees, reports and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandwork import config
from strandwork.operators import extract, history, json_objects, python_source, ranking, targets
from strandwork.plans import retrieval
from strandwork.plans.join_queries import PATH
from strandwork.plans.registry import query, spread_sql, values
from strandwork.sources.tables import document_path, documents_as_files, spread, table


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_name").alias("name"), F.col("p_type").alias("qualified_name"), "p_size", "p_brand")


@query("""WITH hints AS (SELECT DISTINCT p_size AS task_id, lower(p_name) AS hint FROM part WHERE p_partkey % 10 = 0)
    SELECT DISTINCT task_id, p_partkey AS path, p_name AS name FROM part JOIN hints ON lower(p_name) = hint""")
def q_semi_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that hints name, without regard to case."""
    symbols = part_symbols(spark, sf_dir)
    hints = symbols.where("path % 10 = 0").select(F.col("p_size").alias("task_id"), F.upper("name").alias("hint"))
    return targets.hinted(symbols, hints, "task_id")


@query("""WITH tokens AS (SELECT DISTINCT s_nationkey AS task_id, p_name AS token, 'class' AS kind FROM supplier JOIN part ON p_partkey = s_suppkey
        UNION SELECT DISTINCT s_nationkey, p_type, 'class' FROM supplier JOIN part ON p_partkey = s_suppkey + 1 UNION SELECT DISTINCT s_nationkey, p_name, 'call' FROM supplier JOIN part ON p_partkey = s_suppkey + 2),
    hit AS (SELECT DISTINCT task_id, p_partkey AS path, token, kind FROM tokens JOIN part ON token = p_name OR kind = 'class' AND token = p_type),
    s AS (SELECT task_id, path, sum(CASE kind WHEN 'class' THEN 200 ELSE 180 END)::BIGINT AS score FROM hit GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, lower(path::VARCHAR), path) AS rank FROM s)
    SELECT task_id, path, score, rank FROM r WHERE rank <= 8""")
def q_explicit_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts named by class and call tokens, the best eight of each task."""
    symbols, supplier = part_symbols(spark, sf_dir), table(spark, sf_dir, "supplier")
    named = lambda shift, c, kind: supplier.join(symbols, F.col("path") == F.col("s_suppkey") + shift).select(F.col("s_nationkey").alias("task_id"), F.col(c).alias("token"), F.lit(kind).alias("kind"))
    tokens = named(0, "name", "class").union(named(1, "qualified_name", "class")).union(named(2, "name", "call"))
    return targets.explicit(tokens, symbols)


COMMANDS = [("app{n}.py", "go", "start{n}"), ("app{n}.py", "stop{n}", None)]
COMMAND_TASKS = [(1, "run `start{n}` now"), (2, "the stop{n} command"), (3, "unstop{n}pable starts{n}")]


@query(f"SELECT * FROM {spread_sql([(1, 'app{n}.py', 'go', 240), (2, 'app{n}.py', 'stop{n}', 240)], "task_id, path, function_name, score")} t")
def q_command_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that a task names, by their own name or their function's."""
    return targets.commands(spread(spark, sf_dir, "task_id int, text string", COMMAND_TASKS), spread(spark, sf_dir, "path string, function_name string, name string", COMMANDS))


WORDS = ("steel", "brass", "red", "blue", "nut", "promo", "ring", "green")


@query(f"""WITH words(word) AS (VALUES {values([(w,) for w in WORDS])})
    SELECT p_partkey, (sum(CASE WHEN contains(lower(p_type), word) THEN 20 ELSE 0 END) + sum(CASE WHEN contains(lower(p_name), word) THEN 28 ELSE 0 END))::BIGINT AS score
    FROM part, words GROUP BY p_partkey HAVING score > 0""")
def q_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for each word that a part's type or name holds."""
    score = targets.contains_points(F.array(*map(F.lit, WORDS)), {"p_type": 20, "p_name": 28})
    return table(spark, sf_dir, "part").select("p_partkey", score.cast("long").alias("score")).where("score > 0")


_HANDLER = "class {0}:\n" + "".join(f"    def do_{m}(self): pass\n" for m in ("GET", "POST", "OPTIONS"))
WEB = [
    ("w{n}/ui/form.js", "fetch('/x', {method: 'PATCH'})\nfetch('/y', { method : cond ? 'get' : \"x\" })"), ("w{n}/ui/plain.js", "fetch('/x')"),
    ("w{n}/web/server.py", "import ui\n" + _HANDLER.format("Server") + "class Two:\n    def do_GET(self): pass\n    def do_PUT(self): pass\n"), ("w{n}/web/other.py", _HANDLER.format("Other") + "    def do_PATCH(self): pass\n"), ("w{n}/web/far.py", _HANDLER.format("Far")),
]
WEB_DEPS = [("w{n}/web/server.py", "w{n}/ui/form.js"), ("w{n}/web/other.py", "w{n}/ui/form.js"), ("w{n}/web/other.py", "w{n}/ui/plain.js"), ("w{n}/web/far.py", "w{n}/web/other.py")]


@query(f"SELECT * FROM {spread_sql([(1, 'w{n}/web/other.py', 'Other', 'do_GET,do_OPTIONS,do_PATCH,do_POST', 290, 2), (1, 'w{n}/web/server.py', 'Server', 'do_GET,do_OPTIONS,do_POST', 310, 1)], "task_id, path, owner, handlers, score, rank")} t ")
def q_transport_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handler classes tied to code that sends requests: with a missing method 60 + 120 + 50 + 80, with all of them 80 + 120 + 50 + 40."""
    files = spread(spark, sf_dir, "path string, content string", WEB)
    found = targets.transport_roots(files, python_source.definitions(files.where("path LIKE '%.py'")), spread(spark, sf_dir, "src string, dst string", WEB_DEPS), spread(spark, sf_dir, "task_id int, path string", [(1, "w{n}/ui/form.js"), (2, "w{n}/ui/plain.js")]))
    return found.withColumn("handlers", F.array_join("handlers", ","))


BOT = [
    ("b{n}/bot/cmd.py", "@team.autocomplete(name{n}=by{n}_name)\nasync def show(ctx): pass\n\n@x.my_autocomplete(name{n}=by{n}_league, season=seasons)\ndef league(ctx): pass\n\n@command(name{n}=ignored)\ndef other(): pass\n\ndef by{n}_league():\n    return 'active teams'\n"),
    ("b{n}/tests/test_cmd.py", "@autocomplete(name{n}=from_tests{n})\ndef t(): pass\n"), ("b{n}/bot/more.py", "@autocomplete(name{n}=all{n}_names)\ndef show_all(): pass\n"),
]
BOT_TASKS = [(1, "Only offer active teams of the league"), (2, "show the names")]


@query(f"SELECT * FROM {spread_sql([(1, 'b{n}/bot/cmd.py', 'league', 'name{n}', 'by{n}_league', 660, 1), (1, 'b{n}/bot/more.py', 'show_all', 'name{n}', 'all{n}_names', 300, 2), (2, 'b{n}/bot/cmd.py', 'show', 'name{n}', 'by{n}_name', 350, 2), (2, 'b{n}/bot/more.py', 'show_all', 'name{n}', 'all{n}_names', 420, 1)], "task_id, path, command, parameter, callback, score, rank")} t")
def q_alt_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other callbacks for a parameter whose attempted one didn't do; a literal word weighs 120, a name's 70, a command's 50."""
    files = spread(spark, sf_dir, "path string, content string", BOT)
    attempted = spread(spark, sf_dir, "task_id int, callback string", [(1, "by{n}_name"), (2, "by{n}_league"), (3, "unknown")])
    return targets.alternative_callbacks(python_source.bindings(files), python_source.literal_terms(files), spread(spark, sf_dir, "task_id int, text string", BOT_TASKS), attempted)


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (nth <= 5) AS in_first FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events) GROUP BY event_type""")
def q_reason_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by reason, in all and among the first five."""
    return ranking.reason_histogram(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "user_id")


@query("""WITH d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))) AS name FROM documents), own AS (SELECT doc_id, regexp_extract(text, '[A-Z][a-z]+') AS name FROM documents WHERE regexp_matches(text, '[A-Z][a-z]+')),
    one AS (SELECT name, min(doc_id) AS doc_id FROM own GROUP BY name)
    SELECT d.doc_id, count(*) AS named, min(o.doc_id) AS first_named FROM d JOIN one o ON d.name = o.name AND d.doc_id <> o.doc_id GROUP BY d.doc_id""")
def q_mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name what another defines, whole identifiers only."""
    return mentions(spark, sf_dir).groupBy(F.col("path").alias("doc_id")).agg(F.count(F.lit(1)).alias("named"), F.min("other_path").alias("first_named"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text").where(F.col("text").rlike("[A-Z][a-z]+"))
    known = docs.select(F.regexp_extract("text", "[A-Z][a-z]+", 0).alias("name"), "path").groupBy("name").agg(F.min("path").alias("path"))
    return targets.mentioned_by(docs, known, "[A-Z][a-z]+")


@query("""WITH d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))) AS name FROM documents), own AS (SELECT doc_id, regexp_extract(text, '[A-Z][a-z]+') AS name FROM documents WHERE regexp_matches(text, '[A-Z][a-z]+')),
    one AS (SELECT name, min(doc_id) AS doc_id FROM own GROUP BY name), m AS (SELECT d.doc_id AS a, o.doc_id AS b FROM d JOIN one o ON d.name = o.name AND d.doc_id <> o.doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY other) AS rank FROM (SELECT a AS path, b AS other FROM m UNION SELECT b, a FROM m))
    SELECT path, other, rank FROM r WHERE rank <= 4""")
def q_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: one hop both ways along mentions, the first four."""
    return targets.one_hop(mentions(spark, sf_dir))


_TIMES = "least(10, (length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), '{0}', ''))) // {1}) * 5"
_LEGACY = " + ".join(f"CASE WHEN contains(lower(regexp_replace({PATH}, '^.*/', '')), '{w}') THEN 100 WHEN contains(lower({PATH}), '{w}') THEN 50 ELSE 0 END + {_TIMES.format(w, len(w))}" for w in ("the", "en", "1"))


@query(f"""SELECT doc_id, (CASE WHEN toxic = 1 THEN 1000 ELSE 0 END + CASE WHEN source = 'src0' THEN 50 ELSE 0 END + {_LEGACY})::BIGINT AS score FROM documents LEFT JOIN labels USING (doc_id)""")
def q_legacy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed and important files, words in names or paths, and occurrences up to ten."""
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    score = targets.legacy_score(document_path(), F.col("text"), ["the", "en", "1"], changed=F.col("toxic") == 1, important=F.col("source") == "src0")
    return df.select("doc_id", score.cast("long").alias("score"))


@query("""WITH v AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM v)
    SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ', ' ORDER BY o_orderkey) FILTER (r <= 10) || CASE WHEN max(n) > 10 THEN ' … and ' || (max(n) - 10) || ' more' ELSE '' END AS shown FROM n GROUP BY o_custkey""")
def q_first_and_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of each list, and how many more there are."""
    return targets.first_and_more(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")


@query(f"""SELECT path, line FROM (
        (SELECT {PATH} AS path, {PATH} AS line FROM documents ORDER BY 1 LIMIT {config.TREE_FILES})
        UNION ALL SELECT '~', '[tree truncated]' FROM (SELECT count(*) AS n FROM documents) WHERE n > {config.TREE_FILES})""")
def q_tree_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 paths and a mark if there are more."""
    return targets.tree(documents_as_files(spark, sf_dir), config.TREE_FILES)


@query("""WITH found AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"\\n]*)"', 1)) AS target FROM pages)
    SELECT page_id, count(*) AS links, count(DISTINCT target) AS targets, min(target) AS first_target FROM found GROUP BY page_id""")
def q_imports_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: targets named in a text, by pattern."""
    found = extract.named_targets(table(spark, sf_dir, "pages"), "html", 'href="([^"\\n]*)"', "page_id")
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("target").alias("targets"), F.min("target").alias("first_target"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def q_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON object in a text with other text, a fence or a break around it."""
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("sorry {"), "props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), "props", F.lit(" done")))
    found = table(spark, sf_dir, "events").select("event_id", json_objects.tolerant_object(body).alias("found"))
    return found.select("event_id", F.from_json("found", "k bigint")["k"].alias("k"))


@query("""SELECT d.doc_id, d.source || CASE WHEN l.doc_id IS NULL THEN ' (unavailable)' ELSE '' END AS shown FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def q_selected_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """selected files, marked where they were not rendered."""
    return targets.shown(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "source")


MODULE = """from pkg import m%1$d
import pkg.m%2$d


class C%3$d:
    def get(self):
        return self.put(run%1$d())

    def put(self, x):
        return m%1$d.run%1$d(x)


def run%3$d(x=0):
    return C%3$d().get()
"""
_MODULES = "m AS (SELECT s_suppkey AS k, s_nationkey + 1 AS a, s_suppkey % 7 + 1 AS b FROM supplier), deps AS (SELECT DISTINCT k, d FROM (SELECT k, a AS d FROM m UNION SELECT k, b FROM m) WHERE d <> k AND d IN (SELECT k FROM m))"


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source tree with a Python module for each supplier."""
    s = table(spark, sf_dir, "supplier")
    content = F.format_string(MODULE, (F.col("s_nationkey") + 1).cast("long"), F.col("s_suppkey") % 7 + 1, F.col("s_suppkey"))
    return s.select(F.concat(F.lit("pkg/m"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("path"), content.alias("content"))


@query(f"""WITH {_MODULES} SELECT 'pkg/m' || k || '.py' AS path, q AS qualified_name, kind, s AS start_line, e AS end_line FROM m,
    LATERAL (VALUES ('C' || k, 'class', 5, 10), ('C' || k || '.get', 'method', 6, 7), ('C' || k || '.put', 'method', 9, 10), ('run' || k, 'function', 13, 14)) t(q, kind, s, e)""")
def q_module_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of a generated tree with their lines."""
    return python_source.definitions(modules(spark, sf_dir)).select("path", "qualified_name", "kind", "start_line", "end_line")


@query(f"""WITH {_MODULES} SELECT 'pkg/m' || k || '.py' AS path, d AS definition, pos, callee, receiver FROM m,
    LATERAL (VALUES ('C' || k || '.get', 0, 'put', 'self'), ('C' || k || '.get', 1, 'run' || a, 'bare'), ('C' || k || '.put', 0, 'run' || a, 'qualified'), ('run' || k, 0, 'get', 'qualified'), ('run' || k, 1, 'C' || k, 'bare')) t(d, pos, callee, receiver)""")
def q_module_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges of a generated tree with the kind of their receiver."""
    return python_source.calls(modules(spark, sf_dir)).drop("owner")


@query(f"WITH {_MODULES} SELECT 'pkg/m' || k || '.py' AS src, 'pkg/m' || d || '.py' AS dst FROM deps")
def q_module_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies of a generated tree, by the longest module name that there is."""
    return retrieval.build_index(modules(spark, sf_dir)).deps.select("src", "dst")


@query(f"""WITH {_MODULES}, hit AS (
        SELECT k, 'C' || k || '.get' AS src, k AS d, 'C' || k || '.put' AS dst FROM m
        UNION ALL SELECT k, 'C' || k || '.get', a, 'run' || a FROM m WHERE a = k OR a IN (SELECT d FROM deps WHERE deps.k = m.k)
        UNION ALL SELECT k, 'C' || k || '.put', a, 'run' || a FROM m WHERE a IN (SELECT d FROM deps WHERE deps.k = m.k)
        UNION ALL SELECT k, 'run' || k, d, 'C' || d || '.get' FROM (SELECT k, min(d) AS d FROM deps GROUP BY k HAVING count(*) = 1)
        UNION ALL SELECT k, 'run' || k, k, 'C' || k FROM m)
    SELECT 'pkg/m' || k || '.py' AS src_path, src, 'pkg/m' || d || '.py' AS dst_path, dst FROM hit""")
def q_module_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a generated tree to the definitions they reach: own class, own file, then the one dependency that has the name."""
    return retrieval.resolved_calls(retrieval.build_index(modules(spark, sf_dir))).select("src_path", "src", "dst_path", "dst")


@query("""WITH e AS (SELECT user_id, event_id, floor(value * 100)::BIGINT AS cents, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS done FROM events),
    w AS (SELECT *, sum(cents) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM e)
    SELECT user_id, event_id, done, total - done AS remaining, floor(s / done)::BIGINT AS mean_cents, CASE WHEN done >= 2 THEN floor(s / done * (total - done))::BIGINT END AS eta_cents FROM w""")
def q_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: a progress row at every item: done, remaining, mean and expected time."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") * 100).alias("cents"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("total"))
    out = history.progress(e, F.col("total"), "event_id", "cents", "user_id")
    return out.select("user_id", "event_id", "done", "remaining", F.floor("mean_seconds").alias("mean_cents"), F.floor("eta_seconds").alias("eta_cents"))


@query("""WITH r AS (SELECT o_custkey AS repository, o_orderpriority AS config, o_orderdate AS saved_at, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderkey % 3 END AS returncode FROM orders),
    n AS (SELECT *, row_number() OVER (PARTITION BY repository, config ORDER BY saved_at DESC, returncode DESC) AS n FROM r WHERE returncode IS NOT NULL)
    SELECT repository, config, saved_at, returncode FROM n WHERE n = 1""")
def q_result_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of results by repository and configuration after new runs; unfinished runs aren't kept."""
    code = F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey") % 3)
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repository"), F.col("o_orderpriority").alias("config"), F.col("o_orderdate").alias("saved_at"), code.alias("returncode"), "o_orderkey")
    old = history.upsert_results(runs.drop("o_orderkey").limit(0), runs.where("o_orderkey % 2 = 0"), "repository", "config")
    return history.upsert_results(old, runs.where("o_orderkey % 2 = 1"), "repository", "config")


@query("""WITH patch AS (SELECT DISTINCT l_suppkey AS entry_id, l_partkey % 9 AS path FROM lineitem WHERE l_quantity > 40), files AS (SELECT DISTINCT l_suppkey AS id, l_partkey % 9 AS path FROM lineitem WHERE l_quantity > 35),
    snap AS (SELECT DISTINCT p_partkey % 9 AS path FROM part WHERE p_partkey % 9 <> 4 OR p_size < 0),
    p AS (SELECT entry_id, list_sort(list(path)) AS paths FROM patch GROUP BY ALL), f AS (SELECT id, list_sort(list(path)) AS paths FROM files GROUP BY ALL)
    SELECT 'r' || s_suppkey AS run_id, s_suppkey AS entry_id FROM supplier JOIN f ON f.id = s_suppkey JOIN p ON p.entry_id = s_suppkey
    WHERE s_nationkey % 2 = 0 AND f.paths = p.paths AND NOT EXISTS (SELECT 1 FROM patch x WHERE x.entry_id = s_suppkey AND x.path NOT IN (SELECT path FROM snap))""")
def q_consistent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose entry is applied, whose patch paths are the entry's, and whose snapshot has them all."""
    item, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    paths = lambda n, key: item.where(F.col("l_quantity") > n).select(F.col("l_suppkey").alias(key), (F.col("l_partkey") % 9).alias("path")).distinct()
    files = paths(35, "id").groupBy("id").agg(F.collect_list(F.struct("path")).alias("files"))
    status = F.when(F.col("s_nationkey") % 2 == 0, "APPLIED").otherwise("UNDONE")
    entries = s.select(F.col("s_suppkey").alias("id"), status.alias("status")).join(files, "id")
    runs = s.select(F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("run_id"), F.col("s_suppkey").alias("entry_id"))
    snapshot = table(spark, sf_dir, "part").select((F.col("p_partkey") % 9).alias("path")).where("path <> 4").distinct()
    return history.consistent(runs, entries, paths(40, "entry_id"), snapshot)


@query("""SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '  ' || CASE o_orderstatus WHEN 'F' THEN 'UNDONE' ELSE 'APPLIED' END || '  ' || CASE o_orderstatus WHEN 'O' THEN 'PASSED' ELSE 'NOT_RUN' END || '  ' || (o_custkey % 3) || CASE WHEN o_custkey % 3 = 1 THEN ' file' ELSE ' files' END AS line FROM orders""")
def q_history_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each entry of a history."""
    o = table(spark, sf_dir, "orders")
    name = F.date_format("o_orderdate", "yyyyMMdd-HHmmss")
    files = F.slice(F.array(F.lit("a"), F.lit("b")), 1, (F.col("o_custkey") % 3).cast("int"))
    rows = o.select(F.col("o_orderkey"), name.alias("id"), F.when(F.col("o_orderstatus") == "F", "UNDONE").otherwise("APPLIED").alias("status"), F.when(F.col("o_orderstatus") == "O", "PASSED").alias("test_status"), files.alias("files"))
    return history.report(rows, "o_orderkey").select(F.col("o_orderkey").alias("id"), "line")


@query("""WITH b AS (SELECT user_id, list_sort(list_distinct(list(event_type || event_id % 7) FILTER (event_id % 2 = 0))) AS before, list_sort(list_distinct(list(event_type || event_id % 7) FILTER (event_id % 2 = 1))) AS after FROM events GROUP BY user_id),
    c AS (SELECT user_id, coalesce(before, []) AS before, coalesce(after, []) AS after FROM b),
    s AS (SELECT user_id, [x FOR x IN after IF NOT list_contains(before, x)] AS fresh, [x FOR x IN after IF list_contains(before, x)] AS existing, [x FOR x IN before IF NOT list_contains(after, x)] AS fixed FROM c)
    SELECT user_id, concat_ws(chr(10), 'Status: checked', """ + ", ".join(f"CASE WHEN len({c}) > 0 THEN '{n} failures: ' || len({c}) || ' (' || array_to_string({c}[1:10], ', ') || CASE WHEN len({c}) > 10 THEN ' … and ' || (len({c}) - 10) || ' more' ELSE '' END || ')' END" for n, c in (("new", "fresh"), ("existing", "existing"), ("fixed", "fixed"))) + """) AS report FROM s""")
def q_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A validation as text: status, then how many failures are new, existing and fixed, and the first ten of each."""
    failed = F.concat("event_type", (F.col("event_id") % 7).cast("string"))
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.collect_set(F.when(F.col("event_id") % 2 == i, failed)).alias(c) for i, c in enumerate(("before", "after"))])
    return history.validation_report(runs.withColumn("status", F.lit("checked")), "user_id")
