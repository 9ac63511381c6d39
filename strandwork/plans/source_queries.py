"""Queries over source files: syntax trees, spans, closures, retrieval, plans, incremental updates."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.functions import paths, text
from strandwork.operators import balanced, diffs, evidence, extract, json_objects, python_source, script_source, semantic, verdict
from strandwork.operators.settle import shared_folder
from strandwork.plans import retrieval
from strandwork.plans.join_queries import PATH, part_edges
from strandwork.plans.registry import query, spread_sql
from strandwork.plans.versions import Versions
from strandwork.sources.tables import document_path, spread, table

SOURCES = [
    ("t{n}/shop/__init__.py", ""),
    ("t{n}/shop/models.py", "from dataclasses import dataclass\n\n\n@dataclass\nclass Invoice:\n    number: int\n\n    def total(self):\n        return self._sum(self.lines)\n\n    def _sum(self, rows):\n        return sum(rows)\n"),
    ("t{n}/shop/store.py", "import sqlite3\nfrom .models import Invoice\n\n\ndef save_invoice(invoice):\n    \"\"\"Keep it.\"\"\"\n    db = open_table('invoice table')\n    db.write(f'saved {invoice} rows')\n    return Invoice(1)\n\n\ndef open_table(name):\n    return sqlite3.connect(name)\n"),
    ("t{n}/shop/api.py", "from t{n}.shop.store import save_invoice\nimport cli\n\n\n@cli.command(name='post-invoice')\ndef post(request):\n    return save_invoice(request.body)\n\n\nclass Handler:\n    def get(self):\n        return self.reply()\n\n    def reply(self):\n        return post(self)\n"),
    ("t{n}/web/cart.tsx", "import { api } from './api'\nexport const Cart = ({ items }) => {\n  const label = \"open } cart\"\n  return <ul>{items.map(i => <li>{i}</li>)}</ul>\n}\n\nexport class Box {\n  open() { return `a ${1 + 1} }` }\n}\nconst plain = 3\n"),
    ("t{n}/web/api.ts", "// a { brace\nexport function api(path: string) {\n  return fetch(path) /* } */\n}\n"),
    ("t{n}/tests/test_store.py", "from t{n}.shop.store import save_invoice\n\n\ndef test_save():\n    assert save_invoice(1)\n"),
    ("t{n}/broken.py", "def broken(:\n"),
    ("t{n}/node_modules/x/index.js", "export function hidden() {}\n"),
]
WORK = [(1, "Save the invoice in the database table and show it on the cart page"), (2, "Fix t{n}/shop/api.py: the handler should reply"), (3, "nothing matches here")]


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, "path string, content string", SOURCES)


def indexed(spark: SparkSession, sf_dir: str) -> retrieval.Index:
    return retrieval.build_index(sources(spark, sf_dir)).cached()


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, "task_id int, text string", WORK)


@query(f"""SELECT * FROM {spread_sql([('t{n}/shop/api.py', 'post', 'post', 'function', None), ('t{n}/shop/api.py', 'post-invoice', 'post-invoice', 'command', 'post'), ('t{n}/shop/api.py', 'Handler', 'Handler', 'class', None),
    ('t{n}/shop/api.py', 'get', 'Handler.get', 'method', None), ('t{n}/shop/api.py', 'reply', 'Handler.reply', 'method', None), ('t{n}/shop/models.py', 'Invoice', 'Invoice', 'class', None), ('t{n}/shop/models.py', 'total', 'Invoice.total', 'method', None),
    ('t{n}/shop/models.py', '_sum', 'Invoice._sum', 'method', None), ('t{n}/shop/store.py', 'save_invoice', 'save_invoice', 'function', None), ('t{n}/shop/store.py', 'open_table', 'open_table', 'function', None), ('t{n}/tests/test_store.py', 'test_save', 'test_save', 'function', None)], "path, name, qualified_name, kind, definition_name")} t""")
def q_py_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of Python sources, commands under their own name."""
    return python_source.symbols(sources(spark, sf_dir).where("path LIKE '%.py'")).drop("pos")


@query(f"""SELECT * FROM {spread_sql([('t{n}/shop/models.py', 'dataclasses'), ('t{n}/shop/models.py', 'dataclasses.dataclass'), ('t{n}/shop/store.py', 'sqlite3'), ('t{n}/shop/store.py', '.models'), ('t{n}/shop/store.py', '.models.Invoice'), ('t{n}/shop/api.py', 't{n}.shop.store'),
    ('t{n}/shop/api.py', 't{n}.shop.store.save_invoice'), ('t{n}/shop/api.py', 'cli'), ('t{n}/tests/test_store.py', 't{n}.shop.store'), ('t{n}/tests/test_store.py', 't{n}.shop.store.save_invoice')], "path, imported")} t""")
def q_py_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: imported names of Python sources."""
    return python_source.imports(sources(spark, sf_dir).where("path LIKE '%.py'")).drop("pos")


@query(f"""SELECT * FROM {spread_sql([('t{n}/shop/models.py', 'Invoice', None, 'class', 4, 12), ('t{n}/shop/models.py', 'Invoice.total', 'Invoice', 'method', 8, 9), ('t{n}/shop/models.py', 'Invoice._sum', 'Invoice', 'method', 11, 12),
    ('t{n}/shop/store.py', 'save_invoice', None, 'function', 5, 9), ('t{n}/shop/store.py', 'open_table', None, 'function', 12, 13), ('t{n}/shop/api.py', 'post', None, 'function', 5, 7), ('t{n}/shop/api.py', 'Handler', None, 'class', 10, 15),
    ('t{n}/shop/api.py', 'Handler.get', 'Handler', 'method', 11, 12), ('t{n}/shop/api.py', 'Handler.reply', 'Handler', 'method', 14, 15), ('t{n}/tests/test_store.py', 'test_save', None, 'function', 4, 5)], "path, qualified_name, owner, kind, start_line, end_line")} t""")
def q_py_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions with their lines, decorators included."""
    return python_source.definitions(sources(spark, sf_dir).where("path LIKE '%.py'")).select("path", "qualified_name", "owner", "kind", "start_line", "end_line")


@query(f"""SELECT * FROM {spread_sql([('t{n}/shop/models.py', 'Invoice.total', 0, '_sum', 'self'), ('t{n}/shop/models.py', 'Invoice._sum', 0, 'sum', 'bare'), ('t{n}/shop/store.py', 'save_invoice', 0, 'open_table', 'bare'), ('t{n}/shop/store.py', 'save_invoice', 1, 'write', 'qualified'),
    ('t{n}/shop/store.py', 'save_invoice', 2, 'Invoice', 'bare'), ('t{n}/shop/store.py', 'open_table', 0, 'connect', 'qualified'), ('t{n}/shop/api.py', 'post', 0, 'command', 'qualified'), ('t{n}/shop/api.py', 'post', 1, 'save_invoice', 'bare'), ('t{n}/shop/api.py', 'Handler.get', 0, 'reply', 'self'),
    ('t{n}/shop/api.py', 'Handler.reply', 0, 'post', 'bare'), ('t{n}/tests/test_store.py', 'test_save', 0, 'save_invoice', 'bare')], "path, definition, pos, callee, receiver")} t""")
def q_py_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges in source order with the kind of their receiver."""
    return python_source.calls(sources(spark, sf_dir).where("path LIKE '%.py'")).drop("owner")


@query(f"""SELECT * FROM {spread_sql([('save_invoice', 'invoice', 1), ('save_invoice', 'table', 1), ('save_invoice', 'saved', 2), ('save_invoice', 'rows', 2), ('post', 'post', 1), ('post', 'invoice', 1)], "definition, word, weight")} t""")
def q_py_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of string literals by definition, the docstring aside."""
    return python_source.literal_terms(sources(spark, sf_dir).where("path LIKE '%.py'")).drop("path")


@query("SELECT 't' || s_suppkey || '/broken.py' AS path, TRUE AS failed FROM supplier")
def q_py_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that don't parse."""
    return python_source.errors(sources(spark, sf_dir).where("path LIKE '%.py'")).select("path", F.col("error").contains("SyntaxError").alias("failed"))


@query(f"""SELECT * FROM {spread_sql([('t{n}/web/cart.tsx', 'Cart', 'function', 2, 5), ('t{n}/web/cart.tsx', 'Box', 'class', 7, 9), ('t{n}/web/api.ts', 'api', 'function', 2, 4)], "path, name, kind, start_line, end_line")} t""")
def q_script_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of script declarations, braces in strings and comments aside."""
    return script_source.definitions(sources(spark, sf_dir).where("path LIKE '%/web/%'")).select("path", "name", "kind", "start_line", "end_line")


LOCATORS = [("t{n}/shop/api.py", "Handler.get", 0), ("t{n}/shop/api.py", "post", 1), ("t{n}/shop/api.py", "none", 2), ("t{n}/shop/models.py", "total", 3)]


@query(f"SELECT * FROM {spread_sql([('t{n}/shop/api.py', 'Handler.get', 11, 12), ('t{n}/shop/api.py', 'post', 5, 7), ('t{n}/shop/models.py', 'total', 8, 9)], "path, locator, start_line, end_line")} t")
def q_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locators to the one definition each names."""
    found = python_source.definitions(sources(spark, sf_dir).where("path LIKE '%.py'"))
    return python_source.locate(found, spread(spark, sf_dir, "path string, locator string, pos int", LOCATORS)).select("path", "locator", "start_line", "end_line")


@query(f"SELECT * FROM {spread_sql([('t{n}/shop/store.py', 'open_table'), ('t{n}/shop/store.py', 'close_table')], 'path, name')} t")
def q_changed_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions whose text differs between two states."""
    old = sources(spark, sf_dir).where("path LIKE '%/shop/store.py'")
    edited = F.concat(F.replace("content", F.lit("return sqlite3.connect(name)"), F.lit("return sqlite3.connect(name, 1)")), F.lit("\n\ndef close_table():\n    pass\n"))
    return python_source.changed_definitions(python_source.definitions(old), python_source.definitions(old.withColumn("content", edited)))


@query(f"""SELECT * FROM {spread_sql([('t{n}/shop/api.py', 't{n}/shop/store.py'), ('t{n}/shop/store.py', 't{n}/shop/models.py'), ('t{n}/tests/test_store.py', 't{n}/shop/store.py'), ('t{n}/web/cart.tsx', 't{n}/web/api.ts')], "src, dst")} t""")
def q_dependency_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved dependencies of a whole source tree."""
    return indexed(spark, sf_dir).deps.select("src", "dst")


@query(f"""SELECT * FROM {spread_sql([('t{n}/shop/models.py', 'Invoice.total', 't{n}/shop/models.py', 'Invoice._sum'), ('t{n}/shop/store.py', 'save_invoice', 't{n}/shop/store.py', 'open_table'), ('t{n}/shop/store.py', 'save_invoice', 't{n}/shop/models.py', 'Invoice'),
    ('t{n}/shop/api.py', 'post', 't{n}/shop/store.py', 'save_invoice'), ('t{n}/shop/api.py', 'Handler.get', 't{n}/shop/api.py', 'Handler.reply'), ('t{n}/shop/api.py', 'Handler.reply', 't{n}/shop/api.py', 'post'), ('t{n}/tests/test_store.py', 'test_save', 't{n}/shop/store.py', 'save_invoice')], "src_path, src, dst_path, dst")} t""")
def q_resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls to the definitions they reach."""
    return retrieval.resolved_calls(indexed(spark, sf_dir)).select("src_path", "src", "dst_path", "dst")


def _closure_level(d: int) -> str:
    """One level of the closure in SQL, over k (roots and discovered) and x (discovered) of the levels before."""
    known = " UNION ALL ".join(f"SELECT task_id, path, name FROM f{i}" for i in range(d))
    found = " UNION ALL ".join(f"SELECT task_id, path, name FROM f{i}" for i in range(1, d)) or "SELECT task_id, path, name FROM f0 WHERE false"
    return f"""k{d} AS ({known}), x{d} AS ({found}),
        c{d} AS (SELECT f.task_id, e.dst_path AS path, e.dst AS name, min({{'a': f.rank, 'b': e.pos}}) AS met FROM f{d - 1} f JOIN calls e ON f.path = e.src_path AND f.name = e.src
            WHERE NOT EXISTS (SELECT 1 FROM k{d} k WHERE k.task_id = f.task_id AND k.path = e.dst_path AND k.name = e.dst) GROUP BY ALL),
        h{d} AS (SELECT task_id, count(*) AS n, count(DISTINCT path) AS m FROM x{d} GROUP BY task_id),
        g{d} AS (SELECT c.*, coalesce(h.n, 0) AS n, coalesce(h.m, 0) AS m, NOT EXISTS (SELECT 1 FROM x{d} x WHERE x.task_id = c.task_id AND x.path = c.path) AS fresh,
            min({{'met': c.met, 'path': c.path, 'name': c.name}}) OVER (PARTITION BY c.task_id, c.path) AS opens FROM c{d} c LEFT JOIN h{d} h ON h.task_id = c.task_id),
        i{d} AS (SELECT *, dense_rank() OVER (PARTITION BY task_id, fresh ORDER BY opens) AS nth FROM g{d}),
        j{d} AS (SELECT task_id, path, name, n + row_number() OVER (PARTITION BY task_id ORDER BY met, path, name) AS rank FROM i{d} WHERE NOT fresh OR nth <= 12 - m),
        f{d} AS (SELECT task_id, path, name, {d} AS depth, rank FROM j{d} WHERE rank <= 24)"""


@query(f"""WITH own AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
    calls AS MATERIALIZED (SELECT DISTINCT 'f' || a.l_partkey % 29 AS src_path, a.l_partkey::VARCHAR AS src, b.l_partkey AS pos, 'f' || b.l_partkey % 29 AS dst_path, b.l_partkey::VARCHAR AS dst
        FROM own a JOIN own b USING (l_orderkey) WHERE a.l_partkey <> b.l_partkey),
    f0 AS (SELECT l_suppkey AS task_id, 'f' || min(l_partkey) % 29 AS path, min(l_partkey)::VARCHAR AS name, 0 AS depth, 1 AS rank FROM lineitem GROUP BY l_suppkey),
    {_closure_level(1)}, {_closure_level(2)}, {_closure_level(3)}
    FROM f1 UNION ALL FROM f2 UNION ALL FROM f3""")
def q_call_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2: what each supplier's first part reaches within three levels of parts bought together, by the caps of definitions and files."""
    file, name = lambda c: F.concat(F.lit("f"), (F.col(c) % 29).cast("string")), lambda c: F.col(c).cast("string")
    roots = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("task_id")).agg(F.min("l_partkey").alias("part"))

    def calls(of: DataFrame) -> DataFrame:  # pairs of parts are several times as many as lines, so a level makes those of its own parts
        edges = part_edges(spark, sf_dir, of.select(F.col("name").cast("long").alias("src")))
        return edges.select(file("src").alias("src_path"), name("src").alias("src"), "pos", file("dst").alias("dst_path"), name("dst").alias("dst"))

    return evidence.rooted_closure(roots.select("task_id", file("part").alias("path"), name("part").alias("name"), F.lit(1).alias("rank")), calls)


@query()
def q_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files for every task by the whole retrieval pipeline."""
    return retrieval.retrieve(indexed(spark, sf_dir), tasks(spark, sf_dir))


@query()
def q_coverage_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions planned for every task under the caps of a coverage plan."""
    index = indexed(spark, sf_dir)
    return evidence.plan(retrieval.candidates(index, tasks(spark, sf_dir), retrieval.retrieve(index, tasks(spark, sf_dir))))


@query()
def q_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each task within its budget."""
    index = indexed(spark, sf_dir)
    planned = evidence.plan(retrieval.candidates(index, tasks(spark, sf_dir), retrieval.retrieve(index, tasks(spark, sf_dir))))
    return retrieval.materialise(index, planned)


@query(f"""WITH now AS (SELECT {PATH} AS path, sha256(text) AS hash FROM documents WHERE lang <> 'de'),
    old AS (SELECT CASE WHEN source = 'src7' THEN 'was/' ELSE '' END || {PATH} AS path, sha256(text) AS hash FROM documents WHERE lang <> 'es')
    SELECT n.path, CASE WHEN o.hash IS NOT NULL THEN 'kept' ELSE 'analysed' END AS state,
        CASE WHEN p.path IS NULL THEN (SELECT max(g.path) FROM old g WHERE g.hash = n.hash AND g.path NOT IN (SELECT path FROM now)) END AS renamed_from
    FROM now n LEFT JOIN old o ON n.path = o.path AND n.hash = o.hash LEFT JOIN old p ON n.path = p.path""")
def q_update_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index brought up to date: kept, analysed and renamed rows."""
    docs = table(spark, sf_dir, "documents")
    was = F.concat(F.when(F.col("source") == "src7", "was/").otherwise(""), document_path())
    old = docs.where("lang <> 'es'").select(was.alias("path"), F.sha2("text", 256).alias("hash"), F.lit("kept").alias("state"))
    files = docs.where("lang <> 'de'").select(document_path().alias("path"), F.col("text").alias("content"))
    return retrieval.update_index(old, files, lambda df: df.select("path", "hash", F.lit("analysed").alias("state"))).select("path", "state", "renamed_from")


@query(f"""WITH now AS (SELECT {PATH} AS path, text, sha256(text) AS hash FROM documents WHERE lang <> 'de' AND text IS NOT NULL),
    old AS (SELECT {PATH} AS path, sha256(CASE WHEN source = 'src7' THEN text || '!' ELSE text END) AS hash FROM documents WHERE lang <> 'es' AND text IS NOT NULL)
    SELECT n.path, CASE WHEN o.path IS NULL THEN 2 ELSE 1 END AS version, length(n.text) AS size FROM now n LEFT JOIN old o ON n.path = o.path AND n.hash = o.hash""")
def q_index_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index published in two versions: rows of the second come from the version that analysed their file."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(document_path().alias("path"), "text", "lang", "source")
    old = docs.where("lang <> 'es'").select("path", F.concat("text", F.when(F.col("source") == "src7", "!").otherwise("")).alias("content"))
    now = docs.where("lang <> 'de'").select("path", F.col("text").alias("content"))
    index = Versions(spark, f"{shared_folder(spark)}/strandwork-index-{uuid.uuid4().hex}", 4)
    for state in (old, now):
        index.update(lambda state=state: state, lambda rows: rows.select("path", "hash", F.length("content").alias("size")))
    return index.rows().select("path", "version", "size")


class StubClient:
    """Answers from the path: well formed, fenced, wrong once, wrong always, or late."""

    model, version = "stub", 1

    def __init__(self) -> None:
        self.asked: dict[str, int] = {}

    def ask(self, prompt: str) -> str:
        path = json.loads(prompt.split("\n")[1])["path"]
        self.asked[path] = self.asked.get(path, 0) + 1
        answer = json.dumps({"summary": f"About {path}", "tags": "one", "important_symbols": ["keep", "unknown"]})
        if path.startswith("late"):
            raise TimeoutError
        return {"fenced": f"```json\n{answer}\n```", "twice": answer if self.asked[path] > 1 else "no", "never": "no", "blank": " ", "list": "[]"}.get(path.split("-")[0], answer)


@query(f"""SELECT * FROM {spread_sql([('plain-{n}', 'complete', None, 'About plain-{n}', 'one', 'keep', 1), ('fenced-{n}', 'complete', None, 'About fenced-{n}', 'one', 'keep', 1), ('twice-{n}', 'complete', None, 'About twice-{n}', 'one', 'keep', 2),
    ('never-{n}', 'failed', 'invalid_json', None, '', '', 2), ('blank-{n}', 'failed', 'empty_response', None, '', '', 2), ('list-{n}', 'failed', 'invalid_json', None, '', '', 2), ('late-{n}', 'failed', 'timeout', None, '', '', 1)], "path, status, reason, summary, tags, symbols, attempts")} t""")
def q_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files described by an injected client, answers validated."""
    files = spread(spark, sf_dir, "path string, names array<string>, text string", [(p + "-{n}", ["keep", "other"], "body") for p in ("plain", "fenced", "twice", "never", "blank", "list", "late")])
    out = semantic.analyse(files, StubClient)
    return out.select("path", "status", "reason", "summary", F.array_join("tags", ",").alias("tags"), F.array_join("important_symbols", ",").alias("symbols"), "attempts")


ANSWERS = [(1, '{"a": 1}'), (2, '```json\n{"b": "}"}\n```'), (3, 'so: {"c": {"d": 2}} done'), (4, '{"a": 1} {"b": 2}'), (5, "none"), (6, None), (7, '{"open": 1')]


@query(f"""SELECT * FROM {spread_sql([(1, '{"a": 1}'), (2, '{"b": "}"}'), (3, '{"c": {"d": 2}}'), (4, None), (5, None), (6, None), (7, None)], "id, body")} t""")
def q_json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one JSON object in a text."""
    return spread(spark, sf_dir, "id int, answer string", ANSWERS).select("id", json_objects.load_object(F.col("answer")).alias("body"))


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'so: ' ELSE '}"{" ' END AS lead, props AS a, CASE WHEN event_id % 2 = 0 THEN ' "\\"{" ' || props ELSE ' {open' END AS b FROM events WHERE props IS NOT NULL)
    SELECT event_id, (length(lead) + 1)::BIGINT AS start, (length(lead) + length(a))::BIGINT AS "end" FROM t
    UNION ALL SELECT event_id, length(lead) + length(a) + 8, length(lead) + length(a) + length(b) FROM t WHERE event_id % 2 = 0""")
def q_json_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outermost objects in texts around the events' properties: braces in strings, unmatched and unclosed ones among them."""
    n = F.col("event_id")
    lead, props = F.when(n % 3 == 0, "so: ").otherwise('}"{" '), F.col("props")
    rows = table(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", F.concat(lead, props, F.when(n % 2 == 0, F.concat(F.lit(' "\\"{" '), props)).otherwise(" {open")).alias("body"))
    return balanced.spans(rows, "body", "event_id", op=balanced.JSON)


@query("""SELECT page_id, count(*) AS tags, sum(length(tag))::BIGINT AS size FROM (SELECT page_id, unnest(regexp_extract_all(html, '<[^<>]*>')) AS tag FROM pages) GROUP BY page_id""")
def q_markup_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tags each page has and their size, by balanced angle brackets."""
    found = balanced.spans(table(spark, sf_dir, "pages"), "html", "page_id", op=balanced.Lexer("", False, "<", ">"))
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("tags"), F.sum(F.col("end") - F.col("start") + 1).alias("size"))


CURRENT = "one\ntwo\nthree\nfour\nfive\nsix\nseven\neight\nnine\n"
DRIFTED = [
    (1, "--- a/f\n+++ b/f\n@@ -2 +2 @@\n-two\n+2\n"), (2, "--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n six\n-seven\n+7\n"), (3, "--- a/f\n+++ b/f\n@@ -1 +1 @@\n-absent\n+x\n"),
]
REPAIRED = [
    (1, "--- a/f\n+++ b/f\n@@ -1,5 +1,5 @@\n one\n-two\n+2\n three\n four\n five\n"), (2, "--- a/f\n+++ b/f\n@@ -4,6 +4,6 @@\n four\n five\n six\n-seven\n+7\n eight\n nine\n"), (3, "--- a/f\n+++ b/f\n@@ -1,1 +1,1 @@\n-absent\n+x\n"),
]


@query(f"SELECT * FROM {spread_sql(REPAIRED, 'id, patch')} t")
def q_hunk_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thin and drifted hunks with the current source's lines around them."""
    return spread(spark, sf_dir, "id int, body string", DRIFTED).select("id", diffs.repair(F.col("body"), F.create_map(F.lit("f"), F.lit(CURRENT))).alias("patch"))


@query("""WITH e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey <> b.l_partkey),
    roots AS (SELECT l_suppkey AS task_id, min(l_partkey) AS node FROM lineitem GROUP BY l_suppkey), h1 AS (SELECT DISTINCT task_id, dst AS node FROM roots JOIN e ON node = src), h2 AS (SELECT DISTINCT task_id, dst AS node FROM h1 JOIN e ON node = src),
    s AS (SELECT task_id, node, sum(p)::BIGINT AS score FROM (SELECT task_id, node, 150 AS p FROM h1 UNION ALL SELECT task_id, node, 120 FROM h2) x WHERE NOT EXISTS (SELECT 1 FROM roots r WHERE r.task_id = x.task_id AND r.node = x.node) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, node) AS rank FROM s)
    SELECT task_id, node, score, rank FROM r WHERE rank <= 8""")
def q_scored_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3 to H6: two hops from each supplier's first part, nearer ones weighing more."""
    roots = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("task_id")).agg(F.min("l_partkey").alias("node"))
    return evidence.scored_hops(roots, part_edges(spark, sf_dir), [150, 120])


OUTPUTS = [(1, "a\nb\n"), (2, ""), (3, "  "), (4, "x" * 30)]


@query(f"""SELECT id, CASE WHEN trim(body) = '' THEN '    (no output)' ELSE '    ' || replace(rtrim(body, ' ' || chr(10)), chr(10), chr(10) || '    ') END AS shown FROM {spread_sql(OUTPUTS, 'id, body')} t""")
def q_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output of a run, indented."""
    return spread(spark, sf_dir, "id int, body string", OUTPUTS).select("id", text.indented(F.regexp_replace("body", r"[ \n]+$", "")).alias("shown"))


LISTS = [(1, ["  A  b ", "a B", "c", "", "d" * 200, "e"]), (2, [])]


@query(f"SELECT * FROM {spread_sql([(1, 'A b|c|' + 'd' * 120), (2, '')], "id, kept")} t")
def q_bounded_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings collapsed, clipped and distinct, at most three."""
    return spread(spark, sf_dir, "id int, v array<string>", LISTS).select("id", F.array_join(text.bounded_strings(F.col("v"), 3), "|").alias("kept"))


@query(f"""SELECT doc_id, regexp_replace({PATH}, '^.*/', '') || '-' || left(sha256(lower({PATH})), 8) AS key FROM documents""")
def q_repository_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key from a name and the hash of a path."""
    p = document_path()
    return table(spark, sf_dir, "documents").select("doc_id", paths.repository_key(paths.file_name(p), p).alias("key"))


STATUS = " M src/a{n}.py\x00?? .env\x00 M keys/x.pem\x00R  old.py -> new.py\x00R  .env.a -> b.py\x00"


@query(f"""SELECT * FROM {spread_sql([('src/a{n}.py', False), ('.env', True), ('keys/x.pem', True), ('old.py -> new.py', False), ('.env.a -> b.py', True)], "path, hidden")} t""")
def q_status_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUL-separated status rows, hidden if either side of a move is."""
    rows = spread(spark, sf_dir, "out string", [(STATUS,)]).select(F.explode(F.split("out", "\x00")).alias("row")).where("row <> ''").select(F.substring("row", 4, 10_000).alias("path"))
    return rows.select("path", F.exists(F.split("path", " -> "), paths.is_ignored).alias("hidden"))


RANGES = [(1, "@@ -1,2 +3,4 @@\n x\n@@ -9 +20,0 @@\n@@ -5 +7 @@")]


@query(f"SELECT * FROM {spread_sql([(0, 3, 6), (1, 20, 20), (2, 7, 7)], "pos, start_line, end_line")} t")
def q_hunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New-side line ranges of hunk headers."""
    return extract.hunk_ranges(spread(spark, sf_dir, "id int, body string", RANGES), "body", "id").drop("id")


TRACE = [(1, 'Traceback:\n  File "a{n}.py", line 3, in f\n  File "b.py", line 9, in g\n  File "a{n}.py", line 7, in h\n')]


@query(f"SELECT * FROM {spread_sql([('a{n}.py', 3), ('b.py', 9)], "path, line_no")} t")
def q_traceback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a traceback with their first lines."""
    return extract.traceback_paths(spread(spark, sf_dir, "id int, body string", TRACE), "body", "id").drop("id")


@query("""WITH e AS (SELECT user_id, list_sort(list_distinct(coalesce(list(event_type) FILTER (event_type <> 'error'), []))) AS fresh, count(*) FILTER (event_type = 'error') % 4 AS n FROM events GROUP BY user_id),
    s AS (SELECT *, CASE n WHEN 0 THEN 'passed' WHEN 1 THEN 'regressions' WHEN 2 THEN 'targeted_failed' ELSE 'repair_failed' END AS status FROM e)
    SELECT user_id, status, array_to_string(list_sort(CASE n WHEN 0 THEN [] WHEN 1 THEN fresh ELSE list_distinct(list_concat(['click', 'own'], fresh)) END), ',') AS targets FROM s""")
def q_repair_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a repair is about: new failures after regressions, the targeted ones too where those failed, nothing after a pass."""
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_type") != "error", F.col("event_type"))).alias("n"), (F.count_if(F.col("event_type") == "error") % 4).alias("e"))
    by = by.withColumn("status", F.when(F.col("e") == 0, "passed").when(F.col("e") == 1, "regressions").when(F.col("e") == 2, "targeted_failed").otherwise("repair_failed"))
    targets = verdict.repair_targets(F.col("status"), F.col("n"), F.array(F.lit("click"), F.lit("own")), F.col("n"))
    return by.select("user_id", "status", F.array_join(F.array_sort(targets), ",").alias("targets"))


SURFACES = [(1, 0, "show the invoice table"), (1, 1, "save rows")]


@query()
def q_surface_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that answer each clause of a task, the best four."""
    s = spread(spark, sf_dir, "task_id int, pos int, text string", SURFACES)
    found = text.surface_tokens(F.col("text"))
    s = s.select("task_id", "pos", found.alias("tokens"), text.surface_roles(found).alias("roles"), F.lit(False).alias("single"), F.lit(True).alias("complex"))
    index = indexed(spark, sf_dir)
    terms = python_source.literal_terms(index.files).groupBy("path", F.col("definition").alias("qualified_name")).agg(F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias("literals"))
    own = text.tokens(F.col("name"))
    symbols = index.definitions.join(terms, ["path", "qualified_name"], "left").select(
        "path", F.col("qualified_name").alias("name"), own.alias("tokens"), text.tokens(F.col("path")).alias("file_tokens"), F.array().cast("array<string>").alias("semantic_tokens"),
        F.coalesce("literals", F.create_map().cast("map<string,int>")).alias("literals"), text.surface_roles(own).alias("roles"), evidence.path_roles(F.col("path")).alias("file_roles"), F.lit(False).alias("important"), F.lit(False).alias("presents"),
    )
    return evidence.surface_roots(s, symbols, 4)
