"""Queries over scores, ranks, ranges, budgets and traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork import config
from strandwork.functions import text
from strandwork.operators import extract, graph, nesting, ranking
from strandwork.plans.join_queries import _EDGES, PATH, part_edges
from strandwork.plans.registry import query, spread_sql, values
from strandwork.plans.text_queries import _LINES, _WORDS, _tokens_sql
from strandwork.sources.tables import capitalised, documents_as_files, spread, table

_FILES = f"""files AS (SELECT {PATH} AS path, lower({PATH}) AS lpath, list_transform(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+')), lambda x: lower(x)) AS symbols, lower(lang) AS tag FROM documents)"""


def task_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, path, score) of all benchmark tasks over all documents."""
    tasks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id"), text.task_words(F.col("text"), synonyms={}).alias("words"))
    none = F.array().cast("array<string>")
    files = documents_as_files(spark, sf_dir).select("path", capitalised(F.col("text")).alias("symbols"), F.array("lang").alias("imports"), none.alias("tags"), none.alias("important"), F.lit("").alias("summary"), F.lit(False).alias("complete"))
    return ranking.word_scores(tasks, files)


@query(f"""WITH {_FILES}, tasks AS (SELECT item_id AS task_id, unnest({_WORDS}) AS word FROM benchmark), words AS (SELECT DISTINCT word FROM tasks),
    sym AS (SELECT path, unnest(symbols) AS symbol FROM files), names AS (SELECT DISTINCT symbol FROM sym),
    hit AS (SELECT word, symbol FROM words JOIN names ON contains(symbol, word)),
    pts AS (SELECT w.word, f.path, 6 AS p FROM words w JOIN files f ON contains(f.lpath, w.word)
        UNION ALL SELECT h.word, s.path, 5 * count(*) FROM hit h JOIN sym s USING (symbol) GROUP BY ALL
        UNION ALL SELECT w.word, f.path, 3 FROM words w JOIN files f ON contains(f.tag, w.word)),
    scored AS (SELECT t.task_id, p.path, sum(p.p)::BIGINT AS score FROM tasks t JOIN pts p USING (word) GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, lower(path), path) AS rank FROM scored WHERE score > 0)
    SELECT task_id, path, score, rank FROM ranked WHERE rank <= 8""")
def q_task_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1, E1, F1, flagship: the eight best files for every task."""
    return ranking.top_k(task_scores(spark, sf_dir), config.SEEDS, ["task_id"], [F.desc("score"), F.lower("path"), F.col("path")]).withColumn("score", F.col("score").cast("long"))


@query("""WITH r AS (SELECT l_suppkey, l_partkey, sum(l_quantity)::BIGINT AS score FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, l_partkey) AS rank FROM r)
    SELECT l_suppkey, l_partkey, score, rank FROM k WHERE rank <= 4""")
def q_topk_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the four best of every group."""
    r = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("score"))
    return ranking.top_k(r, 4, ["l_suppkey"], [F.desc("score"), F.col("l_partkey")])


@query(f"""WITH {_LINES}, words AS (SELECT doc_id, line_no, unnest(regexp_extract_all(lower(line), '[a-z]+')) AS word FROM lines),
    n AS (SELECT doc_id, line_no, word, count(*) AS n FROM words WHERE length(word) >= 6 GROUP BY ALL), df AS (SELECT doc_id, word, count(*) AS df FROM n GROUP BY ALL),
    w AS (SELECT n.doc_id, n.line_no, sum(least(5000, greatest(1, (power(length(word), 3)::BIGINT * 100) // greatest(1, floor(sqrt(df.df))::BIGINT))) * greatest(1, n.n))::BIGINT AS weight FROM n JOIN df USING (doc_id, word) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, line_no) AS rank FROM w)
    SELECT doc_id, line_no, weight, greatest(1, line_no - 32) AS start_line, line_no + 32 AS end_line FROM r WHERE rank <= 64""")
def q_line_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 heaviest lines of every text, each with its surroundings."""
    numbered = extract.lines(table(spark, sf_dir, "documents"), "text", "doc_id")
    words = numbered.select("doc_id", "line_no", F.explode(F.regexp_extract_all(F.lower("line"), F.lit("[a-z]+"), F.lit(0))).alias("word")).where("length(word) >= 6")
    best = ranking.top_k(ranking.line_weights(words, "doc_id"), config.EXCERPT_LINES, ["doc_id"], [F.desc("weight"), F.col("line_no")])
    no = F.col("line_no").cast("long")
    return best.select("doc_id", no.alias("line_no"), "weight", F.greatest(F.lit(1), no - config.EXCERPT_RADIUS).alias("start_line"), (no + config.EXCERPT_RADIUS).alias("end_line"))


@query("""WITH s AS (SELECT user_id, epoch_us(ts) // 60000000 - 32 AS start_at, epoch_us(ts) // 60000000 + 32 AS end_at FROM events),
    f AS (SELECT *, CASE WHEN start_at > max(end_at) OVER (PARTITION BY user_id ORDER BY start_at, end_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS fresh FROM s),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY start_at, end_at ROWS UNBOUNDED PRECEDING) AS island FROM f)
    SELECT user_id, min(start_at) AS start_at, max(end_at) AS end_at FROM g GROUP BY user_id, island""")
def q_merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surroundings of events that touch, merged."""
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000)
    spans = table(spark, sf_dir, "events").select("user_id", (minute - 32).alias("start_at"), (minute + 32).alias("end_at"))
    return ranking.merge_ranges(spans, "start_at", "end_at", "user_id")


@query("""WITH u AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations)
    SELECT conv_id, turn, length(text) AS size, used::BIGINT AS used FROM u WHERE used <= 600""")
def q_prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turns in order up to the first that breaks the budget."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return ranking.prefix_budget(turns, "size", "turn", 600, "conv_id")


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, length(text)::BIGINT AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
    fold AS (SELECT conv_id, turn, size, n, size <= 600 AS taken, CASE WHEN size <= 600 THEN size ELSE 0 END AS used FROM t WHERE n = 1
        UNION ALL SELECT t.conv_id, t.turn, t.size, t.n, f.used + t.size <= 600, f.used + CASE WHEN f.used + t.size <= 600 THEN t.size ELSE 0 END FROM fold f JOIN t ON t.conv_id = f.conv_id AND t.n = f.n + 1)
    SELECT conv_id, turn, size, taken, used FROM fold""")
def q_fold_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turns that don't fit are skipped, later ones may fit."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return ranking.skip_budget(turns, "size", "turn", 600, "conv_id")


@query("""WITH r AS (SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
    SELECT event_type, event_id, n <= 5 AS kept FROM r""")
def q_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five of each status stay."""
    return ranking.retention(table(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], "event_type").select("event_type", "event_id", "kept")


@query("""WITH e AS (SELECT user_id, event_id, floor(value * 100)::BIGINT AS cents, count(*) OVER (PARTITION BY user_id) AS total FROM events),
    w AS (SELECT *, sum(cents) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM e)
    SELECT user_id, event_id, CASE WHEN n >= 2 THEN floor(s / n * (total - n))::BIGINT END AS eta_cents FROM w""")
def q_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: what remains by the mean so far, from the second item on."""
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") * 100).alias("cents"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("total"))
    return ranking.eta(e, "cents", "event_id", F.col("total"), "user_id").select("user_id", "event_id", F.floor("eta_seconds").alias("eta_cents"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events), five AS (SELECT user_id, event_type, count(*) AS c FROM n WHERE nth <= 5 GROUP BY ALL)
    SELECT user_id, max(c) >= 4 AS tripped FROM five GROUP BY user_id""")
def q_circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether four of the first five items failed for one reason."""
    return ranking.tripped(table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id")), "event_type", "at", "user_id")


_BFS_SEEDS = "seeds AS (SELECT o_custkey AS task_id, l_partkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY l_partkey) AS rank FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'))"


def _hop(level: int) -> str:
    before = f"f{level - 1}"
    seen = " UNION ALL ".join(f"SELECT task_id, node FROM f{i}" for i in range(level))
    return f"""s{level} AS (SELECT f.task_id, e.dst AS node, min({{'a': f.rank, 'b': e.n}}) AS x FROM {before} f JOIN cut e ON f.node = e.src
            WHERE (f.task_id, e.dst) NOT IN (SELECT (task_id, node) FROM ({seen})) GROUP BY ALL),
        f{level} AS (SELECT task_id, node, {level} AS depth, row_number() OVER (PARTITION BY task_id ORDER BY x.a, x.b, node) AS rank FROM s{level})"""


@query(f"""WITH {_EDGES}, cut AS (SELECT src, dst, n FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM edges) WHERE n <= 20), {_BFS_SEEDS},
    f0 AS (SELECT task_id, node, 0 AS depth, rank FROM seeds WHERE rank <= 8), {_hop(1).replace("(f.task_id, e.dst) NOT IN (SELECT (task_id, node) FROM (", "NOT EXISTS (SELECT 1 FROM (").replace(")) GROUP BY", ") q WHERE q.task_id = f.task_id AND q.node = e.dst) GROUP BY")},
    {_hop(2).replace("(f.task_id, e.dst) NOT IN (SELECT (task_id, node) FROM (", "NOT EXISTS (SELECT 1 FROM (").replace(")) GROUP BY", ") q WHERE q.task_id = f.task_id AND q.node = e.dst) GROUP BY")},
    r AS (SELECT task_id, node, depth, row_number() OVER (PARTITION BY task_id ORDER BY depth, rank, node) AS rank FROM (FROM f0 UNION ALL FROM f1 UNION ALL FROM f2))
    SELECT task_id, node, depth, rank FROM r WHERE rank <= 12""")
def q_bfs_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: two hops from each customer's first urgent parts over parts bought together, first discovery first."""
    from pyspark.sql.window import Window

    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    seeds = urgent.select(F.col("o_custkey").alias("task_id"), F.col("l_partkey").alias("node")).distinct()
    seeds = seeds.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy("node"))).where("rank <= 8")
    return graph.bounded_bfs(seeds, part_edges(spark, sf_dir))


@query(f"""WITH t AS (SELECT doc_id, source, {_tokens_sql("regexp_replace(replace(text, '_', ' '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')")} AS tokens, len(string_split(text, chr(10))) AS lines FROM documents),
    d AS (SELECT list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z]+')))) AS terms FROM benchmark)
    SELECT doc_id, 24 * least(5, len(list_intersect(tokens, terms))) + CASE WHEN source = 'src0' THEN 35 ELSE 0 END - CASE WHEN lines > 40 THEN 20 ELSE 0 END AS score FROM t, d""")
def q_evidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each text for the tasks' terms: capped body hits, a path bonus, a size penalty."""
    terms = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token")).distinct()
    docs = table(spark, sf_dir, "documents")
    hits = docs.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token")).join(terms, "token", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))
    scored = docs.select("doc_id", "source", F.size(F.split("text", "\n")).alias("lines")).join(hits, "doc_id", "left")
    points = 24 * F.least(F.lit(5), F.coalesce("hits", F.lit(0))) + F.when(F.col("source") == "src0", 35).otherwise(0) - F.when(F.col("lines") > 40, 20).otherwise(0)
    return scored.select("doc_id", points.cast("long").alias("score"))


_DOC_LINES = "SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH t AS ({_DOC_LINES}),
    d AS (SELECT *, max(CASE WHEN regexp_matches(line, '^[A-M]') THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS definition_line FROM t)
    SELECT doc_id, line_no, length(line) AS score, definition_line FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, line_no) = 1""")
def q_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each text's strongest line and the last line before it that opens a definition, as an as-of step."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc_id", (F.col("at") + 1).alias("line_no"), "line")
    best = ranking.top_k(lines.select("doc_id", "line_no", F.length("line").alias("score")), 1, ["doc_id"], [F.desc("score"), F.col("line_no")]).drop("rank")
    marks = lines.where(F.col("line").rlike("^[A-M]")).select("doc_id", "line_no", F.lit("definition").alias("definition"))
    found = nesting.last_before(best, marks, "doc_id", value="definition")
    return found.select("doc_id", "line_no", "score", F.col("definition_line"))
