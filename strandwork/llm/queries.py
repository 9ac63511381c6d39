"""The queries and SQL of this subpackage, as __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.llm.decontaminate import judge_contamination
from strandwork.llm.lang_id import identify
from strandwork.llm.line_dedup import dedup_lines
from strandwork.llm.lm_score import lm_scores
from strandwork.llm.mixing import mix_plan
from strandwork.llm.near_dedup import near_duplicates
from strandwork.llm.pii import find_personal_data
from strandwork.llm.quality_model import quality_scores
from strandwork.llm.quality_rules import judge_quality
from strandwork.llm.ranked_search import ranked_search
from strandwork.llm.repeat_index import remove_repeats
from strandwork.llm.spelling import spelling_variants
from strandwork.llm.url_filter import Rule, judge_urls

URL_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_items", F.col("item").alias("item_id"), "coverage", "contaminated")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select(F.col("id").alias("doc_id"), "source", "n_tokens", "epoch", "block", "position")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return ranked_search(docs.select("doc_id", "text"), items.select("item_id", "text"))


def op13_repeat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_lm_score": op2_lm_score,
    "op3_personal_data": op3_personal_data,
    "op4_url_filter": op4_url_filter,
    "op5_language_id": op5_language_id,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_near_dedup": op7_near_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_source_mixing": op9_source_mixing,
    "op10_quality_rules": op10_quality_rules,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_ranked_search": op12_ranked_search,
    "op13_repeat_index": op13_repeat_index,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, source, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
            FROM (SELECT doc_id, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
        keyed AS (SELECT doc_id, source, pos, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM lines),
        common AS (
            SELECT line, min(doc_id * 1000000000 + pos) AS first FROM keyed WHERE line <> ''
            GROUP BY line HAVING count(DISTINCT source) >= 10),
        gone AS (SELECT k.doc_id, k.pos FROM keyed k JOIN common c USING (line) WHERE k.doc_id * 1000000000 + k.pos <> c.first),
        kept AS (
            SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS text,
                count(*) AS n_lines, count(g.pos) AS n_removed
            FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
        SELECT d.doc_id, CASE WHEN k.n_removed > 0 THEN coalesce(k.text, '') ELSE d.text END AS text,
            CASE WHEN d.text <> '' THEN k.n_lines ELSE 0 END AS n_lines, coalesce(k.n_removed, 0) AS n_removed
        FROM documents d LEFT JOIN kept k USING (doc_id)
    """,
    "op7_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
            FROM words),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        pairs AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_n
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
            SELECT x, y FROM pairs JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id
            WHERE 100 * both_n >= 75 * (p.n + q.n - both_n)),
        reach AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT l.y, r.low FROM reach r JOIN links l ON l.x = r.node),
        least AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.low AS component_id, d.doc_id = l.low AS kept
        FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN least l ON d.doc_id = l.node
    """,
    "op4_url_filter": """
        WITH cut AS (
            SELECT page_id, CASE WHEN contains(url, '://')
                THEN regexp_replace(substr(url, strpos(url, '://') + 3), '[?#][\\s\\S]*$', '') ELSE '' END AS rest
            FROM pages),
        parts AS (
            SELECT page_id,
                translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '/[\\s\\S]*$') AS path
            FROM cut),
        rules(verdict, r_host, r_path) AS (VALUES
            ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
            ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        fits AS (
            SELECT p.page_id, p.host, p.path, r.r_host || r.r_path AS rule, r.verdict,
                row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.r_host || r.r_path) DESC) AS nth
            FROM parts p LEFT JOIN rules r
                ON (p.host = r.r_host OR ends_with(p.host, '.' || r.r_host)) AND starts_with(p.path, r.r_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE nth = 1
    """,
    "op11_spelling_variants": r"""
        WITH RECURSIVE crc AS MATERIALIZED (
            SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
            FROM range(256) AS t(i)),
        runs AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
            FROM documents),
        counted AS (SELECT run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
        bytes AS (
            SELECT run, n, list_transform(range(1, length(h), 2), lambda i: (strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1) AS b FROM counted),
        summed AS (
            SELECT run, n, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, crc.steps[xor(c & 255, x) + 1]), 4294967295)) AS h FROM bytes, crc),
        torn AS (
            SELECT n, CASE WHEN h % 97 = 0 THEN run[:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word FROM summed),
        words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM torn WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        spots AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
        cut AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM spots),
        pairs AS (
            SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
            UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
        best AS (
            SELECT word, count(*) AS n_near, min({'less': -n, 'near': near}) AS top FROM pairs GROUP BY word),
        named AS MATERIALIZED (
            SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.top.less >= 2 * w.n THEN b.top.near END AS form,
                CASE WHEN -b.top.less >= 2 * w.n THEN -b.top.less END AS form_n
            FROM words w LEFT JOIN best b USING (word)),
        walk AS (
            SELECT word, word AS at, form AS next FROM named
            UNION ALL SELECT k.word, k.next, v.form FROM walk k JOIN named v ON v.word = k.next)
        SELECT n.word, n.form, k.at AS root, n.n, n.n_near, n.form_n FROM named n JOIN walk k ON k.word = n.word AND k.next IS NULL
    """,
    "op12_ranked_search": r"""
        WITH doc_terms AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents),
        tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
        size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
        total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM size),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        asked AS (
            SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark),
        query AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
        weighed AS (
            SELECT q.item_id, q.term, q.times * floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df.df + 1)::DOUBLE))::BIGINT AS w
            FROM query q JOIN df USING (term), total),
        sized AS (SELECT doc_id, 25 + (75 * n * n_docs) // n_terms AS m FROM size, total),
        scored AS (
            SELECT w.item_id, t.doc_id, sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * s.m)))::BIGINT AS score
            FROM weighed w JOIN tf t USING (term) JOIN sized s ON s.doc_id = t.doc_id GROUP BY w.item_id, t.doc_id)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 10
    """,
    "op13_repeat_index": r"""
        WITH hexed AS MATERIALIZED (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
        pieces AS MATERIALIZED (SELECT doc_id, n_bytes, j * 256 AS lo, h[512 * j + 1:512 * j + 910] AS h FROM (SELECT *, unnest(range(0, n_bytes // 256 + 1)) AS j FROM hexed)),
        starts AS (SELECT doc_id, h, lo, unnest(range(0, least(256, n_bytes - 199 - lo))) AS i FROM pieces),
        windows AS MATERIALIZED (SELECT doc_id, lo + i AS i, hash(h[2 * i + 1:2 * i + 400]) AS k FROM starts),
        again AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
        marked AS (SELECT doc_id, i, i - lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) > 200 AS opens FROM windows SEMI JOIN again USING (k)),
        numbered AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
        runs AS (SELECT doc_id, run, min(i) AS lo, max(i) + 200 AS hi FROM numbered GROUP BY doc_id, run),
        between AS (SELECT doc_id, run, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS prior FROM runs),
        cut AS (
            SELECT doc_id, count(*) AS n_spans, sum(hi - lo)::BIGINT AS n_removed, max(hi) AS last,
                string_agg(h[2 * prior + 1:2 * lo], '' ORDER BY run) AS head
            FROM between JOIN hexed USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
            sha256(unhex(coalesce(head, '') || h[2 * coalesce(last, 0) + 1:])) AS kept_sha256
        FROM hexed LEFT JOIN cut USING (doc_id)
    """,
}
