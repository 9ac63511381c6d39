import corpus_pipeline
from strandwork.llm import queries
from tests.llm.docs import DOCS, ROWS


def test_stages_one_by_one_and_together(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        n = out.select("doc_id").distinct().count()
        assert 0 < n <= before, name
        if name != "mix":
            assert out.columns == corpus_pipeline.COLUMNS and out.count() == n
        docs, before = out, n
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in whole.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_stages_on_awkward_documents(spark, sf):
    docs = spark.createDataFrame(ROWS, DOCS)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = sorted((r.doc_id or 0) for r in stage(spark, docs, sf).collect())
    assert kept["near_dedup"] == [0, 1, 4, 5, 6, 7, 9, 11, 12, 13]
    assert kept["line_dedup"] == kept["decontaminate"] == sorted(r[0] or 0 for r in ROWS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_lines_of_ten_sites_go_however_many_sites_there_are(spark, sf):
    n = corpus_pipeline.LINE_SITES
    rows = [(i, f"own text {i}\nshared line\n" + ("nine sites" if i % n else "tenth"), "en", f"s{i % n}", 0) for i in range(3 * n)]
    for more in ([], [(100 + i, f"other {i}", "en", f"t{i}", 0) for i in range(40)]):
        got = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows + more, DOCS), sf).collect()}
        assert len(got) == 3 * n + len(more) and [i for i, lines in got.items() if "shared line" in lines] == [0]
        assert sum("nine sites" in lines for lines in got.values()) == 3 * n - 3


def test_every_operator_has_its_query():
    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names == {f"op{i}" for i in range(1, 14)}


def test_texts_that_share_an_id_all_stay_and_equal_rows_once(spark, sf):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, b, "de", "s", 1), (5, None, "en", "s", None), (8, a, "en", "s", 1), (9, c, "en", None, 1), (9, c, "en", None, 1), (None, c, "en", "s", 1)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), sf).collect()
    assert sorted(map(str, got)) == sorted(map(str, [spark.createDataFrame([r], DOCS).first() for r in (rows[0], rows[2], rows[3], rows[5], rows[7])]))


def test_a_run_leaves_only_what_its_result_reads(spark, sf):
    from strandwork.llm.support import written_so_far

    before = written_so_far(spark)
    out = corpus_pipeline.run(spark, sf)
    read = {f.rsplit("/", 2)[-2] for f in out.inputFiles()}
    assert out.count() and written_so_far(spark) - before <= 8 and len(read) >= 2
