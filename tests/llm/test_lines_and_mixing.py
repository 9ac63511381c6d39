import collections

import pytest
from pyspark.sql import functions as F

from strandwork.llm.line_dedup import dedup_lines
from strandwork.llm.mixing import mix_plan, mix_sources, source_weights
from tests.llm.docs import DOCS, ROWS, clashing


def test_lines_on_enough_sites_stay_where_they_stand_first(spark):
    rows = [(i, f"own {i}\n  shared line \nrare {i % 2}\n\nshared line", None, f"s{i % 12}" if i else None, None) for i in range(30)]
    df = clashing(spark.createDataFrame(rows + ROWS, DOCS))
    got = {(r.doc_id, r.n_lines): r for r in dedup_lines(df, min_sites=10).collect()}
    assert len(got) >= 30
    for i in range(30):
        r = got[i, 5]
        assert r.n_removed == (1 if i == 0 else 2)
        assert r.text == (f"own {i}\n  shared line \nrare {i % 2}\n" if i == 0 else f"own {i}\nrare {i % 2}\n")
    assert got[4, 0].text is None and got[5, 0].text == "" and got[6, 2].n_removed == 0


def test_threshold_is_exact_near_the_border(spark):
    rows = [(s * 100 + i, f"line {s}", None, f"site{i}", None) for s in range(7, 13) for i in range(s)]
    got = dedup_lines(spark.createDataFrame(rows, DOCS), min_sites=10).groupBy((F.col("doc_id") / 100).cast("int").alias("s")).agg(F.sum("n_removed").alias("n")).collect()
    assert {r.s: r.n for r in got} == {7: 0, 8: 0, 9: 0, 10: 9, 11: 10, 12: 11}


def test_line_dedup_of_an_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_rows_are_treated_alike(spark):
    rows = [(1, "x y", None, f"s{i}", None) for i in range(12)]
    assert {(r.text, r.n_removed) for r in dedup_lines(spark.createDataFrame(rows, DOCS)).collect()} == {("x y", 0)}


def sizes(spark, *tokens):
    return spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(tokens)], "source string, tokens long")


def test_weights_meet_the_entropy_or_the_limit(spark):
    import math

    rows = source_weights(sizes(spark, 1000, 100, 10), 0.9, 1000.0, entropy_gap=0.0).collect()
    w = [r.weight for r in rows]
    assert sum(w) == pytest.approx(1) and -sum(x * math.log(x) for x in w) == pytest.approx(0.9 * math.log(3), rel=1e-9)
    rows = {r.source: r for r in source_weights(sizes(spark, 1000, 100, 10), 1.0, 4.0).collect()}
    assert rows["s2"].repeats == pytest.approx(4.0) and rows["s0"].repeats == pytest.approx(1.0)
    assert rows["s2"].weight / rows["s0"].weight == pytest.approx(0.01 ** rows["s0"].exponent)


def test_weights_of_one_source_of_none_and_under_a_budget(spark):
    (one,) = source_weights(sizes(spark, 50)).collect()
    assert (one.weight, one.repeats, one.quota) == (1, 1, 50)
    assert source_weights(sizes(spark)).count() == 0 and source_weights(sizes(spark, 0)).count() == 0
    rows = source_weights(sizes(spark, 1000, 1000, 10), 0.5, 2.0, budget_tokens=1000).collect()
    assert sum(r.quota for r in rows) <= 1000 and all(r.repeats <= 2 + 1e-9 for r in rows)


def test_plan_spends_each_quota_in_whole_passes(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 5)), None, "big" if i < 400 else f"s{i % 3}", None) for i in range(520)]
    df = spark.createDataFrame(rows, DOCS)
    plan = mix_plan(df, max_repeats=3.0).collect()
    by = collections.Counter((r.source, r.id) for r in plan)
    tokens = {r[0]: 1 + r[0] % 5 for r in rows}
    assert {i for _, i in by} == set(tokens)
    for source in ("big", "s0", "s1", "s2"):
        own = {i: n for (s, i), n in by.items() if s == source}
        assert max(own.values()) - min(own.values()) <= 1 and max(own.values()) <= 3
        spent, whole = sum(tokens[i] * n for i, n in own.items()), sum(tokens[i] for i in own)
        (weight,) = [r for r in source_weights(spark.createDataFrame([(s, sum(tokens[i] for x, i in by if x == s)) for s in ("big", "s0", "s1", "s2")], "source string, tokens long"), max_repeats=3.0).collect() if r.source == source]
        assert weight.quota - 5 <= spent <= weight.quota and whole == weight.tokens
    assert all(0 <= r.position < 1 for r in plan)
    again = mix_plan(df.repartition(7), max_repeats=3.0).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, plan))


def test_awkward_documents_come_once_or_more(spark):
    df = clashing(spark.createDataFrame(ROWS, DOCS))
    out = mix_sources(df)
    counts = collections.Counter(r.doc_id for r in out.where("epoch = 0").collect())
    want = collections.Counter(r[0] for r in ROWS if r[1] and r[1].split())
    assert all(counts[i] == n for i, n in want.items())
    assert mix_sources(spark.createDataFrame([], DOCS)).count() == 0


def test_sources_without_words_come_once(spark):
    blank = [(i, [None, "", " \n"][i % 3], None, "blank", None) for i in range(9)]
    rows = [*blank, *((10 + i, "w w w", None, "big", None) for i in range(30))]
    plan = mix_plan(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.id, r.epoch, r.n_tokens) for r in plan if r.source == "blank") == [(i, 0, 0) for i in range(9)]
    assert {r.id for r in plan} == {r[0] for r in rows} and all(0 <= r.position < 1 for r in plan)
    assert mix_sources(spark.createDataFrame(blank, DOCS)).count() == 9


def plain_exponent(tokens, share, limit, budget=None, gap=0.0):
    """By halving, over plain lists."""
    import math

    top, k = max(tokens), len(tokens)

    def weights(a):
        w = [(t / top) ** a for t in tokens]
        return [x / sum(w) for x in w]

    entropy = lambda a: -sum(x * math.log(x) for x in weights(a))

    def spread(a):
        return entropy(a) >= max(share * math.log(k), entropy(1.0) + gap * (math.log(k) - entropy(1.0))) - 1e-12

    def within(a):
        w = weights(a)
        spend = budget if budget is not None else top / w[tokens.index(top)]
        return max(x * spend / t for x, t in zip(w, tokens)) <= limit * (1 + 1e-12)

    def change(holds, below):
        lo, hi = 0.0, 1.0
        if holds(1.0) == below:
            return 1.0
        if holds(0.0) != below:
            return 0.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if holds(mid) == below else (lo, mid)
        return lo

    return max(change(spread, True), change(within, False))


@pytest.mark.parametrize("gap", [0.0, 0.5])
@pytest.mark.parametrize(("share", "limit", "budget"), [(0.95, 4.0, None), (0.7, 50.0, None), (1.0, 2.0, None), (0.9, 3.0, 900), (0.9, 1.5, 2500), (0.9, 2.0, 10**6)])
def test_exponent_is_that_of_plain_halving(spark, share, limit, budget, gap):
    tokens = [1000, 400, 400, 37, 12, 3]
    rows = source_weights(sizes(spark, *tokens), share, limit, budget, gap).collect()
    want = plain_exponent(tokens, share, limit, budget, gap)
    assert all(r.exponent == pytest.approx(want, abs=1e-9) for r in rows)
    if budget == 10**6:  # more than all sources may repeat
        assert all(r.quota == r.tokens * 2 for r in rows)
    elif budget:  # the weights share it out, but for the fractions of tokens
        assert budget - len(tokens) <= sum(r.quota for r in rows) <= budget
        assert all(abs(r.quota - r.weight * budget) <= 1 for r in rows)


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_the_target_binds_on_the_tables(spark, name):
    from strandwork.llm.queries import op9_source_mixing
    from strandwork.llm.support import words_of

    docs = spark.read.parquet(f"/root/testdata/{name}/documents.parquet")
    tokens = docs.groupBy("source").agg(F.sum(F.size(words_of(F.coalesce("text", F.lit(""))))).alias("tokens"))
    rows = source_weights(tokens).collect()
    want = plain_exponent([r.tokens for r in rows], 0.95, 4.0, gap=0.5)
    assert all(r.exponent == pytest.approx(want, abs=1e-9) and r.exponent < 1 for r in rows) and max(r.repeats for r in rows) > 1
    plan = op9_source_mixing(spark, f"/root/testdata/{name}")
    assert plan.count() > docs.count() == plan.where("epoch = 0").count()


def test_positions_are_places_in_the_quota_and_sources_run_side_by_side(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 6)), None, "big" if i < 2600 else f"s{i % 3}", None) for i in range(2900)]
    plan = mix_plan(spark.createDataFrame(rows, DOCS), max_repeats=3.0).collect()
    quota = {}
    for source in {r.source for r in plan}:
        own = sorted((r for r in plan if r.source == source), key=lambda r: r.position)
        assert len({r.position for r in own}) == len(own)
        assert [r.epoch for r in own] == sorted(r.epoch for r in own)
        blocks = [(r.epoch, r.block) for r in own]
        assert len(set(blocks)) == 1 + sum(a != b for a, b in zip(blocks, blocks[1:]))  # a pass takes its blocks one after the other
        total = sum(r.n_tokens for r in own)
        spent = 0
        for r in own:
            # places count whole tokens; quotas leave less than a document unspent
            assert spent / (total + 6) <= r.position <= (spent + 1) / total
            spent += r.n_tokens
        quota[source] = total
        passes = {e: [r.id for r in own if r.epoch == e] for e in {r.epoch for r in own}}
        if len(passes.get(1, [])) > 20:
            assert passes[0][: len(passes[1])] != passes[1]  # each pass has its own order
    assert len({r.block for r in plan if r.source == "big"}) == 3
    for cut in (0.25, 0.5, 0.75):  # of every source the same share is through
        for source, total in quota.items():
            assert abs(sum(r.n_tokens for r in plan if r.source == source and r.position < cut) / total - cut) <= 12 / total


def test_repeated_ids_and_texts_have_one_place_each(spark):
    rows = [(1, "a b", None, "x", None)] * 3 + [(1, "c", None, "x", None), (None, "a b", None, "x", None), (None, None, None, "x", None), (2, "", None, "x", None)]
    plan = mix_plan(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.id or 0, r.n_tokens) for r in plan) == [(0, 0), (0, 2), (1, 1), (1, 6), (2, 0)] and len({r.position for r in plan}) == 5
