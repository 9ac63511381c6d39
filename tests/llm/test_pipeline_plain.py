"""Every stage of the pipeline against a plain version, each on what the plain stages before it leave."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.docs import DOCS
from tests.llm.test_decontaminate import tiles
from tests.llm.test_lines_and_mixing import plain_exponent
from tests.llm.test_near_dedup import plain as plain_groups

BLANK = " \t\n\v\f\r"
ITEMS = [(i, " ".join(f"item{i}w{j}" for j in range(30 + 5 * i))) for i in range(4)]


def documents():
    rng = random.Random(4)
    words = [f"{rng.choice('abcdefgh')}word{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(140):
        lines = [prose(rng.randrange(20, 40)) for _ in range(rng.randrange(1, 4))]
        if i % 7 in (0, 3):
            lines.insert(rng.randrange(len(lines) + 1), "Shared licence line of all sites")
        if i % 8 == 0:
            lines.append("line of few sites ")
        rows.append([i, "\n".join(lines), "de" if i % 4 else "en", f"s{i % 12}" if i % 5 else "hot"])
    for k, i in enumerate((3, 17, 17, 40, 41)):  # near copies
        copy = rows[i][1].split(" ")
        copy[len(copy) // 2] = f"edit{k}"
        rows.append([200 + k, " ".join(copy), "en", f"s{k}"])
    rows += [[300, rows[20][1], "en", "s1"], [301, rows[20][1].upper(), "en", "s2"]]
    for k, (_, item) in enumerate(ITEMS):
        own = item.split()
        rows.append([400 + k, " ".join([prose(15), *own[len(own) // 3 :], prose(9), *own[: len(own) // 3]]), "en", "s3"])
        rows.append([410 + k, " ".join([prose(25), *own[: len(own) // 4], prose(9)]), "en", "s4"])
    rows += [[500, "12 34 !!", "en", "s5"], [501, None, "en", "s5"], [502, "", "de", "s5"], [503, "Shared licence line of all sites", "en", "s6"], [504, " \nShared licence line of all sites\n", None, None]]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def plain_language(rows):
    return [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]


def plain_lines(rows):
    sites, first = {}, {}
    for i, text, _, source, *_ in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if key := line.strip(BLANK):
                sites.setdefault(key, set()).add(source or "")
                first[key] = min(first.get(key, (i, pos)), (i, pos))
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        gone = [len(sites.get(x.strip(BLANK), ())) >= 10 and first[x.strip(BLANK)] != (r[0], pos) for pos, x in enumerate(lines)]
        text = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g) if any(gone) else r[1]
        if not any(gone) or text.strip(BLANK):
            out.append((r[0], text, *r[2:4], len(text) if any(gone) else r[4]))
    return out


def plain_near(rows):
    groups = plain_groups([(r[0], r[1]) for r in rows])
    return [r for r in rows if groups[r[0]][1] == r[0]]


def plain_clean(rows):
    def leaks(text):
        words = (text or "").lower().split()
        for _, item in ITEMS:
            own = item.split()
            if set(words) & set(own) and (tiles(words, own, 5) >= len(own) / 2 or tiles(words, own, 10) >= 50):
                return True
        return False

    return [r for r in rows if not leaks(r[1])]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(documents(), DOCS).write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_stages_are_their_plain_versions(spark, folder):
    rows = documents()
    plain = {"language_id": plain_language, "line_dedup": plain_lines, "near_dedup": plain_near, "decontaminate": plain_clean}
    lost = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, spark.createDataFrame(rows, DOCS), folder).collect()
        want = plain[name](rows)
        assert sorted((r.doc_id, r.text, r.source or "", r.n_chars) for r in got) == sorted((i, t, s or "", n) for i, t, _, s, n in want), name
        assert {r.lang for r in got} <= {"en", "de"}
        lost[name] = {r[0] for r in rows} - {r[0] for r in want}
        lang = {r.doc_id: r.lang for r in got}
        rows = [(i, t, lang[i], s, n) for i, t, _, s, n in want]
    assert lost["language_id"] == {500, 501, 502} and lost["line_dedup"] == {503, 504}
    assert {201, 202, 204, 300, 301} <= lost["near_dedup"] and lost["decontaminate"] == {400, 401, 402, 403}
    # mixing: every document in the first pass, passes up to the quota that the plain exponent gives
    got = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(rows, DOCS), folder).collect()
    assert sorted(r.doc_id for r in got if r.epoch == 0) == sorted(r[0] for r in rows)
    tokens: dict = {}
    for r in rows:
        tokens[r[3] or ""] = tokens.get(r[3] or "", 0) + len(r[1].split())
    a, top = plain_exponent(list(tokens.values()), 0.95, 4.0, gap=0.5), max(tokens.values())
    for source, n in tokens.items():
        spent = sum(len(r.text.split()) for r in got if (r.source or "") == source)
        quota = n * min(4.0, (n / top) ** (a - 1))
        assert quota - max(len(r[1].split()) for r in rows) - 1 <= spent <= quota + 1e-6
    assert a < 1 and len(got) > len(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()) == sorted(r.doc_id for r in got)


def test_documents_are_kept_whole(spark, folder):
    """What no stage has a reason to touch comes out as it went in."""
    out = corpus_pipeline.run(spark, folder).where(F.col("epoch") == 0).select("doc_id", "text").collect()
    given = {r[0]: r[1] for r in documents()}
    assert sum(given[r.doc_id] == r.text for r in out) > 80
