import difflib

import numpy as np
import pytest

from strandwork.operators import locate, patching

TEXTS = "path string, text string"


def patch_of(path, old, new, context=3):
    return "\n".join(difflib.unified_diff(old.split("\n"), new.split("\n"), f"a/{path}", f"b/{path}", n=context, lineterm=""))


def run(spark, texts, patches):
    """(texts after, edits, conflicts) of one patch of several files."""
    files = spark.createDataFrame(texts, TEXTS)
    lines = patching.hunk_lines(spark.createDataFrame([(1, p) for p in patches], "id int, patch string").selectExpr("monotonically_increasing_id() AS n", "patch"), "patch", "n")
    found = patching.positioned(lines, files, "n")
    bad = patching.conflicts(found, files, "n")
    return {r.path: r.text for r in patching.applied(found, files, bad).collect()}, found, [(r.path, r.hunk_no, r.what) for r in bad.collect()]


@pytest.mark.parametrize("context", [0, 3])
def test_patches_forward_and_backward_give_every_text(spark, context):
    rng = np.random.default_rng(context)
    texts, after, patches = [], {}, []
    for f in range(12):
        old = [f"line {f}.{i} {rng.integers(0, 9)}" if rng.random() > 0.2 else "" for i in range(int(rng.integers(3, 60)))]
        new = []
        for x in old:
            new += [x] if rng.random() > 0.1 else []
            new += [f"new {rng.integers(0, 10**6)}"] if rng.random() < 0.12 else []
        new = new or ["left"]
        texts.append((f"f{f}.txt", "\n".join(old).rstrip("\n") + "\n"))
        after[f"f{f}.txt"] = "\n".join(new).rstrip("\n") + "\n"
        diff = patch_of(f"f{f}.txt", texts[-1][1][:-1], after[f"f{f}.txt"][:-1], context)
        patches += [diff] if diff else []
    got, found, bad = run(spark, texts, patches)
    assert bad == [] and got == after
    files = spark.createDataFrame(list(got.items()), TEXTS)
    back = patching.reverse(found)
    assert {r.path: r.text for r in patching.applied(back, files, patching.conflicts(back, files, "n")).collect()} == dict(texts)


BLANK = ("app.py", "alpha = 1\nbeta = 2\n}\n\nfunction target() {\n  return 1;\n}\nomega = 9\n")
DRIFT = "--- a/app.py\n+++ b/app.py\n@@ -1,9 +1,10 @@\n alpha = 1\n beta = 2\n }\n \n \n+inserted = True\n function target() {\n   return 1;\n }\n omega = 9\n"


def test_blank_lines_that_drifted_are_ignored_if_one_place_is_left(spark):
    got, _, bad = run(spark, [BLANK], [DRIFT])
    assert bad == [] and got["app.py"] == BLANK[1].replace("\nfunction", "\ninserted = True\nfunction")
    twice = BLANK[1] + "separator\n" + BLANK[1]
    got, found, bad = run(spark, [("app.py", twice)], [DRIFT])
    assert got["app.py"] == twice and {b[2] for b in bad} == {"unplaced"} and {r.how for r in found.collect()} == {"ambiguous"}


def test_conflicts_keep_a_file_as_it_is(spark):
    texts = [("a", "one\ntwo\nthree\nfour\n"), ("b", "x\ny\n"), ("c", "k\n"), ("d", "v = 1\nm\nv = 1\n"), ("e", "p\nq\n")]
    patches = [
        "--- a/a\n+++ b/a\n@@ -1,2 +1,1 @@\n one\n-two\n@@ -2,2 +2,2 @@\n two\n-three\n+3\n", "--- a/b\n+++ b/b\n@@ -1 +1 @@\n-z\n+w\n",
        "--- a/none\n+++ b/none\n@@ -1,0 +1 @@\n+n\n", "--- a/d\n+++ b/d\n@@ -2 +2 @@\n-v = 1\n+v = 2\n", "--- a/e\n+++ b/e\n@@ -9,2 +9,2 @@\n p\n-q\n+Q\n",
    ]
    got, found, bad = run(spark, texts, patches)
    assert got == dict(texts) | {"e": "p\nQ\n"}
    assert {(p, w) for p, _, w in bad} == {("a", "overlaps"), ("b", "unplaced"), ("none", "missing"), ("d", "unplaced")}
    how = {(r.path, r.how) for r in found.collect()}
    assert {("e", "exact"), ("b", "missing"), ("d", "ambiguous"), ("a", "declared"), ("none", "declared")} <= how


def test_whether_a_patch_is_there_already(spark):
    old, new = "a b\nc\nd\n", "a b\nC\nd\n"
    texts = [("yes", old), ("no", old), ("wide", old)]
    _, found, _ = run(spark, texts, [patch_of(p, old[:-1], new[:-1]) for p, _ in texts])
    now = spark.createDataFrame([("yes", new), ("no", old), ("wide", "a   b\nC \nd\n")], TEXTS)
    found = found.withColumn("file", found.path)
    got = {r.file: r.applied for r in patching.already_applied(found, now, "n", "file").collect()}
    assert got == {"yes": "exactly", "no": None, "wide": "blank"}


@pytest.mark.parametrize("blank", [False, True])
def test_sequences_are_found_at_every_place(spark, blank):
    rng = np.random.default_rng(3)
    texts = [(f"t{i}", "\n".join(rng.choice(["a", "b", "", "c"], int(rng.integers(1, 40)), p=[0.4, 0.3, 0.2, 0.1]))) for i in range(12)] + [("null", None), ("empty", "")]
    needles = [(i, f"t{int(rng.integers(0, 12))}", [str(x) for x in rng.choice(["a", "b", ""], int(rng.integers(1, 7)), p=[0.5, 0.4, 0.1])]) for i in range(60)] + [(99, "t1", []), (98, None, ["a"])]
    for anywhere in (False, True):
        got = locate.occurrences(spark.createDataFrame(needles, "id int, path string, lines array<string>"), spark.createDataFrame(texts, TEXTS), anywhere=anywhere, ignore_blank=blank)
        want = set()
        for i, of, lines in needles:
            lines = [x for x in lines if x or not blank]
            for path, text in texts:
                rows = (text or "").removesuffix("\n").split("\n") if text else []
                rows = [(k + 1, x) for k, x in enumerate(rows) if x or not blank]
                if lines and (anywhere or path == of):
                    want |= {(i, path, rows[k][0], rows[k + len(lines) - 1][0]) for k in range(len(rows) - len(lines) + 1) if [x for _, x in rows[k : k + len(lines)]] == lines}
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_a_text_is_looked_through_where_it_lies(spark):
    texts = spark.createDataFrame([("a", "x\nx\n\nx\ny\n"), ("b", "x\nx"), ("c", None)], "path string, text string")
    needles = spark.createDataFrame([(1, "a", ["x", "x"]), (2, "a", ["x"]), (3, "b", ["x", "y"]), (4, "c", ["x"]), (5, "a", []), (6, "a", ["x", "y"]), (7, "b", ["x", "x", "x"]), (8, None, ["x"])], "id int, path string, lines array<string>")
    found = locate.occurrences(needles, texts)
    assert sorted(map(tuple, found.collect())) == [(1, "a", 1, 2), (2, "a", 1, 1), (2, "a", 2, 2), (2, "a", 4, 4), (6, "a", 4, 5)]
    loose = locate.occurrences(needles, texts, ignore_blank=True)
    assert sorted(map(tuple, loose.where("id IN (1, 6)").collect())) == [(1, "a", 1, 2), (1, "a", 2, 4), (6, "a", 4, 5)]
    assert "xxhash64" not in found._jdf.queryExecution().optimizedPlan().toString()  # windows of all texts were hashed and shuffled twice


def test_a_text_is_patched_where_it_lies(spark):
    texts = spark.createDataFrame([("a", "1\n2\n3\n4\n"), ("b", "1\n2"), ("c", None), ("d", ""), ("e", "x\ny\n"), ("f", "x\n"), (None, "n")], TEXTS)
    rows = [("a", 1, 1, "+", "0", 1), ("a", 1, 2, "-", "1", 1), ("a", 2, 1, "+", "u", 3), ("a", 2, 2, "+", "v", 3), ("a", 3, 1, "-", "4", 4), ("a", 3, 2, "+", "end", 5), ("a", 4, 1, "-", "4", 4)]
    rows += [("b", 1, 1, "-", "1", 1), ("b", 1, 2, "-", "2", 2), ("d", 1, 1, "+", "new", 1), ("e", 1, 1, " ", "x", 1), ("f", 1, 1, "+", "lost", None)]
    found = spark.createDataFrame(rows, "path string, hunk_no long, pos int, kind string, line string, old_no long")
    done = patching.applied(found, texts)
    assert {r.path: (r.text, r.changed) for r in done.collect()} == {"a": ("0\n2\nu\nv\n3\nend\n", True), "b": ("", True), "c": (None, False), "d": ("new\n", True), "e": ("x\ny\n", True), "f": ("x\n", False), None: ("n", False)}
    bad = patching.conflicts(found.withColumn("new_no", found.old_no), texts)
    assert sorted((r.path, r.hunk_no, r.what) for r in bad.collect()) == [("a", 3, "overlaps"), ("a", 4, "overlaps"), ("f", 1, "unplaced")]
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan and plan.count("Join") == 1  # lines of all texts were shuffled, texts read three times
