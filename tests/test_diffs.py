import pytest
from hypothesis import given
from hypothesis import strategies as st

from strandwork.operators import diffs as d

HEAD = "--- a/f\n+++ b/f\n"


def test_counts_are_recomputed_and_prefixes_set():
    text, wrong = d.canonicalize("--- f\n+++ f\n@@ -1,9 +1,9 @@ def g\n one\n-two\n+2\n")
    assert text == HEAD + "@@ -1,2 +1,2 @@ def g\n one\n-two\n+2\n" and len(wrong) == 1


def test_deleted_lines_that_look_like_headers_stay_lines():
    (f,) = d.parse(HEAD + "@@ -1,3 +1,2 @@\n keep\n--- gone\n-x\n+y\n")
    assert f.hunks[0].side("-") == ["-- gone", "x"]


def test_two_files_in_one_text():
    files = d.parse(HEAD + "@@ -1 +1 @@\n-a\n+b\n--- a/g\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\n\\ No newline at end of file\n")
    assert [f.new_path for f in files] == ["b/f", "/dev/null"] and files[1].hunks[0].body[-1][0] == "\\"
    assert "+++ /dev/null" in d.serialize(files)


def test_renames_copies_and_modes():
    text = "diff --git a/x b/y\nsimilarity index 100%\nrename from x\nrename to y\n"
    (f,) = d.parse(text)
    assert (f.old_path, f.new_path) == ("a/x", "b/y") and d.serialize([f]) == text
    assert d.parse('diff --git "a/a b" "b/a b"\nold mode 100644\nnew mode 100755\n')[0].old_path == "a/a b"
    for bad in ("rename from x\n", "rename from x\ncopy to y\n", "rename from x\nrename to y\ncopy from x\ncopy to y\n"):
        with pytest.raises(d.DiffError):
            d.parse("diff --git a/x b/y\n" + bad)


@pytest.mark.parametrize(("text", "line"), [
    ("", 1), ("hello\n", 1), (HEAD, 2), (HEAD + "@@ -1 +1 @@\n same\n", 3), (HEAD + "@@ wrong @@\n-a\n", 3), (HEAD + "@@ -1 +1 @@\n-a\n*b\n", 5), ("--- a/f\n-x\n", 1), ("--- \n+++ b/f\n@@ -1 +1 @@\n-a\n", 1),
    (HEAD + "@@ -1 +1 @@\n-a\n--- a/g\n+++ b/g\n-x\n", 5),
])
def test_errors_name_their_line(text, line):
    with pytest.raises(d.DiffError) as e:
        d.parse(text)
    assert e.value.line_no == line


LINES = st.lists(st.tuples(st.sampled_from(" -+"), st.text(alphabet="ab -+@", max_size=6)), min_size=1, max_size=8)


@given(st.lists(LINES.filter(lambda b: any(k in "-+" for k, _ in b)), min_size=1, max_size=3))
def test_canonical_text_is_stable(bodies):
    hunks = [d.Hunk(i * 20 + 1, 0, i * 20 + 1, 0, "", tuple((k, "x" + t) for k, t in b)) for i, b in enumerate(bodies)]
    text = d.serialize([d.FilePatch("a/f", "b/f", [], hunks)])
    again, wrong = d.canonicalize(text)
    assert again == text and not wrong


SOURCE = [f"line {i}" for i in range(1, 13)]


def hunk(start, *body):
    return d.Hunk(start, 0, start, 0, "", tuple((b[0], b[1:]) for b in body))


def test_drifted_hunks_move_to_their_only_place():
    got = d.reanchored(SOURCE, hunk(2, " line 7", "-line 8", "+eight"))
    assert got.old_start == 5 and got.actual == (7, 7) and got.side("-") == ["line 8"]
    assert d.reanchored(SOURCE, hunk(2, "-line 8", "+eight")).old_start == 5


def test_unclear_hunks_are_refused():
    assert d.reanchored(["a", "b", "a", "b"], hunk(9, "-a", "+x")) is None
    assert d.reanchored(SOURCE, hunk(1, "-absent", "+x")) is None


def test_blank_lines_may_differ():
    source = ["start", "one", "", "two", "end", "x", "y", "z"]
    got = d.reanchored(source, hunk(1, " one", "-two", "+2"))
    assert got.side("-") == ["two"] and got.side(" +").index("2") > got.side(" +").index("one")
    gap = d.reanchored(["a", "", "", "b"], hunk(1, " a", "+new", " b"))
    assert gap.side(" -") == ["a", "", "", "b"] and "new" in gap.side("+")


def test_order_is_kept():
    text = HEAD + "@@ -1 +1 @@\n-line 9\n+9\n@@ -5 +5 @@\n-line 2\n+2\n"
    assert d.parse(d.repaired(text, {"f": "\n".join(SOURCE)})) == d.parse(text)


def test_blank_gap():
    assert d.blank_gap(["a", "", "b"], "a", "b") == (1, 2)
    assert d.blank_gap(["a", "", "b", "a", "b"], "a", "b") is None
    assert d.blank_gap(["a", "c"], "a", "b") is None
