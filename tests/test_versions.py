import pytest
from pyspark.sql import functions as F

from strandwork.plans.versions import Versions

FILES = "path string, content string"


class Tree:
    """Files that a test changes, and what was analysed."""

    def __init__(self, spark, files):
        self.spark, self.files, self.seen, self.on_part = spark, dict(files), [], None

    def read(self):
        return self.spark.createDataFrame(list(self.files.items()), FILES)

    def analyse(self, rows):
        got = [tuple(r) for r in rows.select("path", "content", "hash").collect()]
        if self.on_part:
            self.on_part(len(self.seen))
        self.seen += [p for p, _, _ in got]
        return self.spark.createDataFrame([(p, h, c.upper()) for p, c, h in got], "path string, hash string, body string")


def content(v):
    return {r.path: r.body for r in v.rows().collect()}


@pytest.fixture
def tree(spark):
    return Tree(spark, {f"f{i}": f"text {i}" for i in range(20)})


def test_versions_hold_what_the_files_are(spark, tree, tmp_path):
    v = Versions(spark, str(tmp_path / "index"), 3)
    assert v.newest() == 0 and v.update(tree.read, tree.analyse) == 1 and sorted(tree.seen) == sorted(tree.files)
    assert v.update(tree.read, tree.analyse) == 1 and not (tmp_path / "index/pending/2").exists()
    tree.files |= {"f1": "other", "new": "n"}
    del tree.files["f2"]
    assert {(r.path, r.reason) for r in v.state(tree.read).collect()} == {("f1", "source_changed"), ("new", "new_file")}
    tree.seen.clear()
    assert v.update(tree.read, tree.analyse) == 2 and sorted(tree.seen) == ["f1", "new"]
    assert content(v) == {p: c.upper() for p, c in tree.files.items()}
    assert {r.path: r.body for r in v.rows(1).collect()}["f2"] == "TEXT 2"
    del tree.files["f3"]
    assert v.update(tree.read, tree.analyse) == 3 and "f3" not in content(v) and len(tree.seen) == 2


@pytest.mark.parametrize("stop", ["analysis", "publish"])
def test_a_killed_run_repeats_nothing_and_loses_nothing(spark, tree, tmp_path, monkeypatch, stop):
    v = Versions(spark, str(tmp_path / "index"), 4)

    def die(*_):
        raise KeyboardInterrupt

    def third(done):
        if len(done_parts) == 2:
            die()
        done_parts.append(done)

    done_parts: list = []
    if stop == "analysis":
        tree.on_part = third
    else:
        monkeypatch.setattr(v, "_publish", die)
    with pytest.raises(KeyboardInterrupt):
        v.update(tree.read, tree.analyse)
    assert v.newest() == 0 and content(v) == {}
    first = list(tree.seen)
    assert len(first) == (20 if stop == "publish" else len(first)) and first
    monkeypatch.undo()
    tree.on_part = None
    again = Versions(spark, str(tmp_path / "index"), 4)
    assert again.update(tree.read, tree.analyse) == 1
    assert sorted(tree.seen) == sorted(tree.files) and content(again) == {p: c.upper() for p, c in tree.files.items()}


def test_files_that_change_meanwhile_wait_for_the_next_version(spark, tree, tmp_path):
    v = Versions(spark, str(tmp_path / "index"), 1)
    tree.on_part = lambda _: tree.files.update({"f5": "changed meanwhile"}) or tree.files.pop("f6", None)
    assert v.update(tree.read, tree.analyse) == 1
    assert "f5" not in content(v) and "f6" not in content(v) and len(content(v)) == 18
    assert [(r.path, r.reason) for r in v.state(tree.read).collect()] == [("f5", "new_file")]
    tree.on_part = None
    assert v.update(tree.read, tree.analyse) == 2 and content(v)["f5"] == "CHANGED MEANWHILE"


def test_a_part_hashes_its_own_files_only_and_a_plan_knows_its_parts(spark, tree, tmp_path):
    v, plans = Versions(spark, str(tmp_path / "index"), 4), []

    def analyse(rows):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        if len(plans) == 2:
            raise KeyboardInterrupt
        return tree.analyse(rows)

    with pytest.raises(KeyboardInterrupt):
        v.update(tree.read, analyse)
    assert all("pmod(xxhash64" in p for p in plans)  # every part's join shuffled all files once
    assert Versions(spark, v.target, 7).update(tree.read, tree.analyse) == 1  # goes on with the plan's four parts
    assert content(v) == {p: c.upper() for p, c in tree.files.items()} and sorted(tree.seen) == sorted(tree.files)
