import json
import subprocess

import pytest
from pyspark.sql import functions as F

from strandwork.functions import paths
from strandwork.operators import history
from strandwork.sources import repository
from strandwork.sources.tables import inline
from strandwork.streaming import index_stream


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    for name, body in {"src/a.py": b"x = 1\n", "src/b.ts": b"\xff bad", "node_modules/c.js": b"1", ".env": b"S=1", "readme.md": b"r"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    return root


def test_scan_reads_text_and_hash_of_wanted_files(spark, repo):
    rows = {r.path: r for r in repository.scan(spark, str(repo)).collect()}
    assert set(rows) == {"src/a.py", "src/b.ts"}
    import hashlib

    assert rows["src/a.py"].content == "x = 1\n" and rows["src/b.ts"].hash == hashlib.sha256(b"\xff bad").hexdigest() and rows["src/b.ts"].size == 5


def test_scan_prunes_folders_and_takes_any_name(spark, tmp_path, monkeypatch):
    root = tmp_path / "a+b (c) [d]"
    names = ["__init__.py", "_own.py", "pages/[id]/x y.ts", "pages/{a}*.js", "ü/ß.py", ".eslintrc.js", "deep/node_modules/x/y.py", "lib.egg-info/z.py", "Build/NODE_MODULES/q.py"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"# {name}")
    entered = []
    pruned = paths.is_pruned_name
    listed = repository.list_files(spark, str(root), lambda name: pruned(name) or entered.append(name))
    assert sorted(entered) == sorted({"pages", "[id]", "ü", "deep", *({"Build"} - {x for x in ["Build"] if pruned(x)})}) and not any("node_modules" in p.lower() for p, _ in listed)
    rows = {r.path: r.content for r in repository.scan(spark, str(root) + "/").collect()}
    assert rows == {n: f"# {n}" for n in names[:6]}
    (tmp_path / "empty").mkdir()
    assert repository.scan(spark, str(tmp_path / "empty")).count() == 0


def test_changed_files_of_a_repository(spark, repo):
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "src/a.py")
    git("commit", "-qm", "one")
    (repo / "src/a.py").write_text("x = 2\n")
    run = repository.git(str(repo))
    assert sorted(r.path for r in repository.changed_files(spark, run).collect()) == ["readme.md", "src/a.py", "src/b.ts"]
    assert "+x = 2" in repository.diff_text(run, ["src/a.py"]) and repository.diff_text(run, []) == ""
    with pytest.raises(RuntimeError):
        run(["no-such-command"])


def test_map_round_trip(spark, tmp_path):
    text = json.dumps({"version": 3, "files": {"b": {"hash": "2", "tags": ["t"]}, "a": {"hash": "1"}}})
    repository.save_map(repository.load_map(spark, text), tmp_path / "map.json")
    saved = (tmp_path / "map.json").read_text()
    assert list(json.loads(saved)["files"]) == ["a", "b"] and list(tmp_path.iterdir()) == [tmp_path / "map.json"]
    assert repository.load_map(spark, saved).count() == 2


def test_a_failed_write_leaves_the_old_text(tmp_path):
    target = tmp_path / "x.txt"
    repository.write_text(target, "old")
    with pytest.raises(UnicodeEncodeError):
        repository.write_text(target, "\ud800")
    assert target.read_text() == "old" and len(list(tmp_path.iterdir())) == 1


def test_runs_are_consistent_with_entry_patch_and_snapshot(spark):
    run = inline(spark, "run_id string, entry_id string", [("r1", "e1"), ("r2", "e2"), ("r3", "e3"), ("r4", "e4"), ("r5", "e5")])
    entries = [("e1", "APPLIED", [("a",), ("b",)]), ("e2", "UNDONE", [("a",)]), ("e3", "APPLIED", [("a",), ("b",)]), ("e4", "APPLIED", [("gone",)])]
    entries = inline(spark, "id string, status string, files array<struct<path: string>>", entries)
    patch = inline(spark, "entry_id string, path string", [("e1", "b"), ("e1", "a"), ("e2", "a"), ("e3", "a"), ("e4", "gone"), ("e5", "a")])
    got = history.consistent(run, entries, patch, inline(spark, "path string", [("a",), ("b",)])).collect()
    assert [r.run_id for r in got] == ["r1"]


def test_settings():
    assert repository.setting("A", {"A": "1"}, "A=2") == "1" and repository.setting("A", {}, "# A=0\nA = '2'") == "2" and repository.setting("A", {}) is None
    assert [repository.index_mode(*x) for x in ((None, None, None), ("AI", "0", None), (None, "yes", None), (None, None, "m"))] == ["static", "ai", "ai", "ai"]
    assert repository.command_profile('[tests]\nfast = "a b"\nfull = ["c d"]', "fast") == ["a", "b"]
    assert repository.command_profile('[tests]\nfull = ["c d"]', "full") == ["c d"] and repository.command_profile("", "x") is None
    with pytest.raises(ValueError):
        repository.command_profile("[tests]\nfast = 3", "fast")


def test_index_stream_repeats_nothing(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "index", "checkpoint"))
    analyse = lambda df: df.select("path", "hash", F.length("content").alias("n"))
    for rows in ([("a", "one"), ("b", "two!")], [("a", "one"), ("b", "changed"), ("c", "x")]):
        inline(spark, index_stream.FILES, rows).write.mode("append").parquet(source)
        index_stream.keep_index(index_stream.file_stream(spark, source), target, checkpoint, analyse).awaitTermination()
    from strandwork.plans.retrieval import newest

    rows = spark.read.parquet(target)
    assert rows.count() == 4 and {r.path: r.n for r in newest(rows).collect()} == {"a": 3, "b": 7, "c": 1}


def test_index_stream_follows_changes_back_and_deletions(spark, tmp_path):
    from strandwork.plans.retrieval import newest

    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "index", "checkpoint"))
    analyse = lambda df: df.select("path", "hash", F.col("content").alias("text"))
    steps = [[("x", "A"), ("y", "1")], [("x", "B")], [("x", "A"), ("y", None), ("never", None)], [("x", "A")], [("y", "2")]]
    wanted = [{"x": "A", "y": "1"}, {"x": "B", "y": "1"}, {"x": "A"}, {"x": "A"}, {"x": "A", "y": "2"}]
    written = [2, 3, 5, 5, 6]
    for rows, state, n in zip(steps, wanted, written, strict=True):
        inline(spark, index_stream.FILES, rows).coalesce(1).write.mode("append").parquet(source)
        index_stream.keep_index(index_stream.file_stream(spark, source), target, checkpoint, analyse).awaitTermination()
        assert {r.path: r.text for r in newest(spark.read.parquet(target)).collect()} == state and spark.read.parquet(target).count() == n
    # several versions in one batch: the latest counts; a batch that is run again changes nothing
    import time

    for text in ("C", "D"):
        inline(spark, index_stream.FILES, [("x", text)]).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    for _ in range(2):
        index_stream.keep_index(index_stream.file_stream(spark, source), target, checkpoint, analyse).awaitTermination()
        assert {r.path: r.text for r in newest(spark.read.parquet(target)).collect()} == {"x": "D", "y": "2"}
        last = max(p for p in (tmp_path / "checkpoint/commits").iterdir() if p.name.isdigit())
        last.unlink()
        (last.parent / f".{last.name}.crc").unlink(missing_ok=True)


def test_streamed_counters(spark, tmp_path):
    schema = "at timestamp, who string, reason string"
    rows = [(f"2024-01-01 00:{i:02d}:00", "u", "boom" if i != 2 else "other") for i in range(6)] + [("2024-01-01 00:00:00", "v", None)]
    inline(spark, "at string, who string, reason string", rows).select(F.to_timestamp("at").alias("at"), "who", "reason").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = index_stream.circuit_breaker(stream(), "who", "reason").writeStream.format("memory").queryName("breaker").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.group_key, r.seen, r.tripped) for r in spark.sql("SELECT * FROM breaker").collect()} == {("u", 5, True), ("v", 1, False)}
    q = index_stream.windowed_counts(stream(), "at", "who", "5 minutes").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.sql("SELECT * FROM counts").collect()) == [1, 1, 5]


def test_what_suppliers_spread_is_not_taken_for_as_small_as_their_file(spark, sf):
    """Joins of it were broadcasts of tables that grow with the suppliers: a few bytes in their file, a tree of sources each."""
    from strandwork.sources.tables import spread

    files = spread(spark, sf, "path string, content string", [("a{n}.py", "x{n} = 1"), ("b.py", None)])
    words = files.select("path", F.explode(F.split("content", " ")).alias("word")).distinct()
    plan = files.join(words, "path")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {tuple(r) for r in files.where("path IN ('a3.py', 'b.py')").collect()} == {("a3.py", "x3 = 1"), ("b.py", None)}
