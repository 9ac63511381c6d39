import numpy as np
import pytest

from strandwork.operators import evidence, nesting

RANGES = "path string, name string, start long, end long"


def random_ranges(seed, n=300):
    rng = np.random.default_rng(seed)
    start = rng.integers(0, 60, n)
    return [(f"p{i % 3}" if i % 5 else "hot", f"r{i}", int(s), int(s + rng.integers(0, 12))) for i, s in enumerate(start)]


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_ranges_without_those_that_hold_another(spark, width):
    rows = random_ranges(width) + [(None, "x", 1, 9), (None, "y", 2, 3), ("hot", "open", None, None), ("hot", "same", 70, 71), ("hot", "same", 70, 71)]
    inside = lambda a, b: a[0] == b[0] and None not in (a[2], b[2]) and a[2] <= b[2] and b[3] <= a[3] and a[3] - a[2] > b[3] - b[2]
    got = nesting.without_containers(spark.createDataFrame(rows, RANGES), "path", width=width).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(a) for a in rows if not any(inside(a, b) for b in rows))


@pytest.mark.parametrize("width", [1, 5, 4096])
def test_each_range_gets_the_innermost_that_holds_it(spark, width):
    rng = np.random.default_rng(width)
    rows = []

    def grow(path, lo, hi, depth):
        at = lo
        while at <= hi and depth < 6:
            end = min(hi, at + int(rng.integers(0, max(1, hi - at + 1))))
            rows.append((path, f"{path}{len(rows):04}", at, end))
            grow(path, at, end, depth + 1 + int(rng.integers(0, 3)))
            at = end + 1 + int(rng.integers(0, 3))

    grow("a", 0, 60, 0), grow("b", 5, 40, 0), grow("c", 3, 3, 0)
    got = {r.name: (r.depth, r.inside) for r in nesting.enclosing(spark.createDataFrame(rows, RANGES), "path", width=width).collect()}
    want = {}
    for p, name, lo, hi in rows:
        holders = [r for r in rows if r[0] == p and r[2] <= lo and hi <= r[3] and (r[2], -r[3], r[1]) < (lo, -hi, name)]
        want[name] = (len(holders), max(holders, key=lambda r: (r[2], -r[3], r[1]))[1] if holders else None)
    assert got == want


@pytest.mark.parametrize("width", [3, 4096])
def test_last_mark_before_a_line(spark, width):
    rng = np.random.default_rng(4)
    lines = [("a" if i % 4 else "b", int(n), f"line{i}") for i, n in enumerate(rng.integers(0, 50, 60))]
    marks = [("a", int(n), f"m{n}") for n in rng.integers(5, 50, 8)] + [("a", 20, "m1"), ("a", 20, "m9")]
    got = nesting.last_before(spark.createDataFrame(lines, "path string, line_no int, body string"), spark.createDataFrame(marks, "path string, line_no int, name string"), "path", width=width).collect()
    best = lambda p, n: max(((m[1], m[2]) for m in marks if m[0] == p and m[1] <= n), default=(None, None))
    assert sorted(map(str, ((r.path, r.line_no, r.body, (r.name_line, r.name)) for r in got))) == sorted(str((p, n, b, best(p, n))) for p, n, b in lines)


def plain_closure(roots, calls, depth, symbols, files):
    """The walk as a queue: callers in order of discovery, a file over the cap is skipped and not counted."""
    roots = sorted(roots, key=lambda r: (r[3], r[1], r[2]))
    known, queue, found, held = {(p, n) for _, p, n, _ in roots}, [(p, n, 0) for _, p, n, _ in roots], [], []
    while queue and len(found) < symbols:
        path, name, level = queue.pop(0)
        if level >= depth:
            continue
        for _, p, n in sorted((pos, p, n) for sp, sn, pos, p, n in calls if (sp, sn) == (path, name)):
            if (p, n) in known or (p not in held and len(held) >= files):
                continue
            known.add((p, n))
            found.append((p, n, level + 1, len(found) + 1))
            held += [p] if p not in held else []
            queue.append((p, n, level + 1))
            if len(found) >= symbols:
                break
    return found


@pytest.mark.parametrize(("symbols", "files"), [(24, 12), (9, 3), (200, 4), (1, 1)])
def test_closure_is_the_plain_walk_on_random_graphs(spark, symbols, files):
    rng = np.random.default_rng(symbols)
    node = lambda k: (f"f{k % 17}", f"n{k}")
    calls = [(*node(a), int(p), *node(b)) for a, b, p in zip(rng.integers(0, 120, 500), rng.integers(0, 120, 500), rng.permutation(500), strict=True)]
    roots = [(t, *node(int(k)), i) for t in range(6) for i, k in enumerate(rng.choice(120, 3, replace=False))]
    calls += [("f1", "n18", 1000 + k, *node(k)) for k in range(20)] + [("f1", "n18", 2000 + k, "f1", f"own{k}") for k in range(10)]
    roots.append((9, "f1", "n18", 0))
    got = evidence.rooted_closure(spark.createDataFrame(roots, "task_id int, path string, name string, rank int"), spark.createDataFrame(calls, "src_path string, src string, pos int, dst_path string, dst string"), symbols=symbols, files=files).collect()
    for t in {r[0] for r in roots}:
        mine = sorted((r["rank"], r.path, r.name, r.depth) for r in got if r.task_id == t)
        assert mine == [(k, p, n, d) for p, n, d, k in plain_closure([r for r in roots if r[0] == t], calls, 3, symbols, files)]


def test_a_root_with_calls_in_many_files_fills_the_file_cap_alone(spark):
    calls = [("r", "root", k, f"g{k}", "f") for k in range(20)] + [("r", "root", 20 + k, "r", f"own{k}") for k in range(10)]
    got = evidence.rooted_closure(spark.createDataFrame([(1, "r", "root", 0)], "task_id int, path string, name string, rank int"), spark.createDataFrame(calls, "src_path string, src string, pos int, dst_path string, dst string")).collect()
    assert [r.path for r in sorted(got, key=lambda r: r["rank"])] == [f"g{k}" for k in range(12)]
    chain = [(a, a, 0, b, b) for a, b in zip("rabcd", "abcde", strict=True)]
    got = evidence.rooted_closure(spark.createDataFrame([(1, "r", "r", 0)], "task_id int, path string, name string, rank int"), spark.createDataFrame(chain, "src_path string, src string, pos int, dst_path string, dst string")).collect()
    assert sorted(r.name for r in got) == ["a", "b", "c"]


def test_calls_may_be_made_for_each_level(spark):
    rng = np.random.default_rng(3)
    node = lambda k: (f"f{k % 7}", f"n{k}")
    rows = [(*node(a), int(p), *node(b)) for a, b, p in zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.permutation(150), strict=True)]
    calls = spark.createDataFrame(rows + rows[:9], "src_path string, src string, pos int, dst_path string, dst string")
    roots = spark.createDataFrame([(t, *node(t * 7), 1) for t in range(6)] + [(9, "none", "none", 1)], "task_id int, path string, name string, rank int")
    asked = []

    def of(nodes):
        asked.append(sorted(map(tuple, nodes.collect())))
        return calls.join(nodes.withColumnsRenamed({"path": "src_path", "name": "src"}), ["src_path", "src"], "left_semi")

    for symbols in (5, 24):
        asked.clear()
        want = evidence.rooted_closure(roots, calls, symbols=symbols)
        got = evidence.rooted_closure(roots, of, symbols=symbols)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
        done = {t for t in range(6) if want.where(f"task_id = {t} AND depth = 1").count() >= symbols}
        assert len(asked[0]) == 7 and set(asked[1]) == {(r.path, r.name) for r in want.collect() if r.depth == 1 and r.task_id not in done}


def test_the_call_closure_follows_all_pairs(spark, tmp_path):
    """Of the parts bought together only pairs with a sum divisible by nine were followed, in the SQL too."""
    import duckdb

    from strandwork.plans.catalogue import ORACLE_SQL, QUERIES

    lines = [(1, 1, 7), (1, 2, 8), (2, 2, 8), (2, 3, 8), (3, 3, 9), (3, 4, 9), (3, 3, 9), (4, 4, 8), (4, 5, 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(map(tuple, QUERIES["q_call_closure"](spark, str(tmp_path)).collect()))
    assert [r for r in got if r[0] == 7] == [(7, "f2", "2", 1, 1), (7, "f3", "3", 2, 2), (7, "f4", "4", 3, 3)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(con.execute(ORACLE_SQL["q_call_closure"]).fetchall()) == got


@pytest.mark.parametrize("width", [2, 4096])
def test_ranges_go_to_their_slice_once(spark, width):
    rows = [(None, "n1", 0, 9), (None, "n2", 2, 3), ("p", "out", 0, 20), ("p", None, 5, 19), ("p", "deep", 7, 7), ("p", "next", 21, 21), ("p", "open", 3, None), ("p", "lost", None, None)]
    found = nesting.enclosing(spark.createDataFrame(rows, RANGES), "path", width=width)
    want = [(None, "n1", 0, 9, 0, None), (None, "n2", 2, 3, 1, "n1"), ("p", "out", 0, 20, 0, None), ("p", None, 5, 19, 1, "out"), ("p", "deep", 7, 7, 2, None), ("p", "next", 21, 21, 0, None), ("p", "open", 3, None, 0, None), ("p", "lost", None, None, 0, None)]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.count("Join") == 1  # all rows were shuffled and joined twice, as openings and closings, then as asks and offers
