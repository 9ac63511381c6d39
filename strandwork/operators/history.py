"""History of changes and runs as tables: transitions return new rows, nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandwork import config
from strandwork.functions import times
from strandwork.operators import ranking

HISTORY = "id string, status string, applied_at timestamp, completed_at timestamp, undone_at timestamp, test_status string, files array<struct<path: string, before_exists: boolean, after_exists: boolean>>"


def listed(applied: DataFrame, undone: DataFrame) -> DataFrame:
    """Applied and undone entries, the newest id first; a name without metadata tells its own time."""
    both = applied.withColumn("state", F.lit("APPLIED")).unionByName(undone.withColumn("state", F.lit("UNDONE")), allowMissingColumns=True)
    return both.withColumn("shown_at", times.shown_time(F.col("id"))).orderBy(F.desc("id"))


def begin(entry_id: str, before: DataFrame) -> DataFrame:
    """A PENDING entry over before(path, exists)."""
    files = F.array_sort(F.collect_list(F.struct("path", F.col("exists").alias("before_exists"), F.lit(None).cast("boolean").alias("after_exists"))))
    none = F.lit(None).cast("timestamp")
    return before.agg(files.alias("files")).select(F.lit(entry_id).alias("id"), F.lit("PENDING").alias("status"), none.alias("applied_at"), none.alias("completed_at"), none.alias("undone_at"), F.lit("NOT_RUN").alias("test_status"), "files")


def move(history: DataFrame, entry_id: str, frm: str, to: str, at: Column, stamp: str) -> DataFrame:
    """history with one entry moved between states and stamped; other rows and other states stay."""
    hit = (F.col("id") == entry_id) & (F.col("status") == frm)
    return history.withColumns({stamp: F.when(hit, at).otherwise(F.col(stamp)), "status": F.when(hit, to).otherwise(F.col("status"))})


def finalize(history: DataFrame, entry_id: str, after: DataFrame, at: Column) -> DataFrame:
    """PENDING to APPLIED with after(path, exists), then the oldest beyond the retention go."""
    now = after.agg(F.map_from_entries(F.collect_list(F.struct("path", "exists"))).alias("__after"))
    filled = F.transform("files", lambda f: F.struct(f["path"].alias("path"), f["before_exists"].alias("before_exists"), F.coalesce(F.col("__after")[f["path"]], f["after_exists"]).alias("after_exists")))
    joined = history.crossJoin(now).withColumn("files", F.when(F.col("id") == entry_id, filled).otherwise(F.col("files"))).drop("__after")
    return pruned(move(joined, entry_id, "PENDING", "APPLIED", at, "applied_at"))


def undo(history: DataFrame, entry_id: str, at: Column) -> DataFrame:
    return pruned(move(history, entry_id, "APPLIED", "UNDONE", at, "undone_at"))


def pruned(history: DataFrame, keep: int = config.HISTORY_PER_STATUS) -> DataFrame:
    """The newest keep entries of each status; pending ones all stay."""
    at = F.coalesce("undone_at", "completed_at", "applied_at", times.from_name(F.col("id")))
    kept = ranking.retention(history.withColumn("__at", at), [F.desc("__at"), F.desc("id")], "status", keep=keep)
    return kept.where(F.col("kept") | (F.col("status") == "PENDING")).drop("kept", "__at")


def tested(history: DataFrame, entry_id: str, status: str, at: Column) -> DataFrame:
    """The test fields of one entry set."""
    hit = F.col("id") == entry_id
    return history.withColumns({"test_status": F.when(hit, status).otherwise(F.col("test_status")), "completed_at": F.when(hit, at).otherwise(F.col("completed_at"))})


def latest(history: DataFrame, status: str = "APPLIED") -> DataFrame:
    return history.where(F.col("status") == status).orderBy(F.desc("id")).limit(1)


def completed_run(pointer: DataFrame, run: DataFrame, current: DataFrame) -> DataFrame:
    """run(run_id, snapshot, ...) with current: whether its id is the pointer's and its snapshot still stands.

    A run that is overtaken, or whose files changed meanwhile, keeps its row but isn't current.
    """
    marked = run.join(pointer.select(F.col("run_id").alias("__newest")), F.col("run_id") == F.col("__newest"), "left").join(current.select(F.col("snapshot").alias("__now")), F.col("snapshot") == F.col("__now"), "left")
    return marked.withColumn("current", F.col("__newest").isNotNull() & F.col("__now").isNotNull()).drop("__newest", "__now")


def consistent(run: DataFrame, history: DataFrame, patch: DataFrame, snapshot: DataFrame) -> DataFrame:
    """run(run_id, entry_id) rows whose entry is applied, whose patch paths are the entry's, and whose snapshot has them all."""
    entry = history.where("status = 'APPLIED'").select(F.col("id").alias("entry_id"), F.array_sort(F.transform("files", lambda f: f["path"])).alias("__files"))
    wanted = patch.groupBy("entry_id").agg(F.array_sort(F.collect_set("path")).alias("__patch"))
    missing = patch.join(snapshot.select("path"), "path", "left_anti").select("entry_id").distinct()
    return run.join(entry, "entry_id").join(wanted, "entry_id").where("__files = __patch").drop("__files", "__patch").join(missing, "entry_id", "left_anti")


def upsert_results(cache: DataFrame, results: DataFrame, *keys: str) -> DataFrame:
    """cache(keys..., saved_at, returncode, duration, failed) after results of the same form: the newest of each key; runs without a return code aren't kept."""
    fresh = results.where(F.col("returncode").isNotNull()).select(*cache.columns)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("saved_at"), F.desc("returncode")))
    return cache.unionByName(fresh).withColumn("__n", last).where("__n = 1").drop("__n")


def report(history: DataFrame, *keep: str) -> DataFrame:
    """(keep..., id, line): one line for each entry: its time, state, test status and how many files it has."""
    n = F.coalesce(F.size("files"), F.lit(0))
    files = F.concat(n.cast("string"), F.when(n == 1, " file").otherwise(" files"))
    return history.select(*keep, "id", F.concat_ws("  ", times.shown_time(F.col("id")), F.col("status"), F.coalesce("test_status", F.lit("NOT_RUN")), files).alias("line"))


def validation_report(runs: DataFrame, *keys: str) -> DataFrame:
    """(keys..., report): status and the counts and first ten ids of new, existing and fixed failures of runs(keys..., status, before, after)."""
    from strandwork.operators import verdict

    def part(name: str, ids: Column) -> Column:
        listed = F.array_join(F.slice(ids, 1, 10), ", ")
        more = F.when(F.size(ids) > 10, F.concat(F.lit(" … and "), (F.size(ids) - 10).cast("string"), F.lit(" more"))).otherwise("")
        return F.when(F.size(ids) > 0, F.concat(F.lit(f"{name} failures: "), F.size(ids).cast("string"), F.lit(" ("), listed, more, F.lit(")")))

    sets = verdict.failure_sets(F.array_sort("before"), F.array_sort("after"))
    return runs.select(*keys, F.concat_ws("\n", F.concat(F.lit("Status: "), "status"), *[part(k, v) for k, v in sets.items()]).alias("report"))


def progress(df: DataFrame, total: Column, order: str, seconds: str, *keys: str) -> DataFrame:
    """Progress events: done, remaining, mean and expected seconds at every item."""
    out = ranking.eta(df, seconds, order, total, *keys)
    return out.withColumn("remaining", total - F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
