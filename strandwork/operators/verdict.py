"""Verdicts on test runs, snapshots, caches and retained state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork import config


def failure_sets(before: Column, after: Column) -> dict[str, Column]:
    """new, existing and fixed failures between two sorted distinct id arrays."""
    return {"new": F.array_except(after, before), "existing": F.array_intersect(after, before), "fixed": F.array_except(before, after)}


def verdict(
    *, baseline_code: Column, baseline_ids: Column, targeted_code: Column, targeted_ids: Column, full_code: Column, full_ids: Column, targets: Column, pending: Column, infrastructure: Column
) -> Column:
    """The status of a change, the first rule that holds; a null code means the run is missing."""
    no_targeted, no_full, no_base = targeted_code.isNull(), full_code.isNull(), baseline_code.isNull()
    passed = lambda code: F.coalesce(code == 0, F.lit(False))
    failed = lambda code: F.coalesce(code != 0, F.lit(False))
    new, existing = F.size(F.array_except(full_ids, baseline_ids)) > 0, F.size(F.array_intersect(full_ids, baseline_ids)) > 0
    return (
        F.when(pending, "pending")
        .when(infrastructure & no_full & (no_targeted | passed(targeted_code)), "infrastructure_error")
        .when(no_targeted & no_full, "unavailable")
        .when(failed(targeted_code) & F.arrays_overlap(targeted_ids, targets), "repair_failed")
        .when(failed(targeted_code), "targeted_failed")
        .when(passed(full_code) & (F.size(targets) > 0), "repair_passed")
        .when(passed(full_code), "passed")
        .when(no_base, "unclear")
        .when(F.arrays_overlap(full_ids, targets), "repair_failed")
        .when(failed(baseline_code) & (F.size(baseline_ids) == 0), "unclear")
        .when(no_full | ((F.size(baseline_ids) == 0) & (F.size(full_ids) == 0)), "unclear")
        .when(new, "regressions")
        .when(existing, "existing")
        .otherwise("unclear")
    )


def repair_targets(status: Column, full_ids: Column, targeted_ids: Column, new_ids: Column) -> Column:
    """Failures that a repair is about: by status the targeted, the new, or both."""
    return F.when(status.isin("targeted_failed", "repair_failed"), F.array_union(targeted_ids, new_ids)).when(status == "regressions", new_ids).otherwise(F.array().cast("array<string>"))


def digest(files: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n, digest): one hash of a snapshot(path, hash), whatever the order of its rows.

    Rows are hashed first and the sorted hashes of 4,096 hashed buckets next, so no task holds
    a whole snapshot.
    """
    row = F.sha2(F.concat_ws("\t", "path", "hash"), 256)
    cells = files.select(*keys, row.alias("row")).withColumn("bucket", F.left("row", F.lit(3)))
    buckets = cells.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("row")), ","), 256).alias("h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), ",")
    return buckets.groupBy(*keys).agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("digest"))


def usable_baseline(wanted: DataFrame, cache: DataFrame, now: Column, keys: list[str], age: int = config.BASELINE_AGE_SECONDS) -> DataFrame:
    """wanted(keys...) with usable: whether cache(keys..., saved_at) has an entry no older than age seconds."""
    newest = cache.groupBy(*keys).agg(F.max("saved_at").alias("saved_at"))
    seconds = F.unix_micros(now) - F.unix_micros(F.col("saved_at").cast("timestamp"))
    return wanted.join(newest, keys, "left").withColumn("usable", F.coalesce(seconds.between(0, age * 1_000_000), F.lit(False))).drop("saved_at")


def stale_temporaries(entries: DataFrame, now: Column, pattern: str, age: int = config.TEMP_AGE_SECONDS) -> DataFrame:
    """entries(name, modified, active) that may go: named by pattern, older than age, not active."""
    old = F.unix_micros(now) - F.unix_micros(F.col("modified").cast("timestamp")) > age * 1_000_000
    return entries.where(F.col("name").rlike(pattern) & old & ~F.col("active"))


def latest_pointer(pointers: DataFrame, runs: DataFrame, *keys: str) -> DataFrame:
    """pointers(keys..., run_id, state) with the run's own state where its run_id is the pointer's."""
    own = runs.select(*keys, "run_id", F.col("state").alias("__own"))
    return pointers.join(own, [*keys, "run_id"], "left").withColumn("state", F.coalesce("__own", "state")).drop("__own")


def semantic_state(entry_status: Column, same_hash: Column, same_model: Column, same_version: Column, known: Column) -> Column:
    """current, or why a row waits: new_file, source_changed, model_changed or analyzer_version_changed."""
    return (
        F.when(~known, "new_file").when(~same_hash, "source_changed").when(~same_model, "model_changed").when(~same_version, "analyzer_version_changed")
        .when(entry_status == "complete", "current").otherwise("pending")
    )


def missing_required(required: DataFrame, rendered: DataFrame, keys: list[str]) -> DataFrame:
    """required rows that are neither rendered exactly nor marked unavailable: a publisher must stop on any."""
    return required.join(rendered.where("state IN ('exact', 'unavailable')").select(*keys).distinct(), keys, "left_anti")


def last_rounds(rounds: Column, keep: int = config.FOLLOW_UP_ROUNDS) -> Column:
    return F.slice(rounds, F.greatest(F.size(rounds) - keep + 1, F.lit(1)), keep)
