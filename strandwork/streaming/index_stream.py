"""Keeping an index current from a stream of files, and stateful counters over it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

FILES = "path string, content string"
STATE = "group_key string, seen int, tripped boolean"


def file_stream(spark: SparkSession, directory: str, schema: str = FILES) -> DataFrame:
    """New Parquet files of (path, content) as they arrive, with the time at which each was written; null content says that the file is gone."""
    return spark.readStream.schema(schema).parquet(directory).withColumn("at", F.col("_metadata.file_modification_time"))


def _heads(spark: SparkSession, target: str, before: int) -> DataFrame:
    """(path, hash) of the files there are after the last batch before the given one."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(f"{target}/_heads")
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(top)) if fs.exists(top) else []
    for old in [n for n in found if n < before][:-2]:  # the last two stay, in case a batch is run again
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{target}/_heads/batch={old}"), True)
    last = max((n for n in found if n < before), default=None)
    return spark.createDataFrame([], "path string, hash string") if last is None else spark.read.parquet(f"{target}/_heads/batch={last}")


def keep_index(stream: DataFrame, target: str, checkpoint: str, analyse: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Appends to the Parquet index at target the analysed rows of contents that differ from the newest ones.

    stream(path, content, at): of a path's rows in a batch the latest counts, of equally late
    ones the greatest hash, content before none. Null content deletes: a row that only has the
    path and deleted. Rows carry seq, the batch they came with; retrieval.newest reads the
    state. Each batch leaves a table of paths and hashes for the next, so history isn't read
    again. A batch that is run again writes its own partitions anew, so a restart repeats nothing.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy("path").agg(F.max(F.struct("at", F.sha2("content", 256).alias("hash"), "content")).alias("x")).select("path", "x.hash", "x.content")
        heads = _heads(spark, target, number)
        changed = last.join(heads.withColumnRenamed("hash", "was"), "path", "left").where(~F.col("hash").eqNullSafe(F.col("was"))).drop("was").persist()
        rows = analyse(changed.where("content IS NOT NULL")).withColumn("deleted", F.lit(False))
        gone = changed.where("content IS NULL").select("path", F.lit(True).alias("deleted"))
        rows.unionByName(gone, allowMissingColumns=True).write.mode("overwrite").parquet(f"{target}/seq={number}")
        now = heads.join(changed, "path", "left_anti").unionByName(changed.where("content IS NOT NULL").select("path", "hash"))
        now.write.mode("overwrite").parquet(f"{target}/_heads/batch={number}")
        changed.unpersist()

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per key and window; those later than the watermark don't count."""
    return events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def circuit_breaker(events: DataFrame, key: str, reason: str, first: int = 5, most: int = 4) -> DataFrame:
    """(group_key, seen, tripped) as events arrive: trips when most of a key's first items failed for one reason."""

    def update(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, reasons = (state.get[0], state.get[1].split("\n") if state.get[1] else []) if state.exists else (0, [])
        for batch in batches:
            for value in batch[reason]:
                if seen < first:
                    reasons.append("" if value is None else str(value))
                    seen += 1
        state.update((seen, "\n".join(reasons)))
        tripped = seen >= first and max((reasons.count(r) for r in set(reasons) if r), default=0) >= most
        yield pd.DataFrame([(str(name[0]), seen, tripped)], columns=["group_key", "seen", "tripped"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.groupBy(key).applyInPandasWithState(update, STATE, "seen int, reasons string", "update", GroupStateTimeout.NoTimeout)
