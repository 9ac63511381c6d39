"""Shared plumbing: the cluster's shared folder, written intermediate tables, text columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract: space and the controls tab to carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"

#: Whether Spark deletes a query's shuffle files at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = getattr(spark, "_strandwork_dir", None)
    if not found:
        found = spark._strandwork_dir = tempfile.mkdtemp(prefix="strandwork-")
    return found


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors; its shuffle files go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandwork-{tag}-{uuid.uuid4().hex}"
    spark.__dict__.setdefault("_strandwork_written", []).append(path)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")  # what was shuffled for the table is of no use beyond it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def written_so_far(spark: SparkSession) -> int:
    """How many intermediate tables of the session are left."""
    return len(spark.__dict__.get("_strandwork_written", []))


def drop_written(spark: SparkSession, since: int = 0, but: int = 0) -> int:
    """Deletes the session's intermediate tables once their results are written; how many there were.

    since: leaves so many that were written first; but: and so many that were written last.
    """
    paths = spark.__dict__.get("_strandwork_written", [])
    gone = paths[since : len(paths) - but]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in gone:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
    paths[since : len(paths) - but] = []
    return len(gone)


def whole_text(col: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text as array<string>, case kept."""
    return F.array_remove(F.split(text, WORD_BREAK), "")


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the column's text modulo n; null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that long texts don't add up in a Python worker; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    bound = 4 << 20
    try:
        small = now is not None and 0 < int(now) <= bound
    except ValueError:
        small = False
    if not small:
        spark.conf.set(key, str(bound))


def id_bitmap(ids: DataFrame, col: str, lg_bits: int = 22) -> bytes:
    """A bitmap of 2**lg_bits bits, set at the hashes of a long column: bounded whatever the table's size."""
    spot = F.pmod(F.xxhash64(col), F.lit(1 << lg_bits))
    cells = ids.select(spot.alias("spot")).select(F.expr("shiftrightunsigned(spot, 3)").alias("byte"), F.expr("shiftleft(1, cast(spot & 7 AS int))").alias("bit"))
    cells = cells.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (lg_bits - 3), np.uint8)
    out[cells.column("byte").to_numpy()] = cells.column("bits").to_numpy()
    return out.tobytes()


def in_bitmap(df: DataFrame, col: str, bitmap: bytes, without: bool = False) -> DataFrame:
    """Rows whose column may be in the bitmap: all that are, and few others while the bitmap is sparse. without: the other rows."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap)
    bits = len(bitmap) * 8

    @F.pandas_udf("boolean")
    def held(spots: pd.Series) -> pd.Series:
        at = spots.to_numpy()
        return pd.Series(np.frombuffer(shared.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1 == (0 if without else 1))

    return df.where(held(F.pmod(F.xxhash64(col), F.lit(bits))))
