"""An index in published versions: analysed in parts, hashes checked before and after, published by one rename.

Under `target`: pending/N/plan (what version N will do), pending/N/part=K (rows of its finished
parts), versions/N (the same folder once published, with the heads of all files). A run that is
killed before the rename leaves the pending folder: the next run goes on with its plan and does
only the parts that are missing. Readers see whole versions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Files = Callable[[], DataFrame]
PLAN = "path string, hash string, reason string, part int, parts int"
HEADS = "path string, hash string, version int"


class Versions:
    """The versions of one index. files() reads the files as they are now: (path, content)."""

    def __init__(self, spark: SparkSession, target: str, parts: int = 8):
        self.spark, self.target, self.parts = spark, target.rstrip("/"), parts
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.target}/{p}")
        self._fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self, p: str) -> bool:
        return self._fs.exists(self._path(p))

    def newest(self) -> int:
        """The last published version; 0 before the first."""
        if not self._there("versions"):
            return 0
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(self._path("versions"))), default=0)

    def heads(self, version: int | None = None) -> DataFrame:
        """(path, hash, version): the indexed files of a version and the version that has their rows."""
        n = self.newest() if version is None else version
        return self.spark.read.schema(HEADS).parquet(f"{self.target}/versions/{n}/heads") if n else self.spark.createDataFrame([], HEADS)

    def rows(self, version: int | None = None) -> DataFrame:
        """The index rows of a version, each file's from the version that analysed it."""
        n = self.newest() if version is None else version
        heads = self.heads(n)
        found = None
        for v in [r.version for r in heads.select("version").distinct().collect()]:  # versions that still hold rows
            own = self.spark.read.option("basePath", f"{self.target}/versions/{v}/rows").parquet(f"{self.target}/versions/{v}/rows").drop("part").withColumn("version", F.lit(v))
            found = own if found is None else found.unionByName(own, allowMissingColumns=True)
        return found.join(heads, ["path", "hash", "version"], "left_semi") if found is not None else heads

    def state(self, files: Files, failed: DataFrame | None = None) -> DataFrame:
        """(path, hash, reason): files that wait for analysis: new_file or source_changed against the newest version."""
        now = files().select("path", F.sha2("content", 256).alias("hash"))
        old = self.heads().select("path", F.col("hash").alias("was"))
        reason = F.when(F.col("was").isNull(), "new_file").otherwise("source_changed")
        return now.join(old, "path", "left").where(~F.col("hash").eqNullSafe(F.col("was"))).select("path", "hash", reason.alias("reason"))

    def update(self, files: Files, analyse: Callable[[DataFrame], DataFrame]) -> int:
        """Publishes the version that follows files(); the newest version's number, the old one if nothing changed.

        analyse turns (path, content, hash) into rows with path and hash. A file that changes or
        goes between the plan and the end of its part's analysis isn't published: it keeps its
        old row, or has none, and waits for the next version.
        """
        n = self.newest() + 1
        pending = f"{self.target}/pending/{n}"
        if not self._there(f"pending/{n}/plan/_SUCCESS"):
            part = F.pmod(F.xxhash64("path"), F.lit(self.parts)).cast("int").alias("part")
            self.state(files).select("path", "hash", "reason", part, F.lit(self.parts).alias("parts")).write.mode("overwrite").parquet(f"{pending}/plan")
        plan = self.spark.read.schema(PLAN).parquet(f"{pending}/plan")
        now = files().select("path", F.sha2("content", 256).alias("hash"))
        gone = self.heads().join(now, "path", "left_anti")
        wanted = sorted((r.part, r.parts) for r in plan.select("part", "parts").distinct().collect())  # one for each part that the plan was cut into
        if not wanted and gone.isEmpty():
            self._fs.delete(self._path(f"pending/{n}"), True)
            return n - 1
        for k, parts in wanted:
            if self._there(f"pending/{n}/rows/part={k}/_SUCCESS"):
                continue  # done by a run that was stopped later
            mine = plan.where(F.col("part") == k).select("path", "hash")
            # only the part's texts are hashed and shuffled: a file travels once a version; a plan of older code doesn't say its parts
            own = F.lit(True) if parts is None else F.pmod(F.xxhash64("path"), F.lit(parts)) == k
            before = files().where(own).withColumn("hash", F.sha2("content", 256)).join(mine, ["path", "hash"], "left_semi")
            found = analyse(before.select("path", "content", "hash"))
            after = files().where(own).select("path", F.sha2("content", 256).alias("hash"))
            found.join(after, ["path", "hash"], "left_semi").write.mode("overwrite").parquet(f"{pending}/rows/part={k}")
        self._publish(n, files, bool(wanted))
        return n

    def _publish(self, n: int, files: Files, some: bool) -> None:
        pending = f"{self.target}/pending/{n}"
        old = self.heads()
        if some:
            done = self.spark.read.parquet(f"{pending}/rows").select("path", "hash").distinct()
            now = files().select("path", F.sha2("content", 256).alias("hash"))
            fresh = done.join(now, ["path", "hash"], "left_semi").withColumn("version", F.lit(n))
            every = old.unionByName(fresh)
        else:
            every = old
        here = files().select("path").distinct()
        last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("version")))
        heads = every.join(here, "path", "left_semi").withColumn("__n", last).where("__n = 1").select("path", "hash", F.col("version").cast("int").alias("version"))
        heads.write.mode("overwrite").parquet(f"{pending}/heads")
        self._fs.mkdirs(self._path("versions"))
        if not self._fs.rename(self._path(f"pending/{n}"), self._path(f"versions/{n}")):
            raise RuntimeError(f"version {n} was published by another run")
