"""Cross-site boilerplate lines by distinct-site spread, in DataFrame operations only.

Each line (outer whitespace aside) is hashed; a HyperLogLog sketch per hash estimates on
how many sites it stands, partial sketches merging map-side. Estimates near the threshold
are settled by exact distinct counts. A line on enough sites stays only where it stands
first, by document id and position, and goes everywhere else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.support import whole_text, written

SPACE = " \t\n\x0b\f\r"
#: log2 of a sketch's registers: a relative error of 1.04 / 2**6 = 1.6 %.
LG_K = 12
#: Estimates within this share of the threshold, about six errors, are counted exactly.
MARGIN = 0.1


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 10) -> DataFrame:
    """docs with its boilerplate lines removed from text, and n_lines and n_removed (long) added.

    A line is what stands between \\n; lines without a word are never removed. A null site is
    one site of its own, and null ids stand before all others. Null text stays null with 0
    lines. Rows that repeat id and text are treated alike, so both keep a first occurrence
    that stands in them. No row is dropped; extra columns pass through.
    """
    t = whole_text(text)
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("digest"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(t, "\n")).alias("pos", "line"))
    line = F.btrim("line", F.lit(SPACE))
    lines = written(keyed.where(line != "").select("id", "digest", "site", "pos", F.xxhash64(line).alias("key")), "lines")

    spread = lines.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(F.struct("id", "digest", "pos")).alias("first"))
    spread = spread.select("key", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - MARGIN))
    spread = written(spread, "spread")
    near = F.col("sites") <= min_sites * (1 + MARGIN)
    exact = lines.join(spread.where(near).select("key"), "key").groupBy("key", "site").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("one").alias("exact"))
    far = spread.where(~near).select("key", "first")
    common = written(far.union(spread.join(exact.where(F.col("exact") >= min_sites), "key").select("key", "first")), "common")

    at = F.struct("id", "digest", "pos")
    gone = lines.join(common, "key").where(~at.eqNullSafe(F.col("first"))).groupBy("id", "digest").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("gone").alias("__gone"))

    marked = docs.drop("n_lines", "n_removed").withColumn("__of", F.xxhash64(whole_text(text)))
    marked = marked.join(gone, marked[id_col].eqNullSafe(F.col("__id")) & (F.col("__of") == F.col("__digest")), "left")
    parts = F.split(F.col(text).cast("string"), "\n")
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    marked = marked.withColumn("n_lines", F.coalesce(F.when(F.col(text) != "", F.size(parts)), F.lit(0)).cast("long"))
    marked = marked.withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long")).withColumn("n_removed", F.greatest("n_removed", F.lit(0)))
    return marked.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(left)).drop("__id", "__digest", "__gone", "__of")
