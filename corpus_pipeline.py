"""The training-data pipeline: five stages over documents, each written and read again.

language ID, line dedup, MinHash near-dedup, benchmark decontamination, source mixing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.llm.decontaminate import judge_contamination
from strandwork.llm.lang_id import identify
from strandwork.llm.line_dedup import dedup_lines
from strandwork.llm.mixing import mix_sources
from strandwork.llm.near_dedup import near_duplicates
from strandwork.llm.support import drop_written, written, written_so_far

#: Sites on which a line counts as boilerplate, however many sites there are.
LINE_SITES = 10
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, null and empty ones too, which have no language; lang becomes the predicted one.

    Uncertain texts stay: a low score alone doesn't tell a mixed text from a bad one. Repeated
    rows are judged each. Without a row that has a language and letters, nothing is learned and
    every row goes. An empty table gives an empty one.
    """
    found = identify(docs)
    return found.where(F.col("lang_pred") != "und").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that stand on LINE_SITES sites or more but where they stand first; texts left without a word go.

    A null source is a site of its own. Null and empty texts have no line to lose and stay;
    rows that repeat id and text are treated alike. An empty table gives an empty one.
    """
    left = dedup_lines(docs, min_sites=LINE_SITES).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group.

    Rows that repeat an id belong to one group, and those of them that stay all stay, but of
    rows equal in id and text only the one with the least lang, source and n_chars. Rows
    without an id stay, as they belong to no group, and so do empty texts.
    """
    judged = written(near_duplicates(docs).select("doc_id", "kept"), "judged")
    twice = judged.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    twice = written(twice, "twice")
    gone = judged.where(~F.col("kept")).select("doc_id").union(twice).distinct()
    stay = twice.join(judged.where("kept").select("doc_id").distinct(), "doc_id")
    of = docs.join(stay, "doc_id", "left_semi").groupBy("doc_id", F.xxhash64("text").alias("digest"), F.col("text").isNull().alias("blank"))
    one_each = of.agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("one")).select("doc_id", "one.*")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*COLUMNS).unionByName(one_each.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold half the words of a benchmark item or more, or a verbatim excerpt of fifty.

    Null and empty texts hold nothing and stay. Repeated rows are judged each; a null id is
    judged by its text. Empty documents or an empty benchmark drop nothing.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return judge_contamination(docs, items).where(~F.col("contaminated")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources up to four times, in mixed order by position.

    A null source is a source of its own; null and empty texts come with every pass of theirs.
    Rows that repeat id, text and source come each, at one position. An empty table gives an empty one.
    """
    return mix_sources(docs).select(*COLUMNS, "epoch", "block", "position")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: Trained and hashed stages have no SQL form; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder.

    Once a stage's result is written, the intermediate tables it was made from are deleted.
    """
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), written_so_far(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        drop_written(spark, since=mark, but=1)
    return STAGES[-1][1](spark, docs, sf_dir)
