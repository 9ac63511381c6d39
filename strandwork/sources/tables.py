"""Adapters: a directory of Parquet tables as files, tasks and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_path() -> Column:
    """source/lang/doc_id.txt"""
    return F.concat_ws("/", F.col("source"), F.col("lang"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text, lang, source, doc_id) of all documents."""
    return table(spark, sf_dir, "documents").select(document_path().alias("path"), "text", "lang", "source", "doc_id")


def capitalised(text: Column) -> Column:
    """Distinct capitalised ASCII words in order, the symbols of a document."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Z][a-z]+"), F.lit(0)))


def inline(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def spread(spark: SparkSession, sf_dir: str, schema: str, rows: list[tuple]) -> DataFrame:
    """The rows as every supplier's own: its number stands for {n} in texts, and integer ids are a hundred times it and more.

    Suppliers are dealt to all cores first: a small file is read in one piece, but what is made of
    it is a lot of work. The rows are joined to each supplier as a table of unknown size, so that
    Spark doesn't take what is made of them for as small as the suppliers' file and send it whole
    to the driver for a join: it goes by the sizes that it meets when it runs.
    """
    kinds = spark.createDataFrame([], schema).schema
    shapes = F.broadcast(spark.createDataFrame(rows, kinds).coalesce(1))
    found = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("__n")).repartition(spark.sparkContext.defaultParallelism, "__n").crossJoin(shapes)
    number = F.col("__n").cast("string")

    def own(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            return F.replace(c, F.lit("{n}"), number).alias(f.name)
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            return F.transform(c, lambda x: F.replace(x, F.lit("{n}"), number)).alias(f.name)
        whole = isinstance(f.dataType, (T.IntegerType, T.LongType)) and f.name.endswith("id")
        return (F.col("__n") * 100 + c).cast(f.dataType).alias(f.name) if whole else c.alias(f.name)

    return found.select(*[own(f) for f in kinds])
