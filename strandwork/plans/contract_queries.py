"""The contract plan over evidence that is made from orders and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.operators import contract, ranking
from strandwork.plans.registry import query
from strandwork.sources.tables import table

KINDS = ("model", "domain_flow", "schema", "persistence_crud", "transport", "ui", "tests")


def item_evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(candidates, owners, support, constraints) of tasks that are groups of suppliers: parts are definitions, their sizes files.

    A line's number is its requirement, the sum of its part and order the kind. Lines that came back whole
    are owners, or fixtures of a tax's suite; the dearest lines are support.
    """
    item = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_extendedprice")
    task = (F.col("l_suppkey") % 10).cast("int")
    path = F.concat(F.lit("F"), (F.col("l_partkey") % 7).cast("string"), F.lit(".py"))
    name = F.concat(F.lit("d"), F.col("l_partkey").cast("string"))
    item = item.select(task.alias("task_id"), (F.col("l_linenumber") * 6 + F.col("l_orderkey") % 6).cast("int").alias("req_no"), path.alias("path"), name.alias("name"), F.pmod(F.col("l_partkey") + F.col("l_orderkey"), F.lit(len(KINDS))).cast("int").alias("kind_no"), F.col("l_quantity").cast("int").alias("q"), "l_returnflag", F.col("l_orderkey").cast("int").alias("o"), F.col("l_extendedprice").cast("long").alias("price"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    own = ["task_id", "req_no", "kind_no", "path", "name"]
    found = ranking.dealt(item.where("l_returnflag <> 'R'"), "task_id", "path", "name").groupBy(*own).agg((F.max("q") * 7).cast("int").alias("score"), F.min("q").alias("lines"))
    found = found.withColumns({"kind": F.get(kinds, F.col("kind_no")), "limit": F.lit(1) + F.col("kind_no") % 2})
    back = item.where("l_returnflag = 'R' AND o % 29 = 0").groupBy("task_id", "req_no", "path", "name").agg(F.min("o").alias("nth"), F.min("q").alias("q"))
    kind = F.when(F.col("q") % 4 == 0, "fixture").when(F.col("q") % 4 == 1, "tests").otherwise("ui")
    owners = back.select("task_id", "req_no", kind.alias("kind"), "nth", F.when(F.col("q") % 4 == 3, 1).otherwise(0).alias("companion"), "path", "name", F.concat(F.lit("S"), (F.col("q") % 3).cast("string")).alias("owner"))
    dear = item.where("price % 41 = 0").groupBy("task_id", "path", "name").agg(F.min("o").alias("pos"))
    support = dear.withColumn("coverage", F.col("pos") % 2 == 0)
    return found, owners, support, item.where("req_no % 11 = 0").select("task_id", "req_no").distinct()


@query()
def q_contract_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that requirements claim under shared quotas, as mandatory, priority and support, with who claimed them."""
    return contract.contract_plan(*item_evidence(spark, sf_dir))
