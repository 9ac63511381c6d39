"""Connected components of a link table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.support import written


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node reachable over links(a, b); only nodes with a link have rows.

    Each round takes the least label among neighbours, then follows labels of labels twice,
    so a chain of n nodes needs about log n rounds. Labels are written to the shared folder
    after each round; nothing but a count reaches the driver.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("next")).where("node <> next")
    both = written(both.union(both.select("next", "node")).distinct(), "links")
    labels = written(both.groupBy("node").agg(F.least(F.min("next"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "next"), "next").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        for _ in range(2):
            to = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
            step = step.join(to, "new").select("node", "label", F.least("new", "far").alias("new"))
        step = written(step, "labels")
        labels = step.select("node", F.col("new").alias("label"))
        if step.where("new <> label").isEmpty():
            return labels
