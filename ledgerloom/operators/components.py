"""Connected components of a link table, and the folder in which lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ready_to_checkpoint(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in spark.checkpoint.dir; where it is unset, a folder of our own on a single machine, and an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from it."""
    ready_to_checkpoint(df.sparkSession)
    return df.checkpoint()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is named by its smallest node.

    Every round each node takes the least label among its own, its neighbours' and that label's own label, so a chain of
    n nodes needs about log n rounds.  NULL ends make no link; repeated links and loops change nothing; nodes that are in no
    link don't appear.  Labels and links stay distributed; only the number of changed labels comes to the driver.
    """
    both = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    edges = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("label").alias("onward"))
        after = cut(moved.join(jump, "best", "left").select("node", F.least("best", F.coalesce("onward", "best")).alias("label"), F.col("label").alias("was")))
        changed = after.where("label <> was").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
