"""Spark helpers of the operators: tables, lineage cuts in the shared folder, partition counts, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows that Spark puts into an Arrow batch for the operators over texts (its own default is 10,000, tens of MB).
ROWS_PER_BATCH = 1000


def small_batches(spark: SparkSession) -> SparkSession:
    """Let Arrow batches hold at most ``ROWS_PER_BATCH`` rows in this session, so that a batch of long texts stays small
    in the executor and in its Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > ROWS_PER_BATCH:
        spark.conf.set(name, str(ROWS_PER_BATCH))
    return spark


def materialise(df: DataFrame) -> DataFrame:
    """Written once to the shared checkpoint folder and read from there by all that follows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def smallest_reachable(links: DataFrame) -> DataFrame:
    """The smallest label that each node reaches: links (a, b) → (node, root), for nodes that have a link.

    Min-label propagation with pointer jumping.  Each round takes the least label among a node and its neighbours
    (a join and a partial/final aggregate), then replaces a label by that label's own label, so the rounds grow with the
    logarithm of a component's width.  Each round is written to the shared checkpoint folder; only a count of changed
    labels reaches the driver.
    """
    both = materialise(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct())
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"))
    label = materialise(label)
    while True:
        seen = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(seen, label["node"] == seen["a"]).select(
            "node", "root", F.least("root", "near").alias("next"))
        up = label.select(F.col("node").alias("parent"), F.col("root").alias("above"))
        step = step.join(up, step["next"] == up["parent"], "left").select(
            "node", "root", F.least("next", F.coalesce("above", "next")).alias("next"))
        step = materialise(step)
        if not step.where("next != root").limit(1).count():
            return step.select("node", "root")
        label = step.select("node", F.col("next").alias("root"))
