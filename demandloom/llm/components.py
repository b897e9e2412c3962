"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import durable


def _followed(table: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """``table`` with each value of ``column`` replaced by its parent, if it has one."""
    return (
        table.join(parents.select(F.col("node").alias(column), "parent"), column, "left")
        .withColumn(column, F.coalesce("parent", column))
        .drop("parent")
    )


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; root is the smallest node reachable.

    Each round hangs every node below its smallest neighbour, follows the
    parents up to the top, and goes on with the links between the tops. Links
    are counted on the executors; no node or label comes to the driver. Links
    with a null end and links of a node to itself are no links. An empty
    ``links`` gives an empty table.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
        "a is not null and b is not null and a <> b"
    )
    links = durable(links.distinct())
    labels = durable(links.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    labels = labels.withColumn("root", F.col("node"))
    while not links.isEmpty():
        parents = durable(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")))
        while True:
            above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            jumped = durable(
                parents.join(above, "parent", "left").select(
                    "node",
                    F.coalesce("above", "parent").alias("parent"),
                    F.col("above").isNotNull().alias("moved"),
                )
            )
            parents = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        labels = durable(_followed(labels, "root", parents))
        links = _followed(_followed(links, "a", parents), "b", parents).where("a <> b")
        links = durable(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return labels
