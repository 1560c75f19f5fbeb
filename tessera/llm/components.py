"""Connected components of a graph of links, by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import settle


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of ``links`` (a, b); label is the least node of the component.

    A round takes the least label among a node's neighbours and then the label of that
    label, so the number of rounds grows with the logarithm of a component's diameter. Every round
    ends in a written table. Minima are combined before the shuffle, so a node with very
    many links costs a row for each task; no link or label goes to the driver.
    """
    links = links.where("a <> b")
    both = settle(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("low"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("next"))
        made = settle(lower.join(jump, "low", "left").select("node", F.least("low", F.coalesce("next", "low")).alias("label"), "was"))
        labels = made.select("node", "label")
        if made.where("label <> was").isEmpty():
            return labels
