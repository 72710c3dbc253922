"""Connected components of a graph given as links, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import compact, settled


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for each node of a link; a component's name is its least node.

    In a round each label takes the least label of its node's neighbours, then the label of
    that label; rounds end when no label changes. Links of a node with many are summed up
    before they meet. Null ends and links of a node to itself are left out."""
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = compact(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = compact(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
    for _ in range(rounds):
        near = both.join(labels.withColumnsRenamed({"node": "v"}), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        low = compact(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low")))
        over = low.select(F.col("node").alias("low"), F.col("low").alias("next"))
        new = settled(low.join(over, "low", "left").select("node", F.least("low", F.coalesce("next", F.col("low"))).alias("label"), F.col("label").alias("old")))
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("components didn't settle")
