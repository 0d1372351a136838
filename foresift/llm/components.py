"""Connected components of a link table by least labels and pointer jumping; labels are stored after each round."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresift.llm.common import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """node, label (the least node that links reach) of every node in the pairs (a, b)."""
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
                         .select("node", F.least("node", "near").alias("label")))
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("heard"))
        moved = labels.join(heard, labels.node == heard.a, "left") \
            .select("node", "label", F.least("label", F.coalesce("heard", "label")).alias("next"))
        parent = labels.select(F.col("node").alias("parent"), F.col("label").alias("root"))
        after = materialise(moved.join(parent, F.col("next") == F.col("parent"), "left")
                            .select("node", F.least("next", F.coalesce("root", "next")).alias("new"), "label"))
        changed = after.where("new <> label").limit(1).count()
        labels = after.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
