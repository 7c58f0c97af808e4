"""Connected components of a link table, by minimum labels with pointer jumping; nothing goes to the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """links: a long, b long. One row per node that has a link: node, label (the smallest node of its component).

    Each round, every node takes the smallest label among itself and its neighbours, then the label of that label. Rows
    are aggregated before they are shuffled, so a node with very many neighbours is no hot spot. Self-links and repeated
    links are harmless; an empty table gives an empty one.
    """
    edges = cut(links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("other")).select("node", F.least("node", "other").alias("label")))
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lowered = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        # a root that a member saw a smaller label for must learn of it too
        hooked = lowered.where("mid < old").groupBy(F.col("old").alias("root")).agg(F.min("mid").alias("hook"))
        jump = lowered.join(hooked, F.col("node") == F.col("root"), "left").select("node", "old", F.least("mid", F.coalesce("hook", "mid")).alias("mid"))
        target = jump.select(F.col("node").alias("at"), F.col("mid").alias("beyond"))
        moved = cut(jump.join(target, F.col("mid") == F.col("at"), "left").select("node", "old", F.least("mid", F.coalesce("beyond", "mid")).alias("label")))
        changed = moved.where("label <> old").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels
