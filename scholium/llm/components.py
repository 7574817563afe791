"""Connected components of a list of links, without collecting any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.texts import written


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node it is connected with) for the nodes of ``links`` (columns a, b).

    Every round each node takes the smallest label of its neighbours, then the label of its label. Labels are
    aggregated before they are shuffled, so of a node with very many links a task sends one row; the join that hands it
    its neighbours' labels leaves such a node to adaptive execution, which splits it.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("comp")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "comp"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("comp").alias("least"))
        )
        taken = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "least").alias("comp"))
        above = labels.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        # A label is a node itself; its own label is as good as its label after this round, or better next time.
        jumped = taken.join(above, "comp").select("node", "old", F.least("comp", "above").alias("comp"))
        jumped = written(jumped, "labels")
        labels = jumped.select("node", "comp")
        if jumped.where("old <> comp").isEmpty():
            return labels
