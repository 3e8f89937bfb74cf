"""Connected components of a link table, as repeated joins with a checkpoint a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir


def components(links: DataFrame) -> DataFrame:
    """node, root from links a, b: root is the smallest node that can be reached.

    A round takes the smallest label among the neighbours and then the label's own label, so chains shorten by more
    than half. Only one row comes to the driver, if a label has changed. A round deals out the labels once: the three
    joins read them in the same shape, so Spark uses their exchange again.
    """
    ensure_checkpoint_dir(links.sparkSession)
    links = links.where("a <> b").distinct()
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = links.select(F.explode(ways).alias("l")).select("l.*").checkpoint()
    labels = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).select(F.col("a").alias("node"), "root").checkpoint()
    while True:
        at = lambda node, root, known=labels: known.select(F.col("node").alias(node), F.col("root").alias(root))
        near = both.join(at("b", "_their"), "b").groupBy("a").agg(F.min("_their").alias("_near"))
        new = at("node", "_old").join(near, F.col("node") == F.col("a")).select("node", F.least("_old", "_near").alias("_new"), "_old")
        new = new.join(at("_at", "_far"), F.col("_new") == F.col("_at"), "left").select("node", F.least("_new", F.coalesce("_far", "_new")).alias("root"), "_old").checkpoint()
        labels = new.drop("_old")
        if not new.where("root <> _old").take(1):
            return labels
