"""Connected components of a link table, by least labels and shortcuts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.sources import scratch


def components(links: DataFrame) -> DataFrame:
    """links: a, b (longs). Returns id, component: the least id that each linked id reaches.

    Each round takes the least label among neighbours, then the label of that label, so labels also travel over paths
    twice as long every round; rounds end when no label changes. Only counts come to the driver.
    """
    edges = scratch.cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = scratch.cut(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        lower = scratch.cut(lower, "lower")
        above = lower.select(F.col("id").alias("label"), F.col("label").alias("top"))
        after = scratch.cut(lower.join(above, "label").select("id", F.least("label", "top").alias("label"), (F.least("label", "top") < F.col("was")).alias("moved")), "labels")
        if after.filter("moved").isEmpty():
            return after.select("id", F.col("label").alias("component"))
        labels = after.select("id", "label")
