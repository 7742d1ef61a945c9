"""Connected components of links between integer ids."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_explore.llm.tables import written


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id that is reachable) for the ends of all links ``a``, ``b``.

    Every round gives each vertex the smallest label of its neighbours and then the label of its label, so long
    chains shrink by halves. Rounds end when no label falls. Null ends and links from a vertex to itself are
    ignored; no links give no rows. Rounds go on from written tables: a checkpoint keeps Spark's size estimates, the
    product of its joins, whose digits would triple with every round.
    """
    links = links.select("a", "b").where("a <> b")
    edges = written(links.union(links.select("b", "a")).distinct())
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")))
    while True:
        seen = edges.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(
            F.min("component").alias("near"))
        near = labels.join(seen, "id").select("id", F.least("component", "near").alias("near"), "component")
        up = labels.select(F.col("id").alias("near"), F.col("component").alias("far"))
        new = written(near.join(up, "near").select(
            "id", F.least("near", "far").alias("component"), (F.least("near", "far") < F.col("component")).alias("fell")))
        moved = new.where("fell").limit(1).count()
        labels = new.select("id", "component")
        if not moved:
            return labels
