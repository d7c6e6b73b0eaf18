"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapwright.storage import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for each end of ``links`` (a, b: long): the least id that can be reached.

    Every round gives each vertex the least label among its neighbours, then the label of that label, and writes the
    labels to the shared folder. Sums over a hot vertex are partial before the shuffle. The number of rounds grows
    with the logarithm of the longest path.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        hooked = labels.select("id", "component").join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("m"))
        # a label's own label: roots keep theirs
        jumped = hooked.join(labels.select(F.col("id").alias("m"), F.col("component").alias("up")), "m", "left")
        new = materialize(jumped.select("id", "old", F.least("m", F.coalesce("up", "m")).alias("component")), "labels")
        if new.where("old <> component").isEmpty():
            discard(both, labels)
            return new.select("id", "component")
        discard(labels)
        labels = new
