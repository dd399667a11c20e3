"""Connected components of a graph that is too large for one machine: least labels along the links, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (src long, dst long) -> (id long, component long): for each id on a link, the smallest id reachable from it.

    Each round takes the least label of the neighbours, then the label of the label; both are aggregations that combine map-side,
    and each round is written to the shared folder. Links to itself and repeated links change nothing; null ends are dropped."""
    ends = links.where("src is not null and dst is not null")
    both = stored(ends.select("src", "dst").unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("id")).alias("component")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select("id", "component").withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        least = labels.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        least = stored(least, "least")
        jump = least.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = stored(least.join(jump, "component", "left").select("id", "was", F.least("component", "next").alias("component")), "labels")
        discard(least, labels)
        if not new.where("was <> component").limit(1).count():
            discard(both)
            return new.select("id", "component")
        labels = new
    raise RuntimeError(f"the components have not settled in {most_rounds} rounds")
