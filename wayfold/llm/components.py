"""Connected components of an edge table by minimum labels, hooked roots and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.scratch import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every id in ``edges`` (a, b): comp is the smallest id reachable.

    Each round sends the smallest label among an id's neighbours to the id and to the id that is its label (its
    root), then every id takes the label of its label.  A region so moves as a whole once one of its ids meets a
    smaller label.  Labels only fall and are ids of the component, so rounds end; they go on until nothing changes.
    Every round is a stored table, those of the round before are deleted.  No edges: no rows.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("comp"))
    labels = stored(labels)
    while True:
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        offers = stored(labels.join(seen, "id").select("id", "comp", F.least("comp", "near").alias("low")))
        hooked = offers.groupBy(F.col("comp").alias("id")).agg(F.min("low").alias("root_low"))
        step = stored(offers.join(hooked, "id", "left").select("id", F.col("comp").alias("was"), F.least("low", "root_low").alias("c")))
        jump = step.select(F.col("id").alias("c"), F.col("c").alias("c2"))
        new = stored(step.join(jump, "c", "left").select("id", "was", F.least("c", "c2").alias("comp")))
        dropped(offers, step, labels)
        labels = new.select("id", "comp")
        if new.where("was <> comp").isEmpty():
            return labels
