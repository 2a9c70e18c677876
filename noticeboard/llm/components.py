"""Connected components of a link table by label propagation with pointer jumping."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from noticeboard.llm.tables import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b); label is the smallest node reachable. Each round writes its
    labels to the shared folder, so no lineage grows and nothing is gathered outside the executors."""
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .filter("a <> b").distinct(), "component-links")
    labels = stored(both.groupBy(F.col("a").alias("node"))
                    .agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        offered = (both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node"))
                   .agg(F.min("label").alias("offer")))
        lower = (labels.join(offered, "node", "left")
                 .select("node", F.col("label").alias("was"), F.least("label", "offer").alias("label")))
        jump = labels.select(F.col("node").alias("_at"), F.col("label").alias("_label"))
        nxt = stored(lower.join(jump, F.col("label") == F.col("_at"), "left")
                     .select("node", "was", F.least("label", "_label").alias("label")), "labels")
        if nxt.filter("label <> was").limit(1).count() == 0:
            return nxt.select("node", "label")
        labels = nxt.select("node", "label")


def merged_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components of the graph that labels already describe, with further links: only links between different
    components are worked on, as links between their labels."""
    own = [links.select(F.col(c).alias("node"), F.col(c).alias("label")) for c in ("a", "b")]
    known = stored(labels.union(own[0]).union(own[1]).groupBy("node").agg(F.min("label").alias("label")), "labels")
    ends = links.select("a", "b")
    for c in ("a", "b"):
        ends = ends.join(known.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")), c)
    between = ends.filter("label_a <> label_b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct()
    moved = connected_components(between).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return stored(known.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def star_components(links: DataFrame) -> DataFrame:
    """Components of links that are mostly stars: every node starts from its smallest neighbour, which leaves few
    links between different labels."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    return merged_components(near.select("node", F.least("node", "label").alias("label")), links)
