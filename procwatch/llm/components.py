"""Connected components of a table of links, by contraction."""

from pyspark.sql import DataFrame, functions as F

from procwatch.session import materialize


def components(links: DataFrame) -> DataFrame:
    """`node` and `label`, the smallest node of its component, for every node of a link (a, b).

    Each round gives every label the smallest label it is linked to and maps the links to the
    new labels; links within a label vanish. Chains of labels are followed in the same way, so
    rounds grow with the logarithm of a component's width. All rounds are written, none is held.
    """
    ends = links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    open_links = materialize(ends.where("low <> high").distinct(), "links")
    nodes = open_links.select(F.explode(F.array("low", "high")).alias("node")).distinct()
    found = materialize(nodes.withColumn("label", F.col("node")), "labels")
    while open_links.limit(1).count():
        parent = materialize(_roots(open_links.groupBy("high").agg(F.min("low").alias("to"))), "parents")
        found = materialize(
            found.join(parent, found["label"] == parent["high"], "left")
            .select("node", F.coalesce("to", "label").alias("label")), "labels")
        a, b = (parent.select(F.col("high").alias(f"{x}_from"), F.col("to").alias(f"{x}_to")) for x in "ab")
        mapped = (open_links.join(a, F.col("low") == F.col("a_from"), "left")
                  .join(b, F.col("high") == F.col("b_from"), "left")
                  .select(F.coalesce("a_to", "low").alias("x"), F.coalesce("b_to", "high").alias("y")))
        open_links = materialize(
            mapped.select(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high"))
            .where("low <> high").distinct(), "links")
    return found


def _roots(parent: DataFrame) -> DataFrame:
    """Every label's parent replaced by its parent's parent: half the way to the root."""
    above = parent.select(F.col("high").alias("mid"), F.col("to").alias("top"))
    return (parent.join(above, parent["to"] == above["mid"], "left")
            .select("high", F.coalesce("top", "to").alias("to")))
