"""Connected components of links by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locengine.config import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """(node, least): larger neighbours (large) or the node and its smaller ones meet the least."""
    both = links.select("a", "b")
    if large:
        both = both.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select(F.col("a"), F.least("a", "m").alias("m"))
    moved = both.join(least, "a")
    if large:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links (a, b); label is the component's smallest node.

    Links may come in either direction and repeated; self links and null ends give no row.
    Node ids may be of any ordered type. Each round is written to the shared folder; the
    number of rounds grows with the logarithm of a component's size.
    """
    now = links.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    now = materialise(now, "links")
    while True:
        stars = materialise(_star(_star(now, large=True), large=False), "stars")
        # Done when each node has one link, to a node that has none to a smaller one.
        per = stars.groupBy("a").count().where("count > 1").limit(1)
        open_ = stars.select("a").join(
            stars.select(F.col("b").alias("a")).distinct(), "a", "left_semi"
        )
        if per.isEmpty() and open_.limit(1).isEmpty():
            break
        now = stars
    roots = stars.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
