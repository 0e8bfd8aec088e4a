"""Connected components of a link table, by alternating star contractions.

Each round hangs the larger neighbours of every node, and then its smaller ones, below the smallest of
them; the links end as stars around the smallest node of each component after a number of rounds that
grows with the logarithm of the nodes. Minima are aggregated before the shuffle, and rounds are staged,
so a hub of any degree and a lost executor do no harm. Nothing but one number per round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitgauge.staging import stage


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Link the larger (or all smaller-side) neighbours of each node to the least node around it."""
    if larger:
        sides = links.union(links.select("b", "a")).toDF("node", "near")
    else:
        sides = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("near"))
    least = sides.groupBy("node").agg(F.min("near").alias("low")).select(
        F.col("node").alias("of"), F.least("node", "low").alias("low")
    )
    around = sides.join(least, F.col("node") == F.col("of"))
    moved = around.filter(F.col("near") > F.col("node")) if larger else around
    out = moved.select(F.col("near").alias("a"), F.col("low").alias("b"))
    if not larger:
        out = out.union(least.select(F.col("of").alias("a"), F.col("low").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the component's smallest node."""
    now = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    mark = None
    while True:
        now = stage(_star(_star(now, larger=True), larger=False), "links")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select("b", "b").distinct()
    )
