"""Connected components of a table of links, by alternating large and small stars.

Every round replaces each node's links by links to its least neighbour; rounds
go on until nothing changes, each written to the shared folder. Nothing but
two sums per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.llm._shared import materialize


#: Tasks that the links of one node are dealt to.
SALTS = 8


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) to rows (node, root): every node that has a link, and the least node it reaches."""
    turned = F.col("a") > F.col("b")
    now = links.filter("a <> b").select(F.when(turned, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("b")).distinct()
    now = materialize(now, "links-0")  # a > b
    before = _state(now)
    while before[0]:
        # large star: larger neighbours go to the least of node and neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # a node of very many links meets its least neighbour in several tasks
        spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rays = both.filter("b > a").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        large = rays.join(spread, ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: smaller neighbours, and the node, go to the least smaller one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = materialize(now.filter("a <> b").distinct(), "links")
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
