"""Connected components of a graph given by its links, with joins and aggregates only.

Every round, each node's neighbours are tied to the smallest node among it and them: first the larger neighbours, then
the smaller ones and the node itself.  Rounds end when the links are stars whose centre is the smallest node of a
component.  Minima are aggregated before they meet the links again, so a node with very many links is no single group
in a task.  The links of every round are checkpointed; nothing but three counters comes to the driver.  Few links take few
tasks a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import checkpointed, packed


def _star(links: DataFrame, large: bool, rows: int) -> DataFrame:
    """One half round over ``rows`` links ``u > v``."""
    around = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    smallest = packed(around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")), rows)
    tied = packed(around.join(smallest, F.col("u") == F.col("n")), rows)
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(smallest.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return packed(out.filter("u <> v").distinct(), rows)


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``links`` (columns a and b, whole numbers)."""
    edges = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = [F.count("*").alias("rows"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    before = edges.agg(*state).first()
    for _ in range(max_rounds):
        edges = packed(edges, before["rows"])
        edges = checkpointed(_star(_star(edges, True, before["rows"]), False, before["rows"]))
        # The links are stars, and a further round changes nothing, when their number and sums stay the same.
        now = edges.agg(*state).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
