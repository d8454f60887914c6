"""Connected components of an undirected graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm.scratch import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each node of ``links`` (a, b); component is the smallest node reachable.

    Large-star and small-star steps by turns (Kiveris et al., 2014): each node's larger
    neighbours, then its smaller ones, are linked to its smallest. Minima are aggregated
    before they shuffle, and no neighbourhood is gathered, so a node may have any degree. It
    ends when no node has two smaller neighbours, or both a smaller and a larger one: then all
    edges are those of stars. A node that is linked with nothing but itself is its own
    component. Nulls are left out. ``links`` is read twice.
    """
    ordered = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    given = links.where("a is not null and b is not null").select("a", "b")
    alone = given.where("a = b").select("a").distinct()
    edges = materialize(ordered(given.where("a <> b")), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        below, above = F.count_if(F.col("b") < F.col("a")), F.count_if(F.col("b") > F.col("a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), below.alias("below"), above.alias("above"))
        least = materialize(least, "least")
        if least.where("below > 1 or (below = 1 and above > 0)").isEmpty():
            break
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(ordered(large.where("a <> b")), "edges")
        least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b")))
        edges = materialize(ordered(small.where("a <> b")), "edges")
    # of stars, each node's least neighbour or itself is the centre
    linked = least.select(F.col("a").alias("node"), F.col("m").alias("component"))
    rest = alone.join(least.select("a"), "a", "left_anti").select(F.col("a").alias("node"), F.col("a").alias("component"))
    return materialize(linked.unionByName(rest), "components")
