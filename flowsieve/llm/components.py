"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.session import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is named by its least node.

    Union-find in rounds over tables: each component hooks onto its least neighbour, the chains that
    this makes are halved until they are flat, and links inside a component go. A round at least
    halves the components that still have links, so a hub or a long chain takes few rounds. Links are
    aggregated map-side by node and never gathered per node. Nulls are not expected.
    """
    a, b = F.col("a"), F.col("b")
    # Both ways of each link, and each node's way to itself.
    pairs = F.array(*[F.struct(x.alias("a"), y.alias("b")) for x in (a, b) for y in (a, b)])
    ways = links.select(F.explode(pairs).alias("way")).select("way.a", "way.b")
    labels = None
    while True:
        least = F.least("a", F.min("b")).alias("parent")
        parents = ways.groupBy("a").agg(least).withColumnRenamed("a", "node")
        parents = _flat(written(parents, "parents"))
        upper = parents.select(F.col("node").alias("component"), "parent")
        if labels is None:
            # The first round sees every node, by its way to itself.
            labels = parents.select("node", F.col("parent").alias("component"))
        else:
            above = F.coalesce("parent", "component").alias("component")
            labels = written(labels.join(upper, "component", "left").select("node", above), "labels")
        of_a, of_b = (parents.select(F.col("node").alias(x), F.col("parent").alias(f"p{x}")) for x in "ab")
        ways = ways.join(of_a, "a").join(of_b, "b").filter("pa <> pb")
        ways = ways.select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        if ways.isEmpty():
            return labels
        ways = written(ways, "links")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after more ``links`` (a, b), which may bring new nodes."""
    name_a, name_b = (labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    named = links.join(name_a, "a", "left").join(name_b, "b", "left")
    named = named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct()
    upper = components(written(named, "links")).select(F.col("node").alias("component"), F.col("component").alias("above"))
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    fresh = nodes.join(labels, "node", "left_anti").withColumn("component", F.col("node"))
    joined = labels.unionByName(fresh).join(upper, "component", "left")
    return written(joined.select("node", F.coalesce("above", "component").alias("component")), "labels")


def _flat(parents: DataFrame) -> DataFrame:
    """Every node's root, by pointing each node at its parent's parent until nothing moves."""
    while True:
        upper = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = parents.join(upper, "parent")
        if jumped.filter("above < parent").isEmpty():
            return parents
        parents = written(jumped.select("node", F.col("above").alias("parent")), "parents")
