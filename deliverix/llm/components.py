"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliverix.llm.shared import written


def star_edges(members: DataFrame, node: str, hub: str) -> DataFrame:
    """Edges (u, v) that connect what shares a hub: a node to its smallest hub, and its other hubs to that one, each pair once.

    A node of many hubs is so one edge and some pairs of hubs, which its neighbours share.
    """
    hubs = members.groupBy(node).agg(F.collect_set(hub).alias("hubs")).select(F.col(node).alias("node"), "hubs", F.array_min("hubs").alias("v"))
    own = hubs.select(F.col("node").alias("u"), "v")
    between = hubs.select(F.explode("hubs").alias("u"), "v").distinct()
    return own.unionByName(between).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in the edges (u, v): label is the smallest node of its component.

    Each round a node points to the neighbour of the smallest scrambled number
    below its own, if there is one, and from there on to where that points; then
    edges are renamed to the ends of the pointers, and equal ones and loops go.  The
    first round takes the nodes as they are (stars around their smallest node are
    done with it); scrambled numbers, new in each further round, keep the paths short, so
    that the edges shrink by a factor each round whatever the graph.  Edges and pointers are tables in the shared
    folder: lost executors cost no more than a round.
    """
    edges = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        number = len(rounds)

        def key(node: str, number: int = number) -> F.Column:
            return F.struct((F.xxhash64(F.lit(number), node) if number else F.col(node)).alias("k"), F.col(node).alias("n"))

        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(key("v")).alias("low")).select("u", F.least(key("u"), "low")["n"].alias("to"))
        low = written(low, "pointers")
        on = low.select(F.col("u").alias("to"), F.col("to").alias("further"))
        low = written(low.join(on, "to").select("u", F.col("further").alias("to")), "pointers")
        ends = edges.join(low.withColumnRenamed("to", "a"), "u").join(low.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
        edges = written(ends.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        rounds.append(low)
    if not rounds:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = rounds[-1]
    for low in reversed(rounds[:-1]):  # each node of a round goes where the end of its pointer went later
        later = roots.select(F.col("u").alias("to"), F.col("to").alias("root"))
        roots = low.join(later, "to", "left").select("u", F.coalesce("root", "to").alias("to"))
    roots = written(roots, "roots")
    least = roots.groupBy("to").agg(F.min("u").alias("label"))
    return written(roots.join(least, "to").select(F.col("u").alias("node"), "label"), "labels")
