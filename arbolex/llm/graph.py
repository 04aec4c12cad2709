"""Connected components by contraction, all joins and aggregates distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolex.llm.common import stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node long, component long (the least node reachable), for every node of an edge.

    Each round hooks every node to its least neighbour (partial aggregates: a node with very many
    neighbours is no single group), follows that node's own hook, and contracts the edges to what is left
    between different labels. Node numbers should be hashes: then each round leaves a constant share of
    the nodes at most, so all rounds together cost little more than the first. Each round is two written
    tables; the rounds' maps are composed from the last to the first.
    """
    node = lambda e: e.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    rest = stored(node(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    maps: list[DataFrame] = []
    while not rest.isEmpty():
        both = rest.union(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.least("u", F.min("v")).alias("l"))
        jump = hook.select(F.col("u").alias("l"), F.col("l").alias("ll"))
        maps.append(stored(hook.join(jump, "l").select("u", F.col("ll").alias("l")), "labels"))
        labels = maps[-1]
        rest = rest.join(labels, "u").select(F.col("l").alias("a"), F.col("v").alias("u")).join(labels, "u").select(F.col("a").alias("u"), F.col("l").alias("v"))
        rest = stored(node(rest), "edges")
    if not maps:
        return rest.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = maps[-1]
    for earlier in reversed(maps[:-1]):
        out = earlier.join(out.select(F.col("u").alias("l"), F.col("l").alias("ll")), "l", "left").select("u", F.coalesce("ll", "l").alias("l"))
    return out.select(F.col("u").alias("node"), F.col("l").alias("component"))
