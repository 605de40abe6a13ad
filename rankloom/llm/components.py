"""Connected components by alternating large-star and small-star steps, all on executors.

Each step moves every node next to the smallest node it knows; a number of steps logarithmic in the number
of nodes leaves one star for each component.  Each step is cut into the checkpoint folder, so lineage stays
short and lost executors cost one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, PART_ROWS, cut, lookup, partitions

#: Bytes of a node with its minimum, and room.
NODE_BYTES = 64


#: Edges of a node from which these are dealt out over `SALTS` tasks.
HUB, SALTS = 100_000, 64


def _with_least(edges: DataFrame, n_edges: int, bound: int | None) -> DataFrame:
    """Each edge (u, v) with `m`, the least v of its u, or u if that is less.

    The minima, a row for each node, are counted map-side and sent to the edges while the nodes are few enough.
    Beyond that both are joined by node, and the edges of hubs, of which there are few, are dealt out by v.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    if 2 * n_edges * NODE_BYTES <= (BROADCAST_BYTES if bound is None else bound):
        return edges.join(F.broadcast(least.drop("n")), "u")
    least = cut(least)
    hubs = least.where(F.col("n") > HUB)
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    dealt = least.withColumn("salt", F.explode(F.when(F.col("n") > HUB, salts).otherwise(F.array(F.lit(0))))).drop("n")
    marked = lookup(edges, hubs.select("u", F.lit(True).alias("hub")), ["u"], bound=BROADCAST_BYTES)  # 2 * edges / HUB rows at most
    salt = F.when(F.col("hub"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0)
    return marked.withColumn("salt", salt).join(dealt, ["u", "salt"]).select("u", "v", "m")


def _large_star(edges: DataFrame, n_edges: int, bound: int | None) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * n_edges, bound).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n_edges: int, bound: int | None) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    met = _with_least(down, n_edges, bound)
    # An edge to the least node stays, the others move to it.
    return met.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, bound: int | None = None) -> DataFrame:
    """(node, root): the smallest node of its component for each node that has an edge other than to itself.

    `edges` has the long columns u and v, in any direction, repeats and loops allowed.
    """

    def step(made: DataFrame) -> tuple[DataFrame, tuple]:
        made = cut(made, thin)
        return made, _state(made)

    parts = partitions(edges.sparkSession)
    thin = 8
    edges, state = step(_small_star(edges, edges.count(), bound))
    while state[0]:
        thin = max(1, parts // -(-state[0] // PART_ROWS))  # partitions follow the edges left
        edges, new = step(_small_star(_large_star(edges, state[0], bound), state[0], bound))  # neither step makes more edges
        if state == (state := new):
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
