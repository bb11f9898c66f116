"""Connected components of a graph given as an edge table, by contraction.

Each round points every node to its smallest neighbour if that is smaller,
follows the pointers to their roots by doubling, and keeps the edges between
different roots. Smallest neighbours are folded in each task before the
shuffle, so a node with very many edges is no hot key. Every step is written
to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitae.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``edges`` (a long, b long); comp is its component's smallest node."""
    maps: list[DataFrame] = []
    left = edges.select("a", "b").where("a != b")
    while True:
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        up = materialize(both.groupBy("node").agg(F.min("other").alias("m"))
                         .select("node", F.least("node", "m").alias("comp")), "cc-up")
        while True:
            over = up.select(F.col("node").alias("n2"), F.col("comp").alias("c2"))
            up2 = materialize(up.join(over, F.col("comp") == F.col("n2"), "left")
                              .select("node", F.coalesce("c2", "comp").alias("comp"),
                                      (F.col("c2") != F.col("comp")).alias("moved")), "cc-jump")
            up = up2.select("node", "comp")
            if up2.where("moved").isEmpty():
                break
        maps.append(up)
        a = up.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        b = up.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        left = materialize(left.join(a, "a").join(b, "b").where("ca != cb")
                           .select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "cc-edges")
        if left.isEmpty():
            break
    out = maps[0]
    for later in maps[1:]:
        out = out.join(later.select(F.col("node").alias("n2"), F.col("comp").alias("c2")),
                       F.col("comp") == F.col("n2"), "left").select("node", F.coalesce("c2", "comp").alias("comp"))
    return out
