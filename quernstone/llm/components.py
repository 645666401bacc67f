"""Connected components of a graph held as a table of edges, by alternating stars.

Each round reads and writes one table of edges in the shared scratch folder. The minimum around a
node is aggregated before the shuffle; hot nodes meet it in a join whose partitions Spark can split.
No group of neighbours is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quernstone.support.cut import discard, scratch_path


def _written(edges: DataFrame, label: str) -> tuple[DataFrame, tuple]:
    """The table read back, and its number of rows and a hash of them."""
    seen = Observation()
    path = scratch_path(edges.sparkSession, label)
    mark = F.bit_xor(F.xxhash64("u", "v"))
    edges.observe(seen, F.count(F.lit(1)).alias("n"), mark.alias("mark")).write.parquet(path)
    return edges.sparkSession.read.schema("u long, v long").parquet(path), (
        seen.get["n"],
        seen.get["mark"],
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.filter("v > u")
    return larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has (u long, v long); returns (node, root), the least node reachable.

    Nodes without an edge to another node are not returned. Loops and repeated edges do no harm. Rounds go on while
    the edges change; each one brings nodes nearer to their least, and a path of n nodes takes some log2(n) squared.
    """
    current, seen = _written(edges.select("u", "v").filter("u != v").distinct(), "edges")
    while seen[0]:
        following, now = _written(_small_star(_large_star(current)), "edges")
        discard(current)
        settled, current, seen = now == seen, following, now
        if settled:
            break
    # Settled: every edge leads from a node straight to the least one.
    leaves = current.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
    return leaves.union(leaves.select(F.col("root").alias("node"), "root")).distinct()
