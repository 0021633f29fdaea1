"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pileflow.llm.common import Workspace


class Forest:
    """Union-find over local numbers: what a task needs to hand on a spanning forest in place of all its pairs."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def components(space: Workspace, edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, component): each node of an edge (a, b) but those that are their component's smallest.

    Every round points nodes at smaller neighbours, written to the shared folder to cut lineage; rounds grow as the
    logarithm of the number of nodes. Nothing but one count and one checksum a round reaches the driver.
    """
    now = space.write(edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), f"{name}0")
    last, k = None, 0
    while True:
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("x", "y") % (1 << 31)), F.lit(0))).first()
        if tuple(mark) == last or not mark[0]:
            return now.select(F.col("x").alias("node"), F.col("y").alias("component"))
        last, k = tuple(mark), k + 1
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        # every x has its smallest neighbour among its large stars
        down = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(down, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(down.select("x", F.col("m").alias("y"))).distinct()
        now = space.write(small, f"{name}{k}")
        if k > 1:
            space.drop(f"{name}{k - 2}")
