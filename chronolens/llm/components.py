"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, named, written


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b; long); root is the smallest node reachable.

    Large-star and small-star steps in turn until nothing changes (Kiveris et
    al. 2014); the number of rounds grows with the logarithm of the longest
    path. Each step keeps at most as many edges as it was given. Every round is
    a table in the shared folder. Minima are aggregated before the shuffle, and
    hot nodes meet them in a join that the engine may split. Loops, repeated
    edges and edges with null are allowed; null ends are left out. No edges: no rows.
    """
    now = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        then = written(small, label)
        dropped(now)
        new, now = _state(then), then
        if new == state:
            break
        state = new
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    return named(out, now)


def _state(edges: DataFrame) -> tuple[int, int | None]:
    r = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("h")).first()
    return r["n"], r["h"]
