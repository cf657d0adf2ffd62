"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut

#: Edges that one task of a round takes. A round over one partition needs no shuffle.
ROWS_PER_TASK = 500_000


def _ends(edges: DataFrame, a: str, b: str) -> DataFrame:
    """u, v: every edge in both directions."""
    there = F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    back = F.struct(F.col(b).alias("u"), F.col(a).alias("v"))
    return edges.select(F.explode(F.array(there, back)).alias("e")).select("e.u", "e.v")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (the least node reachable) for every node of an undirected edge table.

    Alternating large-star and small-star steps: each is one aggregate per node and
    one equi-join, so a node with very many neighbours is pre-aggregated and its join
    can be split. The lineage is cut every round; the rounds end when no edge changes.
    Edges with a null end and self-loops that stand alone give no row of their own
    except (node, node) for the loop.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    loops = pairs.filter("u = v").select(F.col("u").alias("node")).distinct()
    cur = cut(pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = (cur.count(),)
    while True:
        tasks = max(1, -(-seen[0] // ROWS_PER_TASK))
        cur = cur.coalesce(tasks)
        both = _ends(cur, "u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if tasks == 1:
            large = large.coalesce(1)  # a join hides from Spark that its rows are in one partition
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        cur = cut(small.select("e.u", "e.v").filter("u <> v").distinct())
        state = tuple(cur.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen:
            break
        seen = state
    roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)
