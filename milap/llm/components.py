"""Groups from pairwise links, by hash-to-min.

Each vertex keeps a set of the vertices it knows of. In a round it sends the whole set to the set's smallest member, and that
smallest member to all the others; the union of what arrives is its new set. When nothing changes, the smallest vertex of a group
knows the whole group and every other vertex knows the smallest. The number of rounds grows with the logarithm of a group's
diameter. Sets are rows ``(v, u)``, never arrays, so a group of any size is spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milap.session import stage


def hash_to_min(links: DataFrame, a: str, b: str, max_rounds: int = 60, light: int = 0) -> DataFrame:
    """``(node, group_id)`` for every node with a link to another node; ``group_id`` is the group's smallest node.

    Links have no direction. Repeated links count once; links with a null end and from a node to itself say nothing and are
    dropped; an empty table gives no groups. ``RuntimeError`` if ``max_rounds`` don't suffice. ``light``: as in ``stage``.
    """
    pair = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).cast("long").alias("v"), F.col(b).cast("long").alias("u"))
    # the first round from the links themselves: a vertex and its smaller and larger neighbours
    known = stage(pair.select(F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")))).alias("x")).select("x.*").distinct(), "known", light)
    before = None
    for _ in range(max_rounds):
        least = known.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        both = lambda x, y: F.array(F.struct(F.col(x).alias("v"), F.col(y).alias("u")), F.struct(F.col(y).alias("v"), F.col(x).alias("u")))
        sent = known.join(least, "v").select(F.explode(both("m", "u")).alias("x")).unionByName(least.select(F.explode(both("m", "v")).alias("x"))).select("x.*")
        known = stage(sent.where("v <> u").distinct(), "known", light)
        now = tuple(known.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"groups are not stable after {max_rounds} rounds")
    # now u < v says that u is the smallest of v's group
    smaller = known.where("u < v").select(F.col("v").alias("node"), F.col("u").alias("group_id"))
    return smaller.unionByName(smaller.select(F.col("group_id").alias("node"), "group_id").distinct())
