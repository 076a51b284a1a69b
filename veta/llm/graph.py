"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veta.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in the links (a, b); ids of one component share their root, which is one of them.

    Each round points every id at the neighbour (or itself) that comes first in a hashed order, replaces both ends of
    each link by what they point at and drops links that have become loops.  A hashed order shortens chains by a
    constant factor a round, whatever the ids are.  Rows a round: one an id and one a link; minima are combined before
    the shuffle, so a hub costs one row a task.  Each round is written to the checkpoint folder.
    """
    edges = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    rounds = []
    while not edges.isEmpty():
        ends = edges.union(edges.select("b", "a")).toDF("id", "other")
        first = F.min(F.struct(F.xxhash64("other").alias("h"), F.col("other").alias("v")))
        own = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("v"))
        to = materialise(ends.groupBy("id").agg(first.alias("m")).select("id", F.least("m", own)["v"].alias("root")))
        rounds.append(to)
        left, right = to.toDF("a", "x"), to.toDF("b", "y")
        moved = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = materialise(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not rounds:
        return edges.toDF("id", "root")
    found = rounds[0]
    for to in rounds[1:]:
        found = found.join(to.toDF("root", "next"), "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    return materialise(found)
