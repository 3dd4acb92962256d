"""Connected components by alternating large-star and small-star steps; links stay on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, hot_values, salted_join


def _large_star(edges: DataFrame, hubs: list) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    # A vertex needs its least neighbour for the larger ones only.
    return salted_join(both.where("b > a"), least, "a", hubs, F.xxhash64("b"), how="inner").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex has few lesser neighbours after a large star, so none is hot here."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """edges (a, b) -> one row (a, root) for every vertex that is not the least of its component.

    Null ends are ignored. Each round is written to the shared folder; the driver sees a count, a checksum and the vertices that many links end in, which joins salt.
    Rounds grow with the logarithm of the longest chain of links.
    """
    now = cut(edges.where("a <> b").select("a", "b").distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        hubs = hot_values(now.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").count(), "v", "count", least=200)
        new = cut(_small_star(_large_star(now, hubs)).where("a <> b").distinct(), "stars")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now, last, mark = new, mark, tuple(seen)
        if mark == last or not seen[0]:
            return now.select("a", F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def named_components(reps: DataFrame, root: DataFrame) -> DataFrame:
    """reps (fp, least id) and the roots of linked ones -> fp, component_id: the least id of the component. A large component's root is a hot key."""
    placed = cut(reps.join(root.withColumnRenamed("a", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    hot = hot_values(least, "root", "n", least=200)
    return salted_join(placed.select("fp", "root"), least.drop("n"), "root", hot, F.xxhash64("fp"), how="inner").select("fp", "component_id")
