"""Lineage as a DataFrame of nodes (node_id, record_id, operation, parent_ids, seq)."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import LineageError
from ..functions.shared import settle

NODES = "node_id string, record_id string, operation string, parent_ids array<string>, seq long, metadata map<string,string>, checksum_before string, checksum_after string"


def linked(ops: DataFrame) -> DataFrame:
    """Operations without parents get the record's node before them. Windows are by record, whose nodes are as few as its steps."""
    before = F.lag("node_id").over(Window.partitionBy("record_id").orderBy("seq", "node_id"))
    auto = F.when(before.isNotNull(), F.array(before)).otherwise(F.array().cast("array<string>"))
    given = F.col("parent_ids") if "parent_ids" in ops.columns else F.lit(None).cast("array<string>")
    return ops.withColumn("parent_ids", F.coalesce(F.when(F.size(given) > 0, given), auto))


def of_records(records: DataFrame, operation: str, seq: int, before: Column | None = None, metadata: Column | None = None) -> DataFrame:
    """A node for each record."""
    return records.select(
        F.substring(F.sha2(F.concat_ws("\x1f", F.col("id"), F.lit(operation), F.lit(seq)), 256), 1, 32).alias("node_id"), F.col("id").alias("record_id"), F.lit(operation).alias("operation"),
        F.lit(None).cast("array<string>").alias("parent_ids"), F.lit(seq).cast("long").alias("seq"), (F.lit(None).cast("map<string,string>") if metadata is None else metadata).alias("metadata"),
        (F.lit("") if before is None else before).alias("checksum_before"), F.col("checksum").alias("checksum_after"),
    )


def history(nodes: DataFrame, record_id: str) -> DataFrame:
    return nodes.where(F.col("record_id") == record_id).orderBy("seq")


def node(nodes: DataFrame, node_id: str) -> dict:
    row = nodes.where(F.col("node_id") == node_id).first()
    if row is None:
        raise LineageError(f"no lineage node {node_id}")
    return row.asDict()


def parents(nodes: DataFrame, node_id: str) -> DataFrame:
    """Parents that exist; missing ones are left out."""
    want = nodes.where(F.col("node_id") == node_id).select(F.explode("parent_ids").alias("node_id")).distinct()
    return nodes.join(want, "node_id", "left_semi")


def trace(nodes: DataFrame, node_id: str) -> list[str]:
    """Node ids from the sources to node_id, each once, at any depth. A missing parent raises."""
    seen, level, order = {node_id}, [node_id], [(0, node_id)]
    for depth in itertools.count():
        rows = nodes.where(F.col("node_id").isin(level)).select("node_id", "parent_ids").collect()  # the ancestors of one node
        if missing := set(level) - {r[0] for r in rows}:
            raise LineageError(f"no lineage node {', '.join(sorted(missing))}")
        level = sorted({p for r in rows for p in r[1] or []} - seen)
        if not level:
            break
        seen.update(level)
        order += [(depth + 1, p) for p in level]
    return [n for _, n in sorted(order, key=lambda x: -x[0])]


@dataclass(frozen=True)
class Labels:
    """Reachability of a graph, by chains.

    places: node_id, chain, pos; a node reaches all of its chain before it. jumps: chain, pos, to_chain, to_pos, distance; a node at or after pos in chain reaches all of to_chain up to to_pos, directly or through further
    chains. A graph of chains alone has no jumps, so labels grow with its nodes; merges add a jump for each chain that they lead to.
    """

    places: DataFrame
    jumps: DataFrame


def labels(nodes: DataFrame, most_rounds: int = 30) -> Labels:
    """A record's nodes follow each other in a chain; one that does not derive from the node before it begins another. Parents that are no nodes are chains of their own.

    Jumps are closed by doubling: after k rounds they lead through up to 2 ** k chains. Of several ways between the same two places the shortest is kept.
    """
    w = Window.partitionBy("record_id").orderBy("seq", "node_id")
    before = F.lag("node_id").over(w)
    steps = nodes.select("node_id", "record_id", "seq", F.array_distinct(F.coalesce("parent_ids", F.array().cast("array<string>"))).alias("parent_ids"), before.alias("before"))
    steps = steps.withColumn("begins", (~F.coalesce(F.array_contains("parent_ids", F.col("before")), F.lit(False))).cast("int")).withColumn("nth", F.sum("begins").over(w))
    chain = F.concat_ws("\x1f", F.lit("r"), "record_id", "nth")
    steps = settle(steps.select("node_id", "parent_ids", "begins", "before", chain.alias("chain"), F.row_number().over(Window.partitionBy("record_id", "nth").orderBy("seq", "node_id")).alias("pos")))
    edges = steps.select("chain", "pos", F.explode(F.filter("parent_ids", lambda p: (F.col("begins") == 1) | (p != F.col("before")))).alias("parent"))
    known = steps.select("node_id", "chain", "pos")
    lost = edges.select(F.col("parent").alias("node_id")).distinct().join(known, "node_id", "left_anti")
    places = settle(known.union(lost.select("node_id", F.concat_ws("\x1f", F.lit("p"), "node_id"), F.lit(1))))
    ends = places.select(F.col("node_id").alias("parent"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"))
    key = ["chain", "pos", "to_chain", "to_pos"]
    jumps = settle(edges.join(ends, "parent").select(*key, F.lit(1).alias("distance")).distinct())
    size = None
    for _ in range(most_rounds):
        now = tuple(jumps.agg(F.count("*"), F.sum("distance")).first())
        if now == size or not now[0]:
            break
        size = now
        more = jumps.select(F.col("chain").alias("to_chain"), F.col("pos").alias("from"), F.col("to_chain").alias("far"), F.col("to_pos").alias("far_pos"), F.col("distance").alias("more"))
        through = jumps.join(more, "to_chain").where("from <= to_pos")
        through = through.select("chain", "pos", F.col("far").alias("to_chain"), F.col("far_pos").alias("to_pos"), (F.col("distance") + F.col("to_pos") - F.col("from") + F.col("more")).alias("distance"))
        jumps = settle(jumps.unionByName(through).groupBy(*key).agg(F.min("distance").alias("distance")))
    return Labels(places, jumps)


def _reached(starts: DataFrame, of: Labels) -> DataFrame:
    """node_id, ancestor_id and the least distance, for starts (node_id, chain, pos), themselves included."""
    own = starts.select("node_id", F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"), F.lit(0).alias("distance"))
    jumps = of.jumps.withColumnRenamed("pos", "from")
    far = starts.join(jumps, "chain").where("from <= pos").select("node_id", "to_chain", "to_pos", (F.col("distance") + F.col("pos") - F.col("from")).alias("distance"))
    ends = of.places.select(F.col("node_id").alias("ancestor_id"), F.col("chain").alias("to_chain"), F.col("pos").alias("at"))
    all_ = own.union(far).join(ends, "to_chain").where("at <= to_pos").select("node_id", "ancestor_id", (F.col("distance") + F.col("to_pos") - F.col("at")).alias("distance"))
    return all_.groupBy("node_id", "ancestor_id").agg(F.min("distance").alias("distance"))


def ancestors(of: Labels, node_id: str) -> DataFrame:
    """ancestor_id and distance of one node's ancestors, itself included, from the labels alone: no walk, and no more of them than its own chain's and those that this jumps to."""
    return _reached(of.places.where(F.col("node_id") == node_id), of).drop("node_id")


def trace_all(nodes: DataFrame, most_rounds: int = 30) -> DataFrame:
    """node_id, ancestor_id, distance (the least) of every node, itself included, read off the labels."""
    of = labels(nodes, most_rounds)
    starts = of.places.join(nodes.select("node_id").distinct(), "node_id", "left_semi")
    return _reached(starts, of)


def record_index(nodes: DataFrame) -> DataFrame:
    """record_id -> its node ids in order."""
    rows = nodes.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("seq", "node_id"))).alias("n"))
    return rows.select("record_id", F.col("n.node_id").alias("node_ids"))


def to_dict(nodes: DataFrame) -> dict:
    """The graph as plain data: nodes by id, and each record's node ids in order. Rows come to the driver a partition at a time; for graphs that fit it."""
    rows = [r.asDict() for r in nodes.orderBy("record_id", "seq", "node_id").toLocalIterator()]
    out: dict = {"nodes": {r["node_id"]: r for r in rows}, "records": {}}
    for r in rows:
        out["records"].setdefault(r["record_id"], []).append(r["node_id"])
    return out
