"""Ollivier-Ricci curvature of the edges of simple graphs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import percentage
from loomgraph.operators import graph
from loomgraph.session import cut_lineage

FLAT, LEAST = 0.05, 1e-12
#: Neighbours' neighbours that a task goes through over all its edges.
WORK = 8_000_000


def greedy_transport(costs: np.ndarray) -> float:
    """Cost of moving a uniform mass of rows to one of columns, cheapest pairs first; ties by row, then column."""
    rows, columns = costs.shape
    left, room, total = np.full(rows, 1 / rows), np.full(columns, 1 / columns), 0.0
    for at in np.argsort(costs, axis=None, kind="stable"):
        i, j = divmod(int(at), columns)
        flow = min(left[i], room[j])
        if flow > LEAST:
            total += flow * costs[i, j]
            left[i] -= flow
            room[j] -= flow
    return total


def edge_curvature(u: list, v: list, adjacent: dict) -> float:
    """1 - transport cost between the neighbours u and v of an edge's ends; 0 if an end has none."""
    if not len(u) or not len(v):
        return 0.0
    in_u, in_v = set(u), set(v)
    costs = np.array([[0 if a == b else 1 if b in adjacent.get(a, ()) else 2 if b in in_u or a in in_v else 3 for b in v] for a in u], float)
    return 1.0 - greedy_transport(costs)


def _move(left: list, room: list, rows: list, columns: list, cost: int, total: float) -> float:
    """total and the cost of what moves between all of rows and columns in order, each step using one of them up."""
    at = 0
    for i in rows:
        while at < len(columns) and left[i] > LEAST:
            flow = min(left[i], room[columns[at]])
            total += flow * cost
            left[i] -= flow
            room[columns[at]] -= flow
            at += room[columns[at]] <= LEAST
    return total


def _transport(n_rows: int, n_columns: int, shared: tuple[list, list], ones: tuple[list, list]) -> float:
    """greedy_transport of costs of which those of 0 (shared) and 1 (ones) are listed, row by row. Those of 2 lie in
    the rows and columns of shared; as every step before used up a row or column, that of cost 2, then 3, may take
    in all costs up to its own. The steps are the same and in the same order."""
    left, room, total = [1 / n_rows] * n_rows, [1 / n_columns] * n_columns, 0.0
    for i, j in zip(*shared, strict=True):
        flow = min(left[i], room[j])
        left[i] -= flow
        room[j] -= flow
    for i, j in zip(*ones, strict=True):
        if left[i] > LEAST and room[j] > LEAST:
            flow = min(left[i], room[j])
            total += flow
            left[i] -= flow
            room[j] -= flow
    live = lambda mass, of: [x for x in of if mass[x] > LEAST]
    if shared[0]:  # the shorter side's masses are the larger, so the other's shared ones are used up
        rows, columns = (shared[0], range(n_columns)) if n_rows <= n_columns else (range(n_rows), shared[1])
        total = _move(left, room, live(left, rows), live(room, columns), 2, total)
    return _move(left, room, live(left, range(n_rows)), live(room, range(n_columns)), 3, total)


def _of_block(edges: pa.Table, near: pa.Table) -> pa.Table:
    """Costs and curvature of a block of edges, each found from the neighbours of the neighbours of its end `ego`."""
    lists = near["near"].combine_chunks()
    flat, sizes = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    ids, flat = np.unique(flat, return_inverse=True)  # neighbours all, so every node is one of them
    start = np.zeros(len(ids) + 1, np.int64)
    size = np.zeros(len(ids), np.int64)
    own = np.searchsorted(ids, near["node"].to_numpy())
    size[own], start[own] = sizes, np.cumsum(sizes) - sizes
    place = np.full(len(ids), -1)
    s, d, ego = (np.searchsorted(ids, edges[c].to_numpy()) for c in ("s", "d", "ego"))
    counts, curved, last = np.zeros((len(s), 4), np.int64), np.zeros(len(s)), -1
    for e in np.argsort(ego, kind="stable"):
        x, other = ego[e], d[e] if ego[e] == s[e] else s[e]
        if x != last:
            last, around = x, flat[start[x] : start[x] + size[x]]
            far = np.concatenate([flat[start[y] : start[y] + size[y]] for y in around])
            owner = np.repeat(np.arange(len(around)), size[around])
        there = flat[start[other] : start[other] + size[other]]
        place[there] = np.arange(len(there))
        met = place[far]
        hit = np.flatnonzero(met >= 0)
        i, j = owner[hit], met[hit]
        both = place[around]
        place[there] = -1
        shared = np.flatnonzero(both >= 0), both[both >= 0]
        if x == d[e]:
            order = np.lexsort((i, j))
            i, j, shared, r, c = j[order], i[order], shared[::-1], len(there), len(around)
        else:
            r, c = len(around), len(there)
        n0, n1 = len(shared[0]), len(i)
        in_rows, in_columns = np.zeros(r, bool), np.zeros(c, bool)
        in_rows[shared[0]], in_columns[shared[1]] = True, True
        n2 = n0 * (r + c - n0) - n0 - np.count_nonzero(in_rows[i] | in_columns[j])
        counts[e] = n0, n1, n2, r * c - n0 - n1 - n2
        curved[e] = 1.0 - _transport(r, c, (shared[0].tolist(), shared[1].tolist()), (i.tolist(), j.tolist()))
    return pa.table([edges["group_id"], edges["lo"], edges["hi"], *counts.T, curved], names=["group_id", "lo", "hi", "n0", "n1", "n2", "n3", "curvature"])


def transports(pairs: DataFrame, work: int = WORK) -> DataFrame:
    """(group_id, lo, hi, n0 to n3, curvature) for each distinct pair (group_id, lo, hi): how often each cost, 0 to 3,
    stands between a neighbour of lo and one of hi, and 1 - the cost of their transport.

    An edge is dealt with at the end whose neighbours have fewer neighbours. Ends are gathered in blocks of about
    `work` neighbours' neighbours over their edges; a block is sent the lists of its ends and their
    neighbours, each once, and finds the costs there, so that none of the deg(lo) x deg(hi) costs is written.
    """
    simple = cut_lineage(pairs.select("group_id", "lo", "hi").distinct())
    names = simple.select("group_id", F.explode(F.array("lo", "hi")).alias("uuid")).distinct()
    keys = ["group_id", "uuid"]
    numbered = cut_lineage(names.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("v", F.monotonically_increasing_id()))  # in order of uuids
    a, b = (numbered.select("group_id", F.col("uuid").alias(x), F.col("v").alias(y)) for x, y in (("lo", "s"), ("hi", "d")))
    edges = cut_lineage(simple.join(a, ["group_id", "lo"]).join(b, ["group_id", "hi"]))
    ways = edges.select("group_id", F.explode(F.array(F.struct("s", "d"), F.struct(F.col("d").alias("s"), F.col("s").alias("d")))).alias("e")).select("group_id", F.col("e.s").alias("node"), F.col("e.d").alias("other"))
    near = cut_lineage(ways.groupBy("group_id", "node").agg(F.sort_array(F.collect_list("other")).alias("near")))
    size = near.select(F.col("node").alias("other"), F.size("near").cast("bigint").alias("n"))
    reach = cut_lineage(ways.join(size, "other").groupBy("node").agg(F.sum("n").alias("reach")))
    of = lambda c: reach.select(F.col("node").alias(c), F.col("reach").alias(f"_{c}"))
    ego, cost = F.when(F.col("_s") <= F.col("_d"), F.col("s")).otherwise(F.col("d")), F.least("_s", "_d") + 200
    marked = cut_lineage(edges.join(of("s"), "s").join(of("d"), "d").select("group_id", "lo", "hi", "s", "d", ego.alias("ego"), cost.alias("cost")))
    blocks = marked.groupBy("group_id").agg(F.ceil(F.sum("cost") / work).cast("int").alias("_n"))
    placed = marked.join(blocks, "group_id").select("group_id", F.pmod(F.xxhash64("ego"), "_n").cast("int").alias("block"), "lo", "hi", "s", "d", "ego")
    egos = placed.select("block", F.col("ego").alias("node")).distinct().join(near, "node")
    needed = egos.select("group_id", "block", F.explode(F.array_append("near", F.col("node"))).alias("node")).distinct()
    lists = needed.join(near.select("node", "near"), "node").select("group_id", F.col("block").alias("part"), "node", "near")
    schema = "group_id string, lo string, hi string, n0 bigint, n1 bigint, n2 bigint, n3 bigint, curvature double"
    return placed.groupBy("group_id", "block").cogroup(lists.groupBy("group_id", "part")).applyInArrow(_of_block, schema)


def cost_counts(pairs: DataFrame) -> DataFrame:
    """(group_id, lo, hi, n0 to n3): for each edge how many of the costs between the neighbours of lo and of hi are 0 to 3."""
    return transports(pairs).drop("curvature")


def curvatures(pairs: DataFrame) -> DataFrame:
    """(group_id, source_uuid, target_uuid, curvature) for each distinct pair (group_id, lo, hi)."""
    return transports(pairs).select("group_id", F.col("lo").alias("source_uuid"), F.col("hi").alias("target_uuid"), "curvature")


def kind(c: str = "curvature"):
    """bridge below -0.05, internal above 0.05, flat between, both ends included."""
    return F.when(F.col(c) < -FLAT, "bridge").when(F.col(c) > FLAT, "internal").otherwise("flat")


def stats(scored: DataFrame) -> DataFrame:
    """One row a group: count, mean, least, greatest and how many of each kind."""
    return scored.groupBy("group_id").agg(
        F.count("*").alias("n_edges"), F.avg("curvature").alias("mean"), F.min("curvature").alias("least"), F.max("curvature").alias("greatest"),
        *[F.count_if(kind() == k).alias(f"n_{k}") for k in ("bridge", "internal", "flat")],
    )


def status(scored: DataFrame) -> DataFrame:
    """One row over all groups: total, bridges, internal, mean (0 for none) and the percentage of bridges."""
    row = scored.agg(F.count("*").alias("total"), F.count_if(kind() == "bridge").alias("bridges"), F.count_if(kind() == "internal").alias("internal"), F.coalesce(F.avg("curvature"), F.lit(0.0)).alias("mean"))
    return row.withColumn("bridge_percent", percentage(F.col("bridges"), F.col("total")))


def top_bridges(scored: DataFrame, entities: DataFrame, n: int) -> DataFrame:
    """The n most negative edges with the names of their ends; an unknown end has an empty name."""
    a = entities.select(F.col("uuid").alias("source_uuid"), F.col("name").alias("source_name"))
    b = entities.select(F.col("uuid").alias("target_uuid"), F.col("name").alias("target_name"))
    top = scored.withColumn("curvature", F.round("curvature", 9)).orderBy("curvature", "source_uuid", "target_uuid").limit(n)
    joined = top.join(a, "source_uuid", "left").join(b, "target_uuid", "left")
    return joined.select("source_uuid", "target_uuid", "curvature", F.coalesce("source_name", F.lit("")).alias("source_name"), F.coalesce("target_name", F.lit("")).alias("target_name"))


def weights(scored: DataFrame) -> DataFrame:
    """(group_id, lo, hi, weight): curvature above the group's least, never under 0.01, for community detection."""
    least = scored.groupBy("group_id").agg(F.min("curvature").alias("_m"))
    w = F.greatest(F.col("curvature") - F.col("_m") + 0.01, F.lit(0.01))
    return scored.join(least, "group_id").select("group_id", F.col("source_uuid").alias("lo"), F.col("target_uuid").alias("hi"), w.alias("weight"))


__all__ = ["cost_counts", "curvatures", "edge_curvature", "graph", "greedy_transport", "kind", "stats", "status", "top_bridges", "transports", "weights"]
