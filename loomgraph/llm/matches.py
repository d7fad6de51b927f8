"""Pairwise matches to groups: a breadth-first peel of the giant component, minimum propagation on the rest.

Every vertex gets a long that keeps the order of the uuids, so that all rounds shuffle pairs of longs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.vectors import cosine, usable
from loomgraph.session import cut_lineage, release

DIM = 32


def accepted_pairs(matches: DataFrame, entities: DataFrame, least_score: float = 0.9, dim: int = DIM) -> DataFrame:
    """(a, b) with a < b: pairs of different known uuids that a row with enough score links.

    A null or NaN score is replaced by the cosine of the two embeddings; without two usable vectors such
    a row links nothing. Repeated rows count once, and the pair counts if any of its rows does. Null
    uuids, self matches and unknown uuids are left out.
    """
    score = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    pairs = (
        matches.where(F.col("uuid_a") != F.col("uuid_b"))
        .select(F.least("uuid_a", "uuid_b").alias("a"), F.greatest("uuid_a", "uuid_b").alias("b"), score.alias("score"))
        .groupBy("a", "b")
        .agg(F.max(F.coalesce(F.col("score") >= least_score, F.lit(False))).alias("hit"), F.max(F.col("score").isNull()).alias("open"))
        .where("hit OR open")
    )
    known = entities.where(F.col("uuid").isNotNull()).select("uuid").hint("shuffle_hash")
    scored = (
        pairs.where("hit")
        .select("a", "b")
        .join(known, F.col("a") == F.col("uuid"), "left_semi")
        .join(known, F.col("b") == F.col("uuid"), "left_semi")
    )
    unscored = cut_lineage(pairs.where("open AND NOT hit").select("a", "b"))
    # Only the vectors of these are kept, by a hash of them, so that the table is not sorted.
    ends = unscored.select(F.explode(F.array("a", "b")).alias("uuid")).distinct().hint("shuffle_hash")
    vectors = cut_lineage(entities.where("embedding IS NOT NULL").select("uuid", "embedding").join(ends, "uuid", "left_semi")).where(usable(F.col("embedding"), dim))
    left = vectors.select(F.col("uuid").alias("a"), F.col("embedding").alias("va"))
    right = vectors.select(F.col("uuid").alias("b"), F.col("embedding").alias("vb"))
    close = (
        unscored.join(left, "a").join(right, "b")
        .where(cosine(F.col("va"), F.col("vb")) >= least_score).select("a", "b").distinct()
    )
    return scored.unionByName(close)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("s", "d"), F.struct(F.col("d").alias("s"), F.col("s").alias("d")))).alias("e")).select("e.*")


def _relabel(edges: DataFrame, level: DataFrame) -> DataFrame:
    """The edges between the images of their ends; what has become a loop is gone. level has every end."""
    at_s = level.select(F.col("v").alias("s"), F.col("to").alias("ts"))
    at_d = level.select(F.col("v").alias("d"), F.col("to").alias("td"))
    moved = edges.join(at_s, "s").join(at_d, "d").where("ts <> td")
    return moved.select(F.least("ts", "td").alias("s"), F.greatest("ts", "td").alias("d")).distinct()


def _minimum_round(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Minimum propagation: every vertex moves to its least neighbour, on to that one's, and so to the end.

    The ways to the least neighbours only go down, so they end at vertices less than all around them, of which
    there is one for two at most. They are followed in steps of doubled length.
    """
    least = _both_ways(edges).groupBy("s").agg(F.min("d").alias("d")).select(F.col("s").alias("v"), F.least("s", "d").alias("to"))
    onward = least.select(F.col("v").alias("to"), F.col("to").alias("on"))
    level = cut_lineage(least.join(onward, "to").select("v", F.col("on").alias("to"), (F.col("on") != F.col("to")).alias("moved")))
    while not level.where("moved").isEmpty():
        last, onward = level, level.select(F.col("v").alias("to"), F.col("to").alias("on"))
        level = cut_lineage(level.drop("moved").join(onward, "to").select("v", F.col("on").alias("to"), (F.col("on") != F.col("to")).alias("moved")))
        release(last)
    level = level.select("v", "to")
    return cut_lineage(_relabel(edges, level)), level


def peel(edges: DataFrame, most_hops: int) -> tuple[DataFrame, DataFrame]:
    """(edges that remain, the reached vertices v with the least of them) of a breadth-first search from the
    vertex of highest degree.

    If the search ends within most_hops, its component is whole and is taken away by an anti-join; else
    what it has reached stays in the graph as one vertex.
    """
    ways = cut_lineage(_both_ways(edges))
    frontier = cut_lineage(ways.groupBy("s").count().orderBy(F.desc("count"), "s").limit(1).select(F.col("s").alias("v")))
    levels = [frontier]
    for _ in range(most_hops):
        near = levels[-1] if len(levels) == 1 else levels[-1].unionByName(levels[-2])
        reached = frontier.join(ways, frontier.v == ways.s).select(F.col("d").alias("v")).distinct()
        frontier = cut_lineage(reached.join(near, "v", "left_anti"))
        if ended := frontier.isEmpty():
            break
        levels.append(frontier)
    else:
        ended = False
    visited = levels[0]
    for more in levels[1:]:
        visited = visited.unionByName(more)
    smallest = visited.agg(F.min("v").alias("to"))
    level = cut_lineage(visited.crossJoin(F.broadcast(smallest)))  # one row against all
    if ended:
        rest = edges.join(level.select(F.col("v").alias("s")), "s", "left_anti")
    else:
        others = ways.select(F.col("s").alias("v")).distinct().join(level.select("v"), "v", "left_anti")
        rest = _relabel(edges, level.unionByName(others.select("v", F.col("v").alias("to"))))
    rest = cut_lineage(rest)
    release(ways, *levels, frontier)
    return rest, level


def connected_groups(pairs: DataFrame, most_hops: int = 12) -> DataFrame:
    """(group_uuid, uuid) for every vertex of pairs (a, b); group_uuid is the smallest uuid of the group.

    The component of the vertex of highest degree, which is the giant one where there is one, is peeled off
    the whole graph by breadth-first joins and taken away by an anti-join; the others are labelled by minimum
    propagation, in rounds that at least halve the vertices whatever their order. A search that has not ended after most_hops, as
    on long chains, leaves what it has reached as one vertex to these rounds, which only stop when no edge is
    left, so the result is exact whatever the parameter. Repeated pairs, loops and nulls change nothing; no
    pairs give no rows.
    """
    links = pairs.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = cut_lineage(links)
    names = links.select(F.explode(F.array("a", "b")).alias("uuid")).distinct()
    vertices = cut_lineage(names.repartitionByRange("uuid").sortWithinPartitions("uuid").withColumn("v", F.monotonically_increasing_id()))
    a, b = vertices.select(F.col("uuid").alias("a"), F.col("v").alias("s")), vertices.select(F.col("uuid").alias("b"), F.col("v").alias("d"))
    edges = cut_lineage(links.join(a, "a").join(b, "b").select("s", "d"))
    release(links)
    if edges.isEmpty():
        return vertices.select(F.col("uuid").alias("group_uuid"), "uuid").limit(0)
    rest, peeled = peel(edges, most_hops)
    release(edges)
    levels: list[DataFrame] = []
    while not rest.isEmpty():
        last, (rest, level) = rest, _minimum_round(rest)
        release(last)
        levels.append(level)
    total = levels[-1] if levels else None
    for level in reversed(levels[:-1]):
        end = total.select(F.col("v").alias("to"), F.col("to").alias("end"))
        total = level.join(end, "to", "left").select("v", F.coalesce("end", "to").alias("to"))
    if total is None:
        total = peeled
    else:
        # The peeled vertices move on with the one they stay as; the others have what the rounds gave them.
        end = total.select(F.col("v").alias("to"), F.col("to").alias("end"))
        moved = peeled.join(end, "to", "left").select("v", F.coalesce("end", "to").alias("to"))
        total = moved.unionByName(total.join(peeled.select("v"), "v", "left_anti"))
    ends = vertices.select(F.col("uuid").alias("group_uuid"), F.col("v").alias("to"))
    return vertices.join(total, "v").join(ends, "to").select("group_uuid", "uuid")


def match_groups(matches: DataFrame, entities: DataFrame, least_score: float = 0.9, dim: int = DIM) -> DataFrame:
    return connected_groups(accepted_pairs(matches, entities, least_score, dim))
