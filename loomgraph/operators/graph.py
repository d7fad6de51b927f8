"""Joins over the graph of entities and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import cut_lineage, release


def neighbours(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(group_id, uuid, neighbour, name, entity_type, fact, edge_name): what lies one edge away in either direction.

    Two edges of different fact give two rows, the same row from both directions one. Ends of other groups
    or unknown ends have none.
    """
    ends = entities.select("group_id", F.col("uuid").alias("neighbour"), "name", "entity_type")
    out = edges.select("group_id", F.col("source_uuid").alias("uuid"), F.col("target_uuid").alias("neighbour"), "fact", F.col("name").alias("edge_name"))
    back = edges.select("group_id", F.col("target_uuid").alias("uuid"), F.col("source_uuid").alias("neighbour"), "fact", F.col("name").alias("edge_name"))
    both = out.unionByName(back).where("uuid IS NOT NULL").distinct()
    return both.join(ends, ["group_id", "neighbour"]).select("group_id", "uuid", "neighbour", "name", "entity_type", "fact", "edge_name")


def incident_edges(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with an end in chosen (uuid, group_id): two semi-joins and a union in place of an OR."""
    from_source = edges.join(chosen.select("group_id", F.col("uuid").alias("source_uuid")).distinct(), ["group_id", "source_uuid"], "left_semi")
    from_target = edges.join(chosen.select("group_id", F.col("uuid").alias("target_uuid")).distinct(), ["group_id", "target_uuid"], "left_semi")
    return from_source.select(*edges.columns).unionByName(from_target.select(*edges.columns)).dropDuplicates(["uuid"])


def degrees(edges: DataFrame) -> DataFrame:
    """(group_id, uuid, degree): edges at each entity; a loop counts once."""
    ends = edges.select("group_id", F.explode(F.array_distinct(F.array("source_uuid", "target_uuid"))).alias("uuid"))
    return ends.where("uuid IS NOT NULL").groupBy("group_id", "uuid").agg(F.count("*").alias("degree"))


def known_pairs(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(group_id, lo, hi): one row for each edge whose ends are different entities of its group."""
    ends = entities.select("group_id", "uuid").distinct()
    return (
        edges.where("source_uuid <> target_uuid")
        .join(ends.withColumnRenamed("uuid", "source_uuid"), ["group_id", "source_uuid"], "left_semi")
        .join(ends.withColumnRenamed("uuid", "target_uuid"), ["group_id", "target_uuid"], "left_semi")
        .select("group_id", F.least("source_uuid", "target_uuid").alias("lo"), F.greatest("source_uuid", "target_uuid").alias("hi"))
    )


def pair_weights(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(group_id, lo, hi, weight): number of edges between two entities."""
    return known_pairs(edges, entities).groupBy("group_id", "lo", "hi").agg(F.count("*").alias("weight"))


def adjacency(pairs: DataFrame) -> DataFrame:
    """(group_id, node, neighbours): sorted neighbours in the simple graph of pairs (group_id, lo, hi).

    A node's neighbours form one array; nodes of very many are meant for curvature only, which needs them whole.
    """
    ways = pairs.select("group_id", F.col("lo").alias("node"), F.col("hi").alias("other")).unionByName(pairs.select("group_id", F.col("hi").alias("node"), F.col("lo").alias("other")))
    return ways.groupBy("group_id", "node").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))


def entity_episodes(entities: DataFrame, links: DataFrame, episodes: DataFrame) -> DataFrame:
    """(entity_uuid, episode_uuid, source, created_at), each pair once, of entities and episodes of one group."""
    e = entities.select("group_id", F.col("uuid").alias("entity_uuid"))
    p = episodes.select("group_id", F.col("uuid").alias("episode_uuid"), "source", "created_at")
    return links.select("entity_uuid", "episode_uuid").distinct().join(e, "entity_uuid").join(p, ["group_id", "episode_uuid"])


def latest_episodes(linked: DataFrame, n: int) -> DataFrame:
    """The n newest episodes of each entity, the smaller uuid first among equals."""
    order = Window.partitionBy("entity_uuid").orderBy(F.desc_nulls_last("created_at"), "episode_uuid")
    return linked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def first_entity_source(linked: DataFrame) -> DataFrame:
    """(entity_uuid, source): the source of the oldest episode."""
    best = F.min(F.struct(F.coalesce(F.unix_micros("created_at"), F.lit(2**62)).alias("t"), "episode_uuid", "source"))
    return linked.groupBy("entity_uuid").agg(best.alias("b")).select("entity_uuid", "b.source")


def first_edge_source(edges: DataFrame, episodes: DataFrame) -> DataFrame:
    """(edge_uuid, source): the source of the first episode in an edge's provenance that is known."""
    each = edges.select(F.col("uuid").alias("edge_uuid"), F.posexplode(F.from_json("episodes", "array<string>")).alias("at", "episode_uuid"))
    known = each.join(episodes.select(F.col("uuid").alias("episode_uuid"), "source"), "episode_uuid")
    return known.groupBy("edge_uuid").agg(F.min_by("source", "at").alias("source"))


def components(pairs: DataFrame) -> DataFrame:
    """(uuid, component): the smallest uuid reachable over pairs (lo, hi).

    Every round moves each vertex to its least neighbour, on to that one's and so to the end, in steps of
    doubled length, then contracts; rounds at least halve the vertices. Loops and repeats change nothing.
    """
    edges = cut_lineage(pairs.where("lo <> hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct())
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        ways = edges.unionByName(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        level = ways.groupBy("lo").agg(F.min("hi").alias("hi")).select(F.col("lo").alias("uuid"), F.least("lo", "hi").alias("to"), F.lit(True).alias("moved"))
        level = cut_lineage(level)
        while not level.where("moved").isEmpty():
            last, onward = level, level.select(F.col("uuid").alias("to"), F.col("to").alias("on"))
            level = cut_lineage(level.drop("moved").join(onward, "to").select("uuid", F.col("on").alias("to"), (F.col("on") != F.col("to")).alias("moved")))
            release(last)
        level = level.drop("moved")
        a, b = level.select(F.col("uuid").alias("lo"), F.col("to").alias("x")), level.select(F.col("uuid").alias("hi"), F.col("to").alias("y"))
        moved = edges.join(a, "lo").join(b, "hi").where("x <> y").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))
        last, edges = edges, cut_lineage(moved.distinct())
        release(last)
        levels.append(level)
    if not levels:
        return edges.select(F.col("lo").alias("uuid"), F.col("hi").alias("component"))
    total = levels[-1]
    for level in reversed(levels[:-1]):
        total = level.join(total.select(F.col("uuid").alias("to"), F.col("to").alias("end")), "to", "left").select("uuid", F.coalesce("end", "to").alias("to"))
    return total.withColumnRenamed("to", "component")
