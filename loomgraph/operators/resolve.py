"""Entity resolution: names that share words and vectors that agree, merged into one entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import fields, token_jaccard
from loomgraph.functions.vectors import cosine
from loomgraph.operators import graph
from loomgraph.session import cut_lineage

LEAST_JACCARD = 0.5


def candidate_pairs(entities: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(group_id, lo, hi, jaccard): links between entities of one group and type with vectors that are to be merged.

    Two entities belong together if their names' Jaccard is 0.5 or more and their cosine or Jaccard reaches
    the threshold. Equal word sets always do, so each entity is linked to the least of its set, and sets of
    a Jaccard at the threshold by their least entities; the links have the same connected components as all
    pairs would. Only sets that need the cosine are compared entity by entity. Blocking on the rarest words
    of a set, as many as a Jaccard of 0.5 cannot do without, loses nothing.
    """
    usable = entities.where("size(embedding) > 0 AND uuid IS NOT NULL AND name IS NOT NULL")
    words = F.array_sort(F.array_distinct(fields(F.lower("name"))))
    rows = cut_lineage(usable.select("group_id", "entity_type", "uuid", "name", "embedding", words.alias("words")).where(F.size("words") > 0))
    block = ["group_id", "entity_type"]
    sets = rows.select(*block, "words").distinct().withColumn("set_id", F.xxhash64("words", *block))
    sets = cut_lineage(sets)
    each = sets.select(*block, "set_id", "words", F.explode("words").alias("word"))
    frequency = each.groupBy(*block, "word").agg(F.count("*").alias("n"))
    # Prefix filter: sets of Jaccard t share one of the first |s| - ceil(t |s|) + 1 words in a common order.
    order = Window.partitionBy(*block, "set_id").orderBy("n", "word")
    keyed = each.join(frequency, [*block, "word"]).withColumn("place", F.row_number().over(order))
    keyed = keyed.where(F.col("place") <= F.size("words") - F.ceil(F.size("words") * LEAST_JACCARD) + 1).select(*block, "word", "set_id", "words")
    other = keyed.select(*block, "word", F.col("set_id").alias("set_b"), F.col("words").alias("words_b"))
    near = keyed.join(other, [*block, "word"]).where("set_id < set_b AND size(words) <= 2 * size(words_b) AND size(words_b) <= 2 * size(words)")
    shared, every = F.size(F.array_intersect("words", "words_b")), F.size(F.array_union("words", "words_b"))
    near = near.select(*block, "set_id", "set_b", (shared / every).alias("jaccard"), "words", "words_b").where(F.col("jaccard") >= LEAST_JACCARD)
    near = cut_lineage(near.dropDuplicates([*block, "set_id", "set_b"]))
    first = rows.groupBy(*block, "words").agg(F.min("uuid").alias("first"))
    same = rows.join(first, [*block, "words"]).where("uuid <> first").select("group_id", F.col("first").alias("u"), F.col("uuid").alias("w"), F.lit(1.0).alias("jaccard"))
    firsts = first.select(*block, F.col("words").alias("words_b"), F.col("first").alias("w"))
    sure = near.where(F.col("jaccard") >= threshold).join(first.withColumnRenamed("first", "u"), [*block, "words"]).join(firsts, [*block, "words_b"]).select("group_id", "u", "w", "jaccard")
    a = rows.select(*block, "words", F.col("uuid").alias("u"), F.col("embedding").alias("ea"))
    b = rows.select(*block, F.col("words").alias("words_b"), F.col("uuid").alias("w"), F.col("embedding").alias("eb"))
    close = near.where(F.col("jaccard") < threshold).join(a, [*block, "words"]).join(b, [*block, "words_b"])
    close = close.where(cosine(F.col("ea"), F.col("eb")) >= threshold).select("group_id", "u", "w", "jaccard")
    linked = same.unionByName(sure).unionByName(close)
    return linked.select("group_id", F.least("u", "w").alias("lo"), F.greatest("u", "w").alias("hi"), "jaccard").distinct()


def clusters(pairs: DataFrame) -> DataFrame:
    """(cluster, uuid): entities linked directly or through others; cluster is the smallest uuid."""
    return graph.components(pairs.select("lo", "hi")).select(F.col("component").alias("cluster"), "uuid")


def canonical(members: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster, canonical): the member with most edges, then the longest name in bytes, then the first seen."""
    degree = graph.degrees(edges)
    own = members.join(entities.select("uuid", "group_id", "name", "seq"), "uuid").join(degree, ["group_id", "uuid"], "left")
    best = F.min(F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), (-F.octet_length("name")).alias("l"), "seq", "uuid"))
    return own.groupBy("cluster").agg(best.alias("b")).select("cluster", F.col("b.uuid").alias("canonical"))


def renames(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """(uuid, canonical) of the members that are not canonical."""
    return members.join(chosen, "cluster").where("uuid <> canonical").select("uuid", "canonical")


def merge_edges(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges with both ends moved to canonical entities, without loops that this makes on them, the first of equal ones."""
    a = moved.select(F.col("uuid").alias("source_uuid"), F.col("canonical").alias("_s"))
    b = moved.select(F.col("uuid").alias("target_uuid"), F.col("canonical").alias("_t"))
    joined = edges.join(a, "source_uuid", "left").join(b, "target_uuid", "left")
    ends = joined.withColumn("source_uuid", F.coalesce("_s", "source_uuid")).withColumn("target_uuid", F.coalesce("_t", "target_uuid"))
    targets = moved.select(F.col("canonical").alias("source_uuid")).distinct().withColumn("_canonical", F.lit(True))
    kept = ends.join(targets, "source_uuid", "left").where("source_uuid IS NULL OR target_uuid IS NULL OR source_uuid <> target_uuid OR _canonical IS NULL")
    order = Window.partitionBy("source_uuid", "target_uuid", "name", "group_id").orderBy("seq", "uuid")
    return kept.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*edges.columns)


def relink_episodes(links: DataFrame, moved: DataFrame) -> DataFrame:
    names = moved.select(F.col("uuid").alias("entity_uuid"), F.col("canonical").alias("_c"))
    return links.join(names, "entity_uuid", "left").select(F.coalesce("_c", "entity_uuid").alias("entity_uuid"), "episode_uuid").distinct()


def drop_merged(entities: DataFrame, moved: DataFrame) -> DataFrame:
    return entities.join(moved.select("uuid"), "uuid", "left_anti")


def summary(members: DataFrame, edges: DataFrame, links: DataFrame, dry_run: bool = False) -> DataFrame:
    """(clusters, entities_merged, edges_retargeted, episodes_relinked); a dry run only counts clusters."""
    n = members.agg(F.count_distinct("cluster").alias("clusters"), F.count("*").alias("members"))
    if dry_run:
        return n.select("clusters", *[F.lit(0).cast("bigint").alias(c) for c in ("entities_merged", "edges_retargeted", "episodes_relinked")])
    dup = members.where("uuid <> cluster").select("uuid")
    sources = edges.join(dup.withColumnRenamed("uuid", "source_uuid"), "source_uuid", "left_semi").agg(F.count("*").alias("a"))
    targets = edges.join(dup.withColumnRenamed("uuid", "target_uuid"), "target_uuid", "left_semi").agg(F.count("*").alias("b"))
    moved = links.join(dup.withColumnRenamed("uuid", "entity_uuid"), "entity_uuid", "left_semi").agg(F.count("*").alias("c"))
    one = n.crossJoin(F.broadcast(sources)).crossJoin(F.broadcast(targets)).crossJoin(F.broadcast(moved))  # single rows
    return one.select("clusters", (F.col("members") - F.col("clusters")).alias("entities_merged"), (F.col("a") + F.col("b")).alias("edges_retargeted"), F.col("c").alias("episodes_relinked"))


def resolve_on_ingest(arrivals: DataFrame, hits: DataFrame, entities: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(arrival, uuid): the known entity that a new name is, by the first of its best text hits with the same
    type and cosine at the threshold; null where it is new. arrivals: arrival, entity_type, embedding;
    hits: query_id, doc, rank from full-text search on the names, read against the previous snapshot."""
    known = entities.select(F.col("uuid").alias("doc"), F.col("entity_type").alias("_type"), F.col("embedding").alias("_v"))
    near = hits.where("rank < 5").join(arrivals.withColumnRenamed("arrival", "query_id"), "query_id").join(known, "doc")
    good = near.where((F.col("entity_type") == F.col("_type")) & (cosine(F.col("embedding"), F.col("_v")) >= threshold))
    first = good.groupBy("query_id").agg(F.min_by("doc", "rank").alias("uuid"))
    return arrivals.select("arrival").join(first.withColumnRenamed("query_id", "arrival"), "arrival", "left")


__all__ = ["candidate_pairs", "canonical", "clusters", "drop_merged", "merge_edges", "relink_episodes", "renames", "resolve_on_ingest", "summary", "token_jaccard"]
