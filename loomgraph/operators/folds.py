"""Upserts as folds over arrivals in the order of seq, and other writes as new versions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import ascii_lower


def _first(c: str | Column) -> Column:
    return F.min_by(c, "seq")


def _has_vector(c: str = "embedding") -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def upsert_episodes(arrivals: DataFrame) -> DataFrame:
    """By uuid: content and embedding of the last arrival, the rest of the first."""
    rows = arrivals.where("uuid IS NOT NULL")
    return rows.groupBy("uuid").agg(
        F.max_by("content", "seq").alias("content"), _first("group_id").alias("group_id"), _first("source").alias("source"),
        _first("created_at").alias("created_at"), F.max_by("embedding", "seq").alias("embedding"),
    )


def upsert_entities(arrivals: DataFrame) -> DataFrame:
    """By group and name without the case of ASCII letters; the type is not part of the key.

    uuid, name and type are those of the first arrival; embedding and description are those of the last
    arrival with an embedding, without one the first description stays. Null names form no entity.
    """
    rows = arrivals.where("group_id IS NOT NULL AND name IS NOT NULL").withColumn("_key", ascii_lower(F.col("name")))
    vector = F.when(_has_vector(), F.col("seq"))
    return (
        rows.groupBy("group_id", "_key")
        .agg(
            _first("uuid").alias("uuid"), _first("name").alias("name"), _first("entity_type").alias("entity_type"), _first("created_at").alias("created_at"),
            F.max_by("embedding", vector).alias("embedding"),
            F.coalesce(F.max_by("description", vector), _first("description")).alias("description"), F.count("*").alias("n_arrivals"),
        )
        .drop("_key")
    )


def upsert_edges(arrivals: DataFrame) -> DataFrame:
    """By both ends, name and group: fact and embedding of the last arrival, even if null, the rest of the first."""
    keys = ["source_uuid", "target_uuid", "name", "group_id"]
    rows = arrivals.where("source_uuid IS NOT NULL AND target_uuid IS NOT NULL AND name IS NOT NULL AND group_id IS NOT NULL")
    last = F.max_by(F.struct("fact", "embedding"), "seq")
    folded = rows.groupBy(*keys).agg(
        _first("uuid").alias("uuid"), last.alias("_last"), _first("valid_at").alias("valid_at"), _first("invalid_at").alias("invalid_at"),
        _first("episodes").alias("episodes"), _first("created_at").alias("created_at"), F.count("*").alias("n_arrivals"),
    )
    return folded.select("uuid", *keys, F.col("_last.fact").alias("fact"), "valid_at", "invalid_at", "episodes", "created_at", F.col("_last.embedding").alias("embedding"), "n_arrivals")


def link_episodes(existing: DataFrame, added: DataFrame) -> DataFrame:
    """The bridge with new links inserted, each pair once."""
    cols = ["entity_uuid", "episode_uuid"]
    return existing.select(*cols).unionByName(added.select(*cols)).where("entity_uuid IS NOT NULL AND episode_uuid IS NOT NULL").distinct()


def write_communities(entities: DataFrame, assigned: DataFrame) -> DataFrame:
    """entities with the community ids of assigned (uuid, community_id); others keep theirs."""
    new = assigned.select("uuid", F.col("community_id").alias("_new")).dropDuplicates(["uuid"])
    return entities.join(new, "uuid", "left").withColumn("community_id", F.coalesce("_new", "community_id")).drop("_new")


def store_reports(arrivals: DataFrame) -> DataFrame:
    """(group_id, community_id, report): the last report of each community by seq."""
    return arrivals.groupBy("group_id", "community_id").agg(F.max_by("report", "seq").alias("report"))


def replace_group(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of the groups in fresh replaced by it, as for curvatures and neighbour caches."""
    return existing.join(fresh.select("group_id").distinct(), "group_id", "left_anti").select(*fresh.columns).unionByName(fresh)


def write_by_group(df: DataFrame, path: str) -> None:
    """The same on files: partitions of the groups that df has are overwritten, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("group_id").parquet(path)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_at", F.row_number().over(at)).where("_at = 1").drop("_at")


def count_by_group(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("group_id").agg(F.count("*").alias(name))
