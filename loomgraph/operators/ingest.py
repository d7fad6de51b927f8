"""From jobs to the graph: episodes, the entities and relations a model finds in them, and their links.

Each call takes a batch of jobs and gives the next version of every table, so a batch that is run again after a
failure gives the same. Names are looked up in the tables as they were before the batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.model_output import extracted_edges, extracted_entities
from loomgraph.functions.text import ascii_lower, entity_embedding_text
from loomgraph.operators import folds, jobs, resolve, search_text
from loomgraph.session import cut_lineage
from loomgraph.sources.providers import Embedder, Extractor, apply_model, embed_column

EPISODES = "uuid string, content string, group_id string, source string, created_at timestamp, embedding array<float>"
ENTITIES = "uuid string, name string, entity_type string, group_id string, created_at timestamp, embedding array<float>, description string, community_id int"
EDGES = "uuid string, source_uuid string, target_uuid string, name string, fact string, group_id string, valid_at string, invalid_at string, episodes string, created_at timestamp, embedding array<float>"
LINKS = "entity_uuid string, episode_uuid string"
SAME_NAME = 0.92  # cosine from which on a name found by text is the same entity
LOOKED_AT = 5  # names found by text that are compared


@dataclass
class Graph:
    """The four tables of the graph."""

    episodes: DataFrame
    entities: DataFrame
    edges: DataFrame
    links: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Graph:
        return Graph(*[spark.createDataFrame([], schema) for schema in (EPISODES, ENTITIES, EDGES, LINKS)])


def made_uuid(*parts: str | Column) -> Column:
    """A uuid made from values, so that the same values always give the same one."""
    h = F.sha2(F.concat_ws("\u001f", *parts), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def episodes_of(claimed: DataFrame) -> DataFrame:
    """(job, seq, uuid, content, group_id, source, created_at) of the jobs whose payload decodes."""
    p = F.from_json("payload", "content string, source string, group_id string")
    rows = claimed.select(F.col("id").alias("job"), p.alias("p"), "created_at").where("p.content IS NOT NULL")
    group, source = F.coalesce("p.group_id", F.lit("default")), F.coalesce("p.source", F.lit(""))
    return rows.select("job", F.col("job").alias("seq"), made_uuid(group, source, "p.content").alias("uuid"), "p.content", group.alias("group_id"), source.alias("source"), "created_at")


def extract(episodes: DataFrame, extractor: Extractor, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """episodes with found (name, entity_type, description), related (edges between places in found) and error.

    An episode with fewer than two entities is not asked for edges; edges that point outside are dropped.
    """
    asked = cut_lineage(apply_model(episodes, extractor.entities, "_e", "content", wait=wait))
    found = asked.withColumn("found", F.coalesce(extracted_entities(F.col("_e.reply")), F.array())).withColumn("names", F.transform("found", lambda x: x["name"]))
    asking = F.when(F.size("found") >= 2, F.col("names"))
    replied = cut_lineage(apply_model(found.withColumn("_names", asking), lambda names, text: extractor.edges(list(names), text), "_r", "_names", "content", wait=wait))
    related = F.coalesce(extracted_edges(F.coalesce("_r.reply", F.lit("[]")), F.size("found")), F.array())
    return replied.withColumn("related", related).withColumn("error", F.coalesce("_e.error", "_r.error")).drop("_e", "_r", "_names", "names")


def _seq(df: DataFrame) -> DataFrame:
    """Rows that were there before count as the first arrivals."""
    return df.withColumn("seq", F.lit(-1).cast("bigint"))


def ingest(
    queue: DataFrame, graph: Graph, extractor: Extractor, embedder: Embedder, now: Column, threshold: float = SAME_NAME, wait: Callable[[float], None] = time.sleep
) -> tuple[DataFrame, Graph]:
    """(the queue, the graph) after all jobs that are pending and due at now.

    A job whose payload does not decode or whose model fails counts an attempt and is put off; its episode stays
    out until a later attempt. Jobs that are not due stay as they are. Each new name is one of the group's
    entities if one of the first LOOKED_AT found by text has its type and a cosine at the threshold, else
    the entity of that name, made if there is none. Two arrivals of a name in one batch are one entity.
    """
    ready = cut_lineage(jobs.eligible(jobs.recover(queue, now), now))
    read = cut_lineage(extract(episodes_of(ready), extractor, wait))
    good = read.where("error IS NULL")
    reason = ready.select("id").join(read.select(F.col("job").alias("id"), "error", F.lit(True).alias("_read")), "id", "left")
    reason = reason.select("id", F.when(F.col("_read"), F.col("error")).otherwise("the payload does not decode").alias("_why"), F.lit(True).alias("_taken"))
    episodes = embed_column(good.select("seq", "uuid", "content", "group_id", "source", "created_at"), "content", embedder, wait=wait)
    episodes = folds.upsert_episodes(_seq(graph.episodes).unionByName(episodes))

    each = good.select("seq", F.col("uuid").alias("episode"), "group_id", "created_at", F.posexplode("found").alias("place", "e"))
    named = each.select("seq", "episode", "group_id", "created_at", "place", "e.*").withColumn("key", ascii_lower(F.col("name")))
    named = cut_lineage(embed_column(named.withColumn("_text", entity_embedding_text(F.col("name"), F.col("entity_type"), F.col("description"))), "_text", embedder, wait=wait).drop("_text"))
    arrivals = cut_lineage(named.select("group_id", "key", "name", "entity_type", "embedding").dropDuplicates(["group_id", "key", "entity_type"]).withColumn("arrival", made_uuid("group_id", "key", F.coalesce("entity_type", F.lit("")))))
    hits = search_text.bm25(graph.entities.select(F.col("uuid").alias("doc"), F.col("name").alias("text"), "group_id"), arrivals.select(F.col("arrival").alias("query_id"), F.col("name").alias("text"), "group_id"), LOOKED_AT)
    known = resolve.resolve_on_ingest(arrivals.select("arrival", "entity_type", "embedding"), hits, graph.entities, threshold)
    by_arrival = arrivals.join(known, "arrival").select("group_id", "key", F.coalesce("entity_type", F.lit("")).alias("_type"), F.col("uuid").alias("resolved"))
    placed = named.withColumn("_type", F.coalesce("entity_type", F.lit(""))).join(by_arrival, ["group_id", "key", "_type"])
    placed = cut_lineage(placed)
    new = placed.where("resolved IS NULL").select("seq", made_uuid("group_id", "key").alias("uuid"), "name", "entity_type", "group_id", "created_at", "embedding", F.nullif("description", F.lit("")).alias("description"))
    entities = cut_lineage(folds.upsert_entities(_seq(graph.entities).drop("community_id").unionByName(new)).drop("n_arrivals"))
    entities_known = entities.select("group_id", ascii_lower(F.col("name")).alias("key"), F.col("uuid").alias("_own"))
    ends = cut_lineage(placed.join(entities_known, ["group_id", "key"], "left").select("episode", "place", F.coalesce("resolved", "_own").alias("entity")))
    communities = graph.entities.select("uuid", "community_id")
    links = folds.link_episodes(graph.links, ends.select(F.col("entity").alias("entity_uuid"), F.col("episode").alias("episode_uuid")))

    told = good.select("seq", F.col("uuid").alias("episode"), "group_id", "created_at", F.explode("related").alias("r")).select("seq", "episode", "group_id", "created_at", "r.*")
    source = ends.select("episode", F.col("place").alias("source_entity_id"), F.col("entity").alias("source_uuid"))
    target = ends.select("episode", F.col("place").alias("target_entity_id"), F.col("entity").alias("target_uuid"))
    edges = told.join(source, ["episode", "source_entity_id"]).join(target, ["episode", "target_entity_id"])
    edges = embed_column(edges, "fact", embedder, wait=wait).select(
        "seq", made_uuid("episode", "source_uuid", "target_uuid", F.coalesce("relation_type", F.lit(""))).alias("uuid"), "source_uuid", "target_uuid",
        F.coalesce("relation_type", F.lit("")).alias("name"), "fact", "group_id", "valid_at", "invalid_at", F.to_json(F.array("episode")).alias("episodes"), "created_at", "embedding",
    )
    edges = folds.upsert_edges(_seq(graph.edges).unionByName(edges)).drop("n_arrivals")

    judged = queue.transform(jobs.recover, now).join(reason, "id", "left")
    failed = F.coalesce(F.col("_taken"), F.lit(False)) & F.col("_why").isNotNull()
    done = F.coalesce(F.col("_taken"), F.lit(False)) & F.col("_why").isNull()
    after = jobs.complete(jobs.fail(judged, failed, F.col("_why"), now), done, now).drop("_why", "_taken")
    return after, Graph(episodes, entities.join(communities, "uuid", "left"), edges, links)
