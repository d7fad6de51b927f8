"""Hybrid search: ranked lists of full-text, vector and graph signals fused into one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import approx_tokens, query_intent, recency_decay, session_number
from loomgraph.operators import activation, graph, search_text, similarity
from loomgraph.session import cut_lineage

# Weights of the signals.
WEIGHTS = {"entity_text": 1.0, "edge_text": 1.0, "episode_text": 1.5, "edge_vector": 0.5, "episode_vector": 1.5, "traversal": 1.0}
EDGE_COSINE, EPISODE_COSINE = 0.5, 0.3
SEEDS, BOOST, CUTOFF, EVIDENCE = 5, 0.15, 0.15, 0.1


def fuse(lists: dict[str, DataFrame]) -> DataFrame:
    """(query_id, kind, uuid, score): the sum over signals of weight / (rank + 2), ranks from 0.

    lists: signal to (query_id, uuid, rank); the signal's name begins with the kind, traversal gives entities.
    """
    rows = [
        df.select("query_id", F.lit("entity" if name == "traversal" else name.split("_")[0]).alias("kind"), "uuid", (F.lit(WEIGHTS[name]) / (F.col("rank") + 2)).alias("part"))
        for name, df in lists.items()
    ]
    return reduce(DataFrame.unionByName, rows).groupBy("query_id", "kind", "uuid").agg(F.round(F.sum("part"), 9).alias("score"))


def cut_weak(scored: DataFrame) -> DataFrame:
    """Without rows under CUTOFF of their query's best, and without queries whose best is under EVIDENCE."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return scored.withColumn("_best", best).where((F.col("score") >= CUTOFF * F.col("_best")) & (F.col("_best") >= EVIDENCE)).drop("_best")


def decay_by_session(results: DataFrame) -> DataFrame:
    """Scores weighed by the recency of the session in source; only matters where a query has a session above 1."""
    session = session_number(F.coalesce("source", F.lit("")))
    with_session = results.withColumn("_s", session)
    most = F.max("_s").over(Window.partitionBy("query_id"))
    return with_session.withColumn("score", F.col("score") * recency_decay(F.col("_s"), most)).drop("_s")


def ranked(results: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "type", "uuid")
    return results.withColumn("rank", F.row_number().over(order))


def within_budget(results: DataFrame, most_tokens: int) -> DataFrame:
    """The ranked results up to before the first that overflows the budget of tokens."""
    cost = approx_tokens(F.concat(F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))))
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumn("used", F.sum(cost).over(order)).where(F.col("used") <= most_tokens)


def as_json_lines(results: DataFrame) -> DataFrame:
    """(query_id, rank, line): each result as a JSON object; an empty body or source is left out."""
    optional = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return results.select("query_id", "rank", F.to_json(F.struct("rank", "type", "title", optional("body"), "score", optional("source"))).alias("line"))


def search(
    queries: DataFrame, entities: DataFrame, edges: DataFrame, episodes: DataFrame, limit: int = 10,
    walk: activation.Spread = activation.Spread(), stemmed: bool = True,  # noqa: B008
) -> DataFrame:
    """(query_id, rank, type, uuid, title, body, score, source, valid_at) for queries (query_id, text, group_id, embedding).

    Results are edges and episodes of the query's group; entities only serve to find them. A query without
    embedding is answered by text and graph alone; one that nothing matches has no rows.
    """
    q = cut_lineage(queries.select("query_id", "text", "group_id", "embedding").withColumn("intent", query_intent(F.col("text"))))
    docs = {
        "entity": entities.select(F.col("uuid").alias("doc"), F.col("name").alias("text"), "group_id"),
        "edge": edges.select(F.col("uuid").alias("doc"), F.col("fact").alias("text"), "group_id"),
        "episode": episodes.select(F.col("uuid").alias("doc"), F.col("content").alias("text"), "group_id"),
    }
    text = {k: cut_lineage(search_text.bm25(d, q, 2 * limit, stemmed).withColumnRenamed("doc", "uuid")) for k, d in docs.items()}
    vector = lambda df: df.select(F.col("uuid").alias("id"), "embedding", "group_id")
    edge_hits = similarity.similar(vector(edges), q, EDGE_COSINE, 2 * limit).withColumnRenamed("id", "uuid")
    episode_hits = similarity.similar(vector(episodes), q, EPISODE_COSINE, 2 * limit).withColumnRenamed("id", "uuid")
    seeds = text["entity"].where(F.col("rank") < SEEDS).select("query_id", "uuid")
    near = graph.neighbours(edges, entities)
    walked = activation.inhibit(activation.spread(seeds, near, q, entities, walk))
    order = Window.partitionBy("query_id").orderBy(F.desc("activation"), "uuid")
    traversal = walked.select("query_id", "uuid", (F.row_number().over(order) - 1).alias("rank"))
    fused = fuse({
        "entity_text": text["entity"], "edge_text": text["edge"], "episode_text": text["episode"],
        "edge_vector": edge_hits, "episode_vector": episode_hits, "traversal": traversal,
    })
    fused = cut_lineage(fused.where("kind <> 'entity'"))
    seed_communities = seeds.join(entities.select("uuid", "community_id"), "uuid").where("community_id >= 0").select("query_id", "community_id").distinct()
    ends = edges.select(F.col("uuid"), F.explode(F.array("source_uuid", "target_uuid")).alias("_end"))
    boosted = (
        fused.where("kind = 'edge'").select("query_id", "uuid").join(ends, "uuid")
        .join(entities.select(F.col("uuid").alias("_end"), "community_id"), "_end")
        .join(seed_communities, ["query_id", "community_id"], "left_semi").select("query_id", "uuid").distinct().withColumn("_boost", F.lit(BOOST))
    )
    scored = fused.join(boosted, ["query_id", "uuid"], "left").withColumn("score", F.col("score") + F.coalesce("_boost", F.lit(0.0))).drop("_boost")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "kind", "uuid")
    top = cut_lineage(cut_weak(scored.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= limit).drop("_n")))
    edge_source = graph.first_edge_source(edges.join(top.where("kind = 'edge'").select("uuid").distinct(), "uuid", "left_semi"), episodes)
    edge_rows = top.where("kind = 'edge'").join(edges.select("uuid", F.col("name").alias("title"), F.col("fact").alias("body"), "valid_at"), "uuid")
    edge_rows = edge_rows.join(edge_source.withColumnRenamed("edge_uuid", "uuid"), "uuid", "left").withColumn("source", F.coalesce("source", F.lit("")))
    episode_rows = top.where("kind = 'episode'").join(episodes.select("uuid", F.col("source").alias("title"), F.col("content").alias("body"), "source"), "uuid").withColumn("valid_at", F.lit(None).cast("string"))
    columns = ["query_id", F.col("kind").alias("type"), "uuid", "title", "body", "score", "source", "valid_at"]
    results = edge_rows.select(*columns).unionByName(episode_rows.select(*columns))
    return ranked(decay_by_session(results))
