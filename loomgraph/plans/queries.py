"""Registered queries of the core operators, each over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.functions.vectors import cosine, doubles, norm, usable
from loomgraph.operators import activation, community, curvature, evalqa, folds, fusion, graph, ingest, jobs, resolve, search_text, similarity
from loomgraph.operators.instants import normalise_instants
from loomgraph.session import cut_lineage, distinct_records, table
from loomgraph.sources import files
from loomgraph.sources.providers import HashEmbedder, PatternExtractor

NOW = "2026-06-01 00:00:00"


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """One row a uuid, the first arrival; names may still repeat within a group."""
    rows = table(spark, d, "entities")
    return rows.groupBy("uuid").agg(F.min("seq").alias("seq"), *[F.min_by(c, "seq").alias(c) for c in rows.columns if c not in ("uuid", "seq")])


def _edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "edges")
    return rows.groupBy("uuid").agg(F.min("seq").alias("seq"), *[F.min_by(c, "seq").alias(c) for c in rows.columns if c not in ("uuid", "seq")])


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "episodes")
    return rows.groupBy("uuid").agg(F.min("seq").alias("seq"), *[F.min_by(c, "seq").alias(c) for c in rows.columns if c not in ("uuid", "seq")])


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return normalise_instants(table(spark, d, "edges"), table(spark, d, "workspaces"))


# Scans, counts and filters.


def group_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").select("group_id", "uuid").distinct()


def edge_list(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("group_id", "source_uuid", "target_uuid")


def with_embedding(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, k).where("embedding IS NOT NULL").select(F.lit(k).alias("kind"), "uuid", "group_id").distinct() for k in ("entities", "edges", "episodes")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def count_by_group(spark: SparkSession, d: str) -> DataFrame:
    parts = [folds.count_by_group(distinct_records(table(spark, d, k), "group_id"), "n").withColumn("kind", F.lit(k)) for k in ("entities", "edges", "episodes")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def usable_vectors(spark: SparkSession, d: str) -> DataFrame:
    def rows(kind: str) -> DataFrame:
        each = table(spark, d, kind).where(usable(F.col("embedding"), 32))
        return each.select(F.lit(kind).alias("kind"), "uuid", F.round(norm(F.col("embedding")), 6).alias("norm")).distinct()

    return rows("entities").unionByName(rows("edges")).unionByName(rows("episodes"))


def last_source_name(spark: SparkSession, d: str) -> DataFrame:
    source = F.col("source")
    rows = _episodes(spark, d).where("source IS NOT NULL")
    return rows.select("uuid", X.session_number(source).alias("session"), X.temporal_tag(source).alias("tag"), X.short_path(source, 12).alias("short"))


# Upserts and other writes.


def episode_upsert_fold(spark: SparkSession, d: str) -> DataFrame:
    return folds.upsert_episodes(table(spark, d, "episodes")).select("uuid", "content", "group_id", "source", F.size("embedding").alias("dim"))


def entity_upsert_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = folds.upsert_entities(table(spark, d, "entities"))
    return rows.select("group_id", "uuid", "name", "entity_type", "description", F.size("embedding").alias("dim"), "n_arrivals")


def edge_upsert_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = folds.upsert_edges(table(spark, d, "edges"))
    return rows.select("uuid", "source_uuid", "target_uuid", "name", "group_id", "fact", "valid_at", "invalid_at", "episodes", "n_arrivals")


def link_fold(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "entity_episodes")
    return folds.link_episodes(links, links)


def keep_first_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "edges").where("name IS NOT NULL")
    return folds.keep_first(rows, ["source_uuid", "target_uuid", "name", "group_id"], ["seq"]).select("seq", "uuid")


# Text.


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(X.chunk_windows(F.col("text"))).alias("chunk_no", "chunk"))
    return rows.where(files.enough_text(F.col("chunk"))).select("doc_id", "chunk_no", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(X.chunk_lines(F.col("text"), 600)).alias("chunk_no", "chunk"))
    return rows.select("doc_id", "chunk_no", F.octet_length("chunk").alias("n"))


def approx_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.approx_tokens(F.col("text")).alias("tokens"))


def normalize_answer(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).where("answer IS NOT NULL").select("item_id", X.normalise_answer(F.col("answer")).alias("plain"))


def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "entity_matches").select("uuid_a", "uuid_b").distinct()
    e = _entities(spark, d).where("name IS NOT NULL").select("uuid", "name")
    a, b = e.select(F.col("uuid").alias("uuid_a"), F.col("name").alias("x")), e.select(F.col("uuid").alias("uuid_b"), F.col("name").alias("y"))
    return m.join(a, "uuid_a").join(b, "uuid_b").select("uuid_a", "uuid_b", F.round(X.token_jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


def fts_query_compile(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("item_id", search_text.compiled_query(F.col("question")).alias("compiled"))


def intent_class(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("item_id", X.query_intent(F.col("question")).alias("intent"), X.is_hypothetical(F.col("question")).alias("hypothetical"))


def edge_class(spark: SparkSession, d: str) -> DataFrame:
    kind = X.edge_class(F.col("name"))
    rows = table(spark, d, "edges").select("name", kind.alias("class")).distinct()
    intents = spark.createDataFrame([(i,) for i in X.PHI], "intent string")
    return rows.join(F.broadcast(intents)).select("name", "class", "intent", F.round(X.phi(F.col("intent"), F.col("class")), 6).alias("phi"))  # four rows


def entity_embed_text(spark: SparkSession, d: str) -> DataFrame:
    return _entities(spark, d).where("name IS NOT NULL").select("uuid", X.entity_embedding_text(F.col("name"), F.col("entity_type"), F.col("description")).alias("text"))


def ascii_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").where("name IS NOT NULL").select(X.ascii_lower(F.col("name")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


# Vectors.


def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "entity_matches").select("uuid_a", "uuid_b").distinct()
    e = _entities(spark, d).where(usable(F.col("embedding"), 32)).select("uuid", "embedding")
    a, b = e.select(F.col("uuid").alias("uuid_a"), F.col("embedding").alias("x")), e.select(F.col("uuid").alias("uuid_b"), F.col("embedding").alias("y"))
    return m.join(a, "uuid_a").join(b, "uuid_b").select("uuid_a", "uuid_b", F.round(cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for kind, rows in (("entities", _entities), ("edges", _edges), ("episodes", _episodes)):
        v = cut_lineage(rows(spark, d).where(usable(F.col("embedding"), 32)).select(F.col("uuid").alias("id"), "group_id", "embedding"))
        asked = table(spark, d, "vector_queries").where(F.col("kind") == kind).select("query_id", F.col("uuid").alias("id")).join(v, "id").drop("id")
        hits = similarity.similar(v, asked, 0.3, 20).select(F.lit(kind).alias("kind"), "query_id", F.col("id").alias("uuid"), F.round("score", 6).alias("score"))
        out = hits if out is None else out.unionByName(hits)
    return out


def _entity_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _entities(spark, d).where(usable(F.col("embedding"), 32)).select("group_id", F.col("uuid").alias("id"), "embedding")


def knn20(spark: SparkSession, d: str) -> DataFrame:
    n = similarity.nearest_neighbours(_entity_vectors(spark, d), 20)
    return n.select("group_id", "id", "other", F.round("score", 6).alias("score"), "rank")


def mutual_knn(spark: SparkSession, d: str) -> DataFrame:
    return similarity.mutual_edges(cut_lineage(similarity.nearest_neighbours(_entity_vectors(spark, d), 20)))


def mutual_knn_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The latest tenth of arrivals appended to the graph of the rest."""
    rows = _entities(spark, d).where(usable(F.col("embedding"), 32)).select("seq", "group_id", F.col("uuid").alias("id"), "embedding")
    cut = rows.agg((F.max("seq") * 0.9).alias("cut"))
    marked = cut_lineage(rows.crossJoin(F.broadcast(cut)))  # one row
    old, new = marked.where("seq <= cut"), marked.where("seq > cut")
    before = similarity.mutual_edges(cut_lineage(similarity.nearest_neighbours(old, 20)))
    return similarity.append_mutual(old, new, before, 20)


# Graph.


def neighbors(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_edges(spark, d), _entities(spark, d)).select("group_id", "uuid", "neighbour", "name", "entity_type", "fact", "edge_name")


def edges_for_entities(spark: SparkSession, d: str) -> DataFrame:
    chosen = _entities(spark, d).select("uuid", "group_id")
    return graph.incident_edges(_edges(spark, d), chosen).select("uuid", "source_uuid", "target_uuid")


def degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_edges(spark, d))


def multi_edge_weight(spark: SparkSession, d: str) -> DataFrame:
    return graph.pair_weights(_edges(spark, d), _entities(spark, d))


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    rows = graph.adjacency(graph.known_pairs(_edges(spark, d), _entities(spark, d)))
    return rows.select("group_id", "node", F.size("neighbours").alias("degree"), F.md5(F.array_join("neighbours", ",")).alias("digest"))


def components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(graph.known_pairs(_edges(spark, d), _entities(spark, d)))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    return graph.entity_episodes(_entities(spark, d), table(spark, d, "entity_episodes"), _episodes(spark, d))


def entities_for_episodes(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d).select("entity_uuid", "episode_uuid")


def episodes_for_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.latest_episodes(_linked(spark, d), 3).select("entity_uuid", "episode_uuid", "rank")


def entity_source(spark: SparkSession, d: str) -> DataFrame:
    return graph.first_entity_source(_linked(spark, d))


def edge_source(spark: SparkSession, d: str) -> DataFrame:
    return graph.first_edge_source(_edges(spark, d), _episodes(spark, d))


# Search.


def _named(spark: SparkSession, d: str, tables: list[DataFrame] | None = None) -> DataFrame:
    """What the entities, edges and episodes (tables, where they are at hand) named in vector_queries are called, with their group and vector."""
    q, tables = table(spark, d, "vector_queries"), tables or [t(spark, d) for t in (_entities, _edges, _episodes)]
    parts = [
        q.where(F.col("kind") == kind).join(rows.select("uuid", F.col(c).alias("text"), "group_id", "embedding"), "uuid")
        for kind, rows, c in zip(("entities", "edges", "episodes"), tables, ("name", "fact", "source"), strict=True)
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.select("query_id", "kind", "uuid", "text", "group_id", F.when(usable(F.col("embedding"), 32), F.col("embedding")).alias("embedding"))


def _searches(spark: SparkSession, d: str, tables: list[DataFrame] | None = None) -> DataFrame:
    """Searches for them in their own groups."""
    return cut_lineage(_named(spark, d, tables).where("text IS NOT NULL").select("query_id", "text", "group_id", "embedding"))


def _documents(spark: SparkSession, d: str, kind: str) -> DataFrame:
    rows, c = {"entities": (_entities, "name"), "edges": (_edges, "fact"), "episodes": (_episodes, "content")}[kind]
    return rows(spark, d).select(F.col("uuid").alias("doc"), F.col(c).alias("text"), "group_id")


def _bm25(kind: str, stemmed: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = search_text.bm25(_documents(spark, d, kind), _searches(spark, d), 20, stemmed)
        return found.select("query_id", F.col("doc").alias("uuid"), F.round("score", 6).alias("score"))

    return run


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    parts = [search_text.corpus_stats(_documents(spark, d, k)).select(F.lit(k).alias("corpus"), "n_docs", F.round("avgdl", 6).alias("avgdl")) for k in ("entities", "edges", "episodes")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def postings(spark: SparkSession, d: str) -> DataFrame:
    parts = [search_text.postings(_documents(spark, d, k), False).withColumn("corpus", F.lit(k)) for k in ("entities", "edges", "episodes")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("corpus", "token").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("tf"))


def _seeds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Seeds are the entities named, the ends of the edges and the entities of the episodes."""
    named = cut_lineage(_named(spark, d))
    edges = named.where("kind = 'edges'").join(_edges(spark, d).select("uuid", F.explode(F.array("source_uuid", "target_uuid")).alias("seed")), "uuid")
    linked = _linked(spark, d).select(F.col("entity_uuid").alias("seed"), F.col("episode_uuid").alias("uuid"))
    episodes = named.where("kind = 'episodes'").join(linked, "uuid")
    own = named.where("kind = 'entities'").select("query_id", "uuid")
    seeds = own.unionByName(edges.unionByName(episodes, allowMissingColumns=True).select("query_id", F.col("seed").alias("uuid"))).where("uuid IS NOT NULL").distinct()
    return cut_lineage(seeds), named.select("query_id", "group_id", X.query_intent(F.coalesce("text", F.lit(""))).alias("intent"), "embedding")


def spread_2hop(spark: SparkSession, d: str) -> DataFrame:
    seeds, asked = _seeds(spark, d)
    e = _entities(spark, d)
    out = activation.spread(seeds, graph.neighbours(_edges(spark, d), e), asked, e, activation.Spread(hops=2, width=1_000_000, nodes=1_000_000))
    return out.select("query_id", "uuid", F.round("activation", 6).alias("activation"))


def spreading_activation(spark: SparkSession, d: str) -> DataFrame:
    seeds, asked = _seeds(spark, d)
    e = _entities(spark, d)
    out = activation.inhibit(activation.spread(seeds, graph.neighbours(_edges(spark, d), e), asked, e))
    return out.select("query_id", "uuid", F.round("activation", 6).alias("activation"))


def lateral_inhibition(spark: SparkSession, d: str) -> DataFrame:
    """Degrees as activations within each group."""
    rows = graph.degrees(_edges(spark, d)).select(F.col("group_id").alias("query_id"), "uuid", F.col("degree").cast("double").alias("activation"))
    return activation.inhibit(rows).select("query_id", "uuid", F.round("activation", 6).alias("activation"))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    q = _searches(spark, d)
    e = search_text.bm25(_documents(spark, d, "edges"), q, 20, False).withColumnRenamed("doc", "uuid")
    vectors = _edges(spark, d).where(usable(F.col("embedding"), 32)).select(F.col("uuid").alias("id"), "group_id", "embedding")
    v = similarity.similar(vectors, q, 0.5, 20).withColumnRenamed("id", "uuid")
    return fusion.cut_weak(fusion.fuse({"edge_text": e, "edge_vector": v})).select("query_id", "kind", "uuid", F.round("score", 6).alias("score"))


def _hybrid(spark: SparkSession, d: str, stemmed: bool) -> DataFrame:
    tables = [cut_lineage(t(spark, d)) for t in (_entities, _edges, _episodes)]  # each is read by many stages
    found = fusion.search(_searches(spark, d, tables), *tables, stemmed=stemmed)
    return found.select("query_id", "rank", "type", "uuid", "title", "body", F.round("score", 6).alias("score"), "source", "valid_at")


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, True)


def hybrid_search_plain(spark: SparkSession, d: str) -> DataFrame:
    """The same without the stemmer, which SQL lacks."""
    return _hybrid(spark, d, False)


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Episodes as results of a search for their group, newest first."""
    order = Window.partitionBy("group_id").orderBy(F.desc_nulls_last("created_at"), "uuid")
    rows = _episodes(spark, d).withColumn("rank", F.row_number().over(order))
    return rows.select(F.col("group_id").alias("query_id"), "rank", F.lit("episode").alias("type"), "uuid", F.col("source").alias("title"), F.col("content").alias("body"), (1 / F.col("rank")).alias("score"), "source")


def token_budget(spark: SparkSession, d: str) -> DataFrame:
    return fusion.within_budget(_results(spark, d), 4000).select("query_id", "uuid", "used")


def temporal_decay(spark: SparkSession, d: str) -> DataFrame:
    return fusion.decay_by_session(_results(spark, d)).select("query_id", "uuid", F.round("score", 6).alias("score"))


def relative_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return fusion.cut_weak(_results(spark, d)).select("query_id", "uuid")


def json_lines(spark: SparkSession, d: str) -> DataFrame:
    return fusion.as_json_lines(fusion.within_budget(_results(spark, d), 1000))


# Resolution.


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(resolve.clusters(resolve.candidate_pairs(_entities(spark, d))))


def resolve_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d)


def resolve_canonical(spark: SparkSession, d: str) -> DataFrame:
    return resolve.canonical(_clusters(spark, d), _entities(spark, d), _edges(spark, d))


def _moved(spark: SparkSession, d: str) -> DataFrame:
    members = _clusters(spark, d)
    return cut_lineage(resolve.renames(members, resolve.canonical(members, _entities(spark, d), _edges(spark, d))))


def merge_edges(spark: SparkSession, d: str) -> DataFrame:
    return resolve.merge_edges(_edges(spark, d), _moved(spark, d)).select("uuid", "source_uuid", "target_uuid", "name")


def merge_episodes(spark: SparkSession, d: str) -> DataFrame:
    return resolve.relink_episodes(table(spark, d, "entity_episodes"), _moved(spark, d))


def merge_entities(spark: SparkSession, d: str) -> DataFrame:
    return resolve.drop_merged(_entities(spark, d), _moved(spark, d)).select("uuid", "group_id")


def resolve_summary(spark: SparkSession, d: str) -> DataFrame:
    return resolve.summary(_clusters(spark, d), _edges(spark, d), table(spark, d, "entity_episodes").distinct())


# Curvature and communities.


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(graph.known_pairs(_edges(spark, d), _entities(spark, d)).distinct())


def curvature_cost_hist(spark: SparkSession, d: str) -> DataFrame:
    return curvature.cost_counts(_pairs(spark, d))


def _curved(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(curvature.curvatures(_pairs(spark, d)))


def edge_curvature(spark: SparkSession, d: str) -> DataFrame:
    return _curved(spark, d).withColumn("curvature", F.round("curvature", 6))


def curvature_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = curvature.stats(_curved(spark, d))
    return rows.withColumns({c: F.round(c, 6) for c in ("mean", "least", "greatest")})


def curvature_status(spark: SparkSession, d: str) -> DataFrame:
    return curvature.status(_curved(spark, d)).withColumn("mean", F.round("mean", 6))


def top_bridges(spark: SparkSession, d: str) -> DataFrame:
    return curvature.top_bridges(_curved(spark, d), _entities(spark, d), 20).withColumn("curvature", F.round("curvature", 6))


def louvain(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d)
    return community.louvain(graph.pair_weights(_edges(spark, d), e), e)


def knn_communities(spark: SparkSession, d: str) -> DataFrame:
    """Mutual neighbours, their curvature as weights, communities of those."""
    return community.neighbour_communities(community.neighbour_graph(_entity_vectors(spark, d)))[1]


def community_list(spark: SparkSession, d: str) -> DataFrame:
    rows = community.listing(_entities(spark, d), community_reports(spark, d), 2)
    return rows.select("group_id", "community_id", "size", F.array_join("members", "|").alias("members"), "report")


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """People's type spelled in one way, as the reports ask for it."""
    kind = F.when(F.lower("entity_type") == "person", "Person").otherwise(F.col("entity_type"))
    return _entities(spark, d).withColumn("entity_type", kind)


def community_inputs(spark: SparkSession, d: str) -> DataFrame:
    rows = community.report_inputs(_typed(spark, d), _edges(spark, d))
    return rows.select("group_id", "community_id", "people", F.array_join("names", "|").alias("names"), F.array_join("facts", "|").alias("facts"))


def community_reports(spark: SparkSession, d: str) -> DataFrame:
    return community.reports(community.report_inputs(_typed(spark, d), _edges(spark, d)))


def community_of(spark: SparkSession, d: str) -> DataFrame:
    return community.community_of(_entities(spark, d))


# Evaluation.


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the next item as predictions, so that some are right, some near and some wrong."""
    order = Window.partitionBy("sample_id").orderBy("item_id")
    return _items(spark, d).select("item_id", "category", F.col("answer").alias("gold"), F.lead("answer").over(order).alias("prediction")).withColumn(
        "judge", F.when(F.col("prediction").isNull(), -1.0).otherwise((F.col("prediction") == F.col("gold")).cast("double"))
    )


def token_f1(spark: SparkSession, d: str) -> DataFrame:
    return evalqa.scores(_answers(spark, d)).select("item_id", F.round("f1", 6).alias("f1"), "em")


def qa_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = evalqa.rollup(evalqa.scores(_answers(spark, d)))
    return rows.select("category", "n", F.round("avg_f1", 6).alias("avg_f1"), F.round("avg_em", 6).alias("avg_em"), "n_judged", F.round("avg_judge", 6).alias("avg_judge"))


def context_format(spark: SparkSession, d: str) -> DataFrame:
    rows = fusion.within_budget(_results(spark, d), 4000)
    return evalqa.contexts(rows, rows.select("query_id"))


def baseline_context(spark: SparkSession, d: str) -> DataFrame:
    rows = _results(spark, d).where("rank <= 10").select("query_id", (F.col("rank") - 1).alias("rank"), F.col("body").alias("content"))
    return evalqa.baseline_contexts(rows, rows.select("query_id"))


# Queue.


def queue_fold(spark: SparkSession, d: str) -> DataFrame:
    return jobs.latest(table(spark, d, "jobs")).select("id", "status", "attempts", "error")


def queue_stats(spark: SparkSession, d: str) -> DataFrame:
    return jobs.stats(jobs.latest(table(spark, d, "jobs")))


def queue_next(spark: SparkSession, d: str) -> DataFrame:
    return jobs.claim(jobs.latest(table(spark, d, "jobs")), F.lit(NOW).cast("timestamp"), 10).select("id")


def queue_payload(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs.payload(jobs.latest(table(spark, d, "jobs")))
    return rows.select("id", "content", "source", "group_id", F.round("temperature", 6).alias("temperature"))


def queue_fail(spark: SparkSession, d: str) -> DataFrame:
    failed = jobs.fail(jobs.latest(table(spark, d, "jobs")), F.col("status") == "processing", F.lit("lost"), F.lit(NOW).cast("timestamp"))
    return failed.select("id", "status", "attempts", "error", F.unix_micros("not_before").alias("not_before"))


def queue_recover(spark: SparkSession, d: str) -> DataFrame:
    return jobs.recover(jobs.latest(table(spark, d, "jobs")), F.lit(NOW).cast("timestamp")).select("id", "status")


def queue_requeue(spark: SparkSession, d: str) -> DataFrame:
    return jobs.requeue(jobs.latest(table(spark, d, "jobs")), F.lit(NOW).cast("timestamp")).select("id", "status", "attempts")


def queue_push(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("text", "source", "group_id")
    pushed = jobs.push(files.chunks(documents))
    read = pushed.withColumn("p", F.from_json("payload", "content string, source string, group_id string"))
    return read.groupBy("type", "status", "max_attempts", "p.source", "p.group_id").agg(F.count("*").alias("n"), F.sum(F.length("p.content")).alias("characters"))


def _ingested(spark: SparkSession, d: str) -> ingest.Graph:
    """The due jobs taken into an empty graph, read by pattern."""
    queue = cut_lineage(jobs.latest(table(spark, d, "jobs")))
    _, g = ingest.ingest(queue, ingest.Graph.empty(spark), PatternExtractor(), HashEmbedder(), F.lit(NOW).cast("timestamp"))
    return ingest.Graph(*[cut_lineage(t) for t in (g.episodes, g.entities, g.edges, g.links)])


def ingest_graph(spark: SparkSession, d: str) -> DataFrame:
    """Entities with their episodes, and the relations between them by the names of their ends."""
    g = _ingested(spark, d)
    names = g.entities.select("uuid", F.lower("name").alias("name"))
    linked = g.links.join(names, F.col("entity_uuid") == F.col("uuid")).join(g.episodes.select(F.col("uuid").alias("episode_uuid"), "group_id", "content"), "episode_uuid")
    ends = [names.select(F.col("uuid").alias(f"{e}_uuid"), F.col("name").alias(e)) for e in ("source", "target")]
    related = g.edges.join(ends[0], "source_uuid").join(ends[1], "target_uuid").select("group_id", F.lit("edge").alias("kind"), "source", "target")
    return linked.select("group_id", F.lit("link").alias("kind"), F.col("name").alias("source"), F.md5("content").alias("target")).unionByName(related)


def search_after_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The names of what was taken in, searched for in the graph."""
    g = _ingested(spark, d)
    asked = g.entities.select(F.col("uuid").alias("query_id"), F.col("name").alias("text"), "group_id", "embedding")
    found = fusion.search(asked, g.entities, g.edges, g.episodes)
    return found.select("query_id", "rank", "type", "uuid", "title", "body", F.round("score", 6).alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p3_found, hybrid_search, hybrid_search_plain, group_scan, edge_list, with_embedding, count_by_group, usable_vectors, last_source_name, episode_upsert_fold,
        entity_upsert_fold, edge_upsert_fold, link_fold, keep_first_edges, chunk_documents, chunk_lines, approx_tokens, normalize_answer, token_jaccard,
        fts_query_compile, intent_class, edge_class, entity_embed_text, ascii_key, cosine_pairs, vector_topk, knn20, mutual_knn, mutual_knn_incremental,
        neighbors, edges_for_entities, degree, multi_edge_weight, adjacency, components, entities_for_episodes, episodes_for_entities, entity_source,
        edge_source, corpus_stats, postings, spread_2hop, spreading_activation, lateral_inhibition, rrf_fusion, token_budget, temporal_decay,
        relative_cutoff, json_lines, resolve_clusters, resolve_canonical, merge_edges, merge_episodes, merge_entities, resolve_summary,
        curvature_cost_hist, edge_curvature, curvature_stats, curvature_status, top_bridges, louvain, knn_communities, community_list, community_inputs,
        community_reports, community_of, token_f1, qa_rollup, context_format, baseline_context, queue_fold, queue_stats, queue_next, queue_payload,
        queue_fail, queue_recover, queue_requeue, queue_push, ingest_graph, search_after_ingest,
    )
} | {f"bm25_{k}{'' if s else '_plain'}": _bm25(k, s) for k in ("entities", "edges", "episodes") for s in (True, False)}

__all__ = ["NOW", "QUERIES", "doubles"]
