"""Verbs on a folder of tables: ingest, search, status, communities, curvature, resolve, retry, worker, bench, run."""

from __future__ import annotations

import argparse
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import activation, community, curvature, evalqa, folds, fusion, graph, ingest, jobs, resolve
from loomgraph.operators.ingest import Graph
from loomgraph.plans import benchmark
from loomgraph.session import build_session
from loomgraph.sources import conversations, files
from loomgraph.sources.providers import Embedder, Extractor, FirstFactAnswerer, HashEmbedder, PatternExtractor, embed_column
from loomgraph.sources.store import Store


def threshold(text: str) -> float:
    value = float(text)
    if not 0 < value <= 1:
        raise argparse.ArgumentTypeError("a threshold lies above 0 and up to 1")
    return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomgraph")
    top.add_argument("--store", default=os.environ.get("MEMORY_DB", "memory"))
    top.add_argument("--group", default=os.environ.get("MEMORY_GROUP", "default"))
    verbs = top.add_subparsers(dest="verb", required=True)
    for name in ("ingest", "run"):
        v = verbs.add_parser(name)
        v.add_argument("root")
        v.add_argument("--source")
    v = verbs.add_parser("search")
    v.add_argument("words", nargs="+")
    v.add_argument("--limit", type=int, default=10)
    v.add_argument("--format", choices=("text", "json"), default="text")
    v.add_argument("--max-tokens", type=int, default=0)
    v = verbs.add_parser("bench")
    v.add_argument("path")
    v.add_argument("--limit", type=int, default=benchmark.GRAPH_LIMIT)
    verbs.add_parser("worker")
    verbs.add_parser("retry")
    verbs.add_parser("status")
    v = verbs.add_parser("communities")
    v.add_argument("--detect", action="store_true")
    v.add_argument("--knn", action="store_true")
    v.add_argument("--min-members", type=int, default=2)
    v = verbs.add_parser("curvature")
    v.add_argument("--compute", action="store_true")
    v.add_argument("--top", type=int, default=10)
    v = verbs.add_parser("resolve")
    v.add_argument("--threshold", type=threshold, default=threshold(os.environ.get("MEMORY_RESOLVE_THRESHOLD", "0.85")))
    v.add_argument("--dry-run", action="store_true")
    return top


def _print(df: DataFrame) -> None:
    """A small table as aligned lines."""
    rows = [df.columns, *[[f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in df.collect()]]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    print("\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in rows))


def load(store: Store) -> Graph:
    """The graph in a store, empty where nothing has been taken in yet."""
    have, empty = store.tables(), Graph.empty(store.spark)
    named = {"episodes": empty.episodes, "entities": empty.entities, "edges": empty.edges, "entity_episodes": empty.links}
    return Graph(*[store.read(n).select(*e.columns) if n in have else e for n, e in named.items()])


def _stamped(pushed: DataFrame) -> DataFrame:
    none = F.lit(None)
    stamps = {"id": F.xxhash64("payload"), "error": none.cast("string"), "not_before": none.cast("timestamp"), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp()}
    return pushed.withColumns(stamps)


def _merge_jobs(store: Store, fresh: DataFrame) -> None:
    """Jobs that the queue has already, whatever has become of them, stay as they are."""
    if "jobs" in store.tables():
        old = store.read("jobs")
        fresh = old.unionByName(fresh.join(old.select("id"), "id", "left_anti"), True)
    store.write("jobs", jobs.latest(fresh))


def drain(store: Store, extractor: Extractor | None = None, embedder: Embedder | None = None) -> None:
    """Batches of the queue until no job is due; then communities and reports, if anything was taken in."""
    extractor, embedder, dirty = extractor or PatternExtractor(), embedder or HashEmbedder(), False
    while "jobs" in store.tables():
        queue, now = store.read("jobs"), F.lit(datetime.now(timezone.utc))
        if jobs.eligible(jobs.recover(queue, now), now).isEmpty():
            break
        after, g = ingest.ingest(queue, load(store), extractor, embedder, now)
        for name, df in (("episodes", g.episodes), ("entities", g.entities), ("edges", g.edges), ("entity_episodes", g.links)):
            store.write(name, df)
        store.write("jobs", after)
        dirty = True
    if dirty:
        detect(store)


def _ordered(df: DataFrame) -> DataFrame:
    """Rows with seq by the time they were made, as stored tables keep no order of arrival."""
    return df.withColumn("seq", F.unix_micros("created_at"))


def detect(store: Store, by_vectors: bool = False) -> None:
    """Communities of the edges, or of mutual neighbours, whose graph and curvatures are kept."""
    g = load(store)
    if by_vectors:
        vectors = g.entities.where("size(embedding) > 0").select("group_id", F.col("uuid").alias("id"), "embedding")
        store.write("mutual_knn", community.neighbour_graph(vectors, store.read("mutual_knn") if "mutual_knn" in store.tables() else None))
        curved, found = community.neighbour_communities(store.read("mutual_knn"))
        before = store.read("edge_curvatures") if "edge_curvatures" in store.tables() else curved.limit(0)
        store.write("edge_curvatures", folds.replace_group(before, curved))
    else:
        found = community.louvain(graph.pair_weights(g.edges, g.entities), g.entities)
    whole = folds.write_communities(g.entities, found)
    store.write("entities", whole)
    store.write("community_reports", community.reports(community.report_inputs(load(store).entities, _ordered(g.edges))))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session()
    store = Store(spark, args.store)
    own = lambda name: store.read(name).where(F.col("group_id") == args.group)
    now = F.current_timestamp()
    if args.verb in ("ingest", "run"):
        _merge_jobs(store, _stamped(files.enqueue(spark, args.root, args.group, args.source, files.cascade(files.text_layer))))
    if args.verb in ("worker", "run"):
        drain(store)
    elif args.verb == "bench":
        samples = conversations.read(spark, args.path)
        _merge_jobs(store, benchmark.session_jobs(evalqa.render_sessions(conversations.turns(samples))))
        drain(store)
        asked = conversations.questions(samples).select(F.concat_ws("/", "sample_id", "question_no").alias("query_id"), "question", "gold", "category", F.col("sample_id").alias("group_id"))
        model = FirstFactAnswerer()
        result = benchmark.evaluate(load(store), asked, HashEmbedder(), model, model, args.limit)
        _print(result.orderBy("mode", "category"))
    elif args.verb == "retry":
        store.write("jobs", jobs.requeue(store.read("jobs"), now))
    elif args.verb == "status":
        _print(jobs.stats(store.read("jobs")).orderBy("status"))
    elif args.verb == "search":
        text = " ".join(args.words)
        asked = embed_column(spark.createDataFrame([(1, text, args.group)], "query_id bigint, text string, group_id string"), "text", HashEmbedder())
        g = load(store)
        found = fusion.search(asked, *(t.where(F.col("group_id") == args.group) for t in (g.entities, g.edges, g.episodes)), args.limit, activation.Spread())
        found = fusion.within_budget(found, args.max_tokens) if args.max_tokens else found
        if args.format == "json":
            lines = fusion.as_json_lines(found.withColumn("score", F.round("score", 6))).orderBy("rank").limit(args.limit)
            print("\n".join(r.line for r in lines.collect()))
        else:
            for r in found.orderBy("rank").limit(args.limit).collect():
                print(f"{r['rank']}. [{r.type}] {r.title or ''} ({r.score:.3f})\n   {r.body or ''}")
    elif args.verb == "communities":
        if args.detect or args.knn:
            detect(store, args.knn)
        _print(community.listing(load(store).entities.where(F.col("group_id") == args.group), store.read("community_reports"), args.min_members).orderBy("community_id").limit(50))
    elif args.verb == "curvature":
        if args.compute:
            store.write("edge_curvatures", curvature.curvatures(graph.known_pairs(load(store).edges, load(store).entities)))
        _print(curvature.status(own("edge_curvatures")))
        _print(curvature.top_bridges(own("edge_curvatures"), load(store).entities.where(F.col("group_id") == args.group), args.top))
    elif args.verb == "resolve":
        g = load(store)
        entities, edges, links = _ordered(g.entities), _ordered(g.edges), g.links
        members = resolve.clusters(resolve.candidate_pairs(entities, args.threshold))
        _print(resolve.summary(members, edges, links, args.dry_run))
        if not args.dry_run:
            moved = resolve.renames(members, resolve.canonical(members, entities, edges))
            store.write("edges", resolve.merge_edges(edges, moved).drop("seq"))
            store.write("entity_episodes", resolve.relink_episodes(links, moved))
            store.write("entities", resolve.drop_merged(entities, moved).drop("seq"))


if __name__ == "__main__":
    main()
