"""Question answering over conversations from end to end: ingest, search or plain text hits, answer, score."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import activation, evalqa, fusion, jobs, search_text
from loomgraph.operators.ingest import Graph
from loomgraph.session import cut_lineage
from loomgraph.sources.providers import Answerer, Embedder, Judge, apply_model, embed_column

GRAPH_LIMIT, BASELINE_LIMIT = 25, 10
ANSWER_TOKENS = 32
TASK = "Answer the question from the numbered notes alone, in as few words as you can. Say so if they do not hold the answer."


def session_jobs(rendered: DataFrame, created_at=None) -> DataFrame:
    """Jobs of sessions (sample_id, session, text): each sample is a group, its source names the session."""
    chunks = rendered.select(F.col("text").alias("content"), F.concat(F.lit("session_"), F.col("session").cast("string")).alias("source"), F.col("sample_id").alias("group_id"))
    at = F.current_timestamp() if created_at is None else created_at
    none = F.lit(None)
    return jobs.push(chunks).withColumns({"id": F.xxhash64("payload"), "error": none.cast("string"), "not_before": none.cast("timestamp"), "created_at": at, "updated_at": at})


def contexts_of(graph: Graph, questions: DataFrame, embedder: Embedder, baseline: bool, limit: int = GRAPH_LIMIT) -> DataFrame:
    """(query_id, context) of questions (query_id, question, group_id): of a hybrid search, or as baseline of the
    BASELINE_LIMIT best episodes by text."""
    asked = questions.select("query_id", F.col("question").alias("text"), "group_id")
    if baseline:
        docs = graph.episodes.select(F.col("uuid").alias("doc"), F.col("content").alias("text"), "group_id")
        hits = search_text.bm25(docs, asked, BASELINE_LIMIT).join(graph.episodes.select(F.col("uuid").alias("doc"), "content"), "doc")
        return evalqa.baseline_contexts(hits, asked)
    found = fusion.search(embed_column(asked, "text", embedder), graph.entities, graph.edges, graph.episodes, limit, activation.Spread())
    return evalqa.contexts(found, asked)


def answered(contexts: DataFrame, questions: DataFrame, answerer: Answerer, judge: Judge | None = None, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(query_id, category, gold, prediction, judge): judge is 1 or 0, or -1 without a judge or where a model failed."""
    both = questions.select("query_id", "question", "gold", "category").join(contexts, "query_id")
    prompt = F.concat(F.lit("Notes:\n"), F.col("context"), F.lit("\nQuestion: "), F.col("question"))
    said = cut_lineage(apply_model(both.withColumn("_p", prompt), lambda text: answerer.answer(TASK, text, ANSWER_TOKENS), "_a", "_p", wait=wait))
    said = said.withColumn("prediction", F.coalesce("_a.reply", F.lit("")))
    verdict = F.lit(-1.0)
    if judge is not None:
        said = apply_model(said, lambda q, gold, p: "yes" if judge.judge(q, gold or "", p) else "no", "_j", "question", "gold", "prediction", wait=wait)
        verdict = F.when(F.col("_j.reply").isNotNull() & F.col("_a.error").isNull(), F.startswith("_j.reply", F.lit("yes")).cast("double")).otherwise(-1.0)
    return said.select("query_id", "category", "gold", "prediction", verdict.alias("judge"))


def evaluate(
    graph: Graph, questions: DataFrame, embedder: Embedder, answerer: Answerer, judge: Judge | None = None, limit: int = GRAPH_LIMIT, wait: Callable[[float], None] = time.sleep
) -> DataFrame:
    """(mode, category, n, avg_f1, avg_em, n_judged, avg_judge) for the modes 'baseline' and 'graph'."""
    parts = []
    for mode in ("baseline", "graph"):
        found = contexts_of(graph, questions, embedder, mode == "baseline", limit)
        parts.append(evalqa.rollup(evalqa.scores(cut_lineage(answered(found, questions, answerer, judge, wait)))).withColumn("mode", F.lit(mode)))
    return parts[0].unionByName(parts[1])
