"""Question answering over conversations: rendering, contexts and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import exact_match, temporal_tag, token_f1, truncate

# Names of the question categories.
CATEGORIES = {1: "single-hop", 2: "multi-hop", 3: "temporal", 4: "open-domain", 5: "adversarial"}
# What stands for an empty context.
NO_FACTS, NO_DIALOGUE = "(no relevant facts found)", "(no relevant dialogue found)"


def render_sessions(turns: DataFrame) -> DataFrame:
    """(sample_id, session, text) of turns (sample_id, session, date, turn, speaker, text, caption).

    The date in brackets, then a line for each turn; a turn without text shows its picture's caption.
    """
    said = F.coalesce(F.nullif("text", F.lit("")), F.concat(F.lit("[image: "), F.col("caption"), F.lit("]")), F.lit(""))
    line = F.struct("turn", F.concat(F.col("speaker"), F.lit(": "), said).alias("line"))
    lines = turns.groupBy("sample_id", "session").agg(F.first("date", True).alias("date"), F.array_sort(F.collect_list(line)).alias("lines"))
    text = F.concat(F.lit("["), F.coalesce("date", F.lit("")), F.lit("]\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return lines.select("sample_id", "session", text.alias("text"))


def contexts(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, context): background, then facts with the tag of their session, then dialogue cut at 1500, numbered throughout."""
    order = F.when(F.col("type") == "community", 1).when(F.col("type") == "edge", 2).otherwise(3)
    body = F.coalesce("body", F.lit(""))
    line = (
        F.when(F.col("type") == "community", F.concat(F.lit("[background] "), body))
        .when(F.col("type") == "edge", F.concat(temporal_tag(F.coalesce("source", F.lit(""))), body))
        .otherwise(F.concat(F.lit("[dialogue] "), truncate(body, 1500)))
    )
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "rank"))
    numbered = results.where(F.col("type").isin("community", "edge", "episode")).select("query_id", n.alias("n"), line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: F.concat(x["n"].cast("string"), F.lit(". "), x["line"], F.lit("\n"))), "")
    made = numbered.groupBy("query_id").agg(text.alias("context"))
    return queries.select("query_id").distinct().join(made, "query_id", "left").select("query_id", F.coalesce("context", F.lit(NO_FACTS)).alias("context"))


def baseline_contexts(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, context) of episode hits (query_id, rank from 0, content), each cut at 500."""
    line = F.concat((F.col("rank") + 1).cast("string"), F.lit(". "), truncate(F.coalesce("content", F.lit("")), 500), F.lit("\n"))
    made = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "").alias("context"))
    return queries.select("query_id").distinct().join(made, "query_id", "left").select("query_id", F.coalesce("context", F.lit(NO_DIALOGUE)).alias("context"))


def scores(answers: DataFrame) -> DataFrame:
    """answers (prediction, gold, ...) with f1 and em; a null counts as empty."""
    p, g = F.coalesce("prediction", F.lit("")), F.coalesce("gold", F.lit(""))
    return answers.withColumns({"f1": token_f1(p, g), "em": exact_match(p, g)})


def rollup(scored: DataFrame) -> DataFrame:
    """(category, n, avg_f1, avg_em, n_judged, avg_judge) for each category and 'overall'; judge under 0 means not judged."""
    judged = F.when(F.col("judge") >= 0, F.col("judge"))
    name = F.lit(None).cast("string")
    for number, label in CATEGORIES.items():
        name = F.when(F.col("category") == number, label).otherwise(name)
    rows = scored.withColumn("_name", F.coalesce(name, F.concat(F.lit("cat-"), F.col("category").cast("string"))))
    total = rows.rollup("_name").agg(F.count("*").alias("n"), F.avg("f1").alias("avg_f1"), F.avg("em").alias("avg_em"), F.count(judged).alias("n_judged"), F.coalesce(F.avg(judged), F.lit(0.0)).alias("avg_judge"), F.grouping("_name").alias("_all"))
    return total.select(F.when(F.col("_all") == 1, "overall").otherwise(F.col("_name")).alias("category"), "n", "avg_f1", "avg_em", "n_judged", "avg_judge")
