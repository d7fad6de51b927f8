"""Spreading activation: a beam that walks the graph from seed entities, many queries at once."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import transition
from loomgraph.functions.vectors import cosine
from loomgraph.session import cut_lineage


@dataclass(frozen=True)
class Spread:
    """Limits of the walk; zeros stand for the defaults, lambdas only where negative."""

    width: int = 10
    hops: int = 5
    nodes: int = 200
    decay: float = 0.5
    lambda1: float = 1.0
    lambda2: float = 0.0
    threshold: float = 0.0

    def filled(self) -> Spread:
        return replace(
            self, width=self.width or 10, hops=self.hops or 5, nodes=self.nodes or 200, decay=self.decay or 0.5,
            lambda1=1.0 if self.lambda1 < 0 else self.lambda1, lambda2=0.5 if self.lambda2 < 0 else self.lambda2,
        )


def spread(seeds: DataFrame, near: DataFrame, queries: DataFrame, entities: DataFrame, spread: Spread = Spread()) -> DataFrame:  # noqa: B008
    """(query_id, uuid, activation) before inhibition, the seeds included, at most `nodes` a query.

    seeds: query_id, uuid; near: group_id, uuid, neighbour, fact, edge_name as from graph.neighbours;
    queries: query_id, group_id, intent, embedding; entities: uuid, embedding. The frontier holds rows, not
    distinct entities: an entity reached twice expands twice. A row of score s passes (s * decay + S) / fan
    to every neighbour that is not visited, fan being all neighbour rows of it. The best `width` candidate
    rows of a query go on; the others keep what they have gathered and may be reached again. Ties go to the
    smaller uuid, then relation name and fact; scores are rounded to 12 decimals, sums to 9. Without seeds
    there are no rows.
    """
    cfg = spread.filled()
    asked = queries.select("query_id", "group_id", "intent", F.col("embedding").alias("_q"))
    frontier = cut_lineage(seeds.select("query_id", "uuid", F.lit(1.0).alias("score")).distinct())
    visited = frontier.select("query_id", "uuid")
    gathered = frontier.select("query_id", "uuid", F.col("score").alias("activation"))
    fans = near.groupBy("group_id", "uuid").agg(F.count("*").alias("fan"))
    walk = cut_lineage(near.select("group_id", "uuid", "neighbour", "edge_name", "fact").join(fans, ["group_id", "uuid"]))  # read in every hop
    vectors = entities.select(F.col("uuid").alias("neighbour"), F.col("embedding").alias("_v")).dropDuplicates(["neighbour"])
    for _ in range(cfg.hops):
        open_queries = visited.groupBy("query_id").count().where(F.col("count") < cfg.nodes).select("query_id")
        going = frontier.join(open_queries, "query_id", "left_semi").join(asked, "query_id")
        steps = going.join(walk, ["group_id", "uuid"])
        fresh = steps.join(visited.select("query_id", F.col("uuid").alias("neighbour")), ["query_id", "neighbour"], "left_anti")
        fresh = fresh.join(vectors, "neighbour", "left") if cfg.lambda2 else fresh.withColumn("_v", F.lit(None).cast("array<float>"))
        value = (F.col("score") * cfg.decay + transition(F.col("intent"), F.col("edge_name"), cosine(F.col("_v"), F.col("_q")), cfg.lambda1, cfg.lambda2)) / F.col("fan")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "uuid", "edge_name", "fact")
        reached = fresh.select("query_id", F.col("neighbour").alias("uuid"), F.round(value, 12).alias("score"), "edge_name", "fact")
        reached = cut_lineage(reached.select("query_id", "uuid", "score", F.row_number().over(order).alias("_n")))
        frontier = reached.where(F.col("_n") <= cfg.width).select("query_id", "uuid", "score")
        if frontier.isEmpty():
            break
        gathered = gathered.unionByName(reached.select("query_id", "uuid", F.col("score").alias("activation")))
        visited = visited.unionByName(frontier.select("query_id", "uuid").distinct())
    total = gathered.groupBy("query_id", "uuid").agg(F.round(F.sum("activation"), 9).alias("activation")).where(F.col("activation") >= cfg.threshold)
    top = Window.partitionBy("query_id").orderBy(F.desc("activation"), "uuid")
    return total.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= cfg.nodes).drop("_n")


def inhibit(activated: DataFrame, top: int = 7, beta: float = 0.15) -> DataFrame:
    """Lateral inhibition: each row loses beta times what the `top` rows above it have more; rows not above 0 go."""
    order = Window.partitionBy("query_id").orderBy(F.desc("activation"), "uuid")
    ranked = activated.withColumn("_i", F.row_number().over(order) - 1)
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    strong = F.sum(F.when(F.col("_i") < top, F.col("activation"))).over(above)
    n = F.least(F.col("_i"), F.lit(top))
    left = F.col("activation") - beta * (F.coalesce(strong, F.lit(0.0)) - n * F.col("activation"))
    return ranked.withColumn("activation", F.round(left, 9)).where(F.col("activation") > 0).drop("_i")
