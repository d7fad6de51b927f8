"""Vector search and mutual-nearest-neighbour graphs by blocked matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import cut_lineage

BLOCK = 8_192


def _vectors(df: DataFrame) -> DataFrame:
    rows = df.select("group_id", F.size("embedding").alias("dim"), "id", "embedding")
    return rows.where(F.col("id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))


def similar(vectors: DataFrame, queries: DataFrame, threshold: float, k: int) -> DataFrame:
    """(query_id, id, score, rank): vectors of the query's group with cosine above threshold, the k best.

    vectors: id, embedding, group_id; queries: query_id, embedding, group_id. Blocks of queries meet blocks of
    their group's vectors as in nearest_neighbours, so a group of any size is spread. Rows without a vector
    are in no result.
    """
    asked = queries.select(F.concat(F.lit("?"), F.col("query_id").cast("string")).alias("id"), "query_id", "group_id", "embedding")
    near = nearest_neighbours(vectors, k, asked=asked).where(F.col("score") > threshold)
    return near.join(asked.select("id", "query_id"), "id").select("query_id", F.col("other").alias("id"), "score", (F.col("rank") - 1).alias("rank"))


def _units(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors of length one) of rows of one dimension, in the order of ids; without those of a null, not finite or no length."""
    ids, vectors = np.array(table["id"].to_pylist(), object), table["embedding"].combine_chunks().flatten()
    x = vectors.to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), len(vectors) // max(1, len(ids)))
    size = np.sqrt((x * x).sum(1))
    fits = np.flatnonzero(np.isfinite(size) & (size > 0))
    fits = fits[np.argsort(ids[fits], kind="stable")]
    return ids[fits], x[fits] / size[fits, None]


def _best_of_block(k: int):
    """Pairs of a block of rows and a block of others: the k best others for each row."""

    def run(keys: tuple, table: pa.Table) -> pa.Table:
        ids, a = _units(table.filter(table["own"]))
        other_ids, b = _units(table.filter(pa.compute.invert(table["own"])))
        if not len(ids) or not len(other_ids):
            return SCHEMA_EMPTY
        rows: tuple[list, list, list] = ([], [], [])
        for lo in range(0, len(a), 512):
            s = a[lo : lo + 512] @ b.T
            s[ids[lo : lo + 512, None] == other_ids[None]] = -np.inf
            top = min(k, s.shape[1])
            least = np.partition(s, s.shape[1] - top, axis=1)[:, s.shape[1] - top]
            r, c = np.nonzero(s >= least[:, None] - 1e-9)  # scores are rounded before ranking
            keep = s[r, c] > -np.inf
            x, y = r[keep], c[keep]
            rows[0].extend(ids[lo + x])
            rows[1].extend(other_ids[y])
            rows[2].extend(s[x, y].tolist())
        return pa.table({"id": pa.array(rows[0], pa.string()), "other": pa.array(rows[1], pa.string()), "score": pa.array(rows[2], pa.float64())})

    return run


SCHEMA_EMPTY = pa.table({"id": pa.array([], pa.string()), "other": pa.array([], pa.string()), "score": pa.array([], pa.float64())})


def nearest_neighbours(vectors: DataFrame, k: int = 20, block: int = BLOCK, asked: DataFrame | None = None) -> DataFrame:
    """(group_id, id, other, score, rank): exact k nearest others within each group by cosine.

    vectors: id, group_id, embedding, one row an id; asked, of the same columns, is whose neighbours come out,
    by default all. Every group is cut into blocks of about `block` rows on both sides; each pair of blocks is
    one task of a bounded size, whatever the size of the group, and sends on only k candidates a row. Only
    vectors of the same dimension are neighbours; they are brought to length one in the tasks. Scores are rounded to 9 decimals, equal ones ordered by id.
    """
    key = ["group_id", "dim"]
    unit = cut_lineage(_vectors(vectors))
    mine = unit if asked is None else cut_lineage(_vectors(asked))
    blocks = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = blocks(unit, "others").join(blocks(mine, "owns"), key)
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = mine.join(sizes, key).select(*key, "id", "embedding", part("owns").alias("x"), every("others").alias("y"), F.lit(True).alias("own"))
    others = unit.join(sizes, key).select(*key, "id", "embedding", every("owns").alias("x"), part("others").alias("y"), F.lit(False).alias("own"))
    best = own.unionByName(others).groupBy(*key, "x", "y").applyInArrow(_best_of_block(k), "id string, other string, score double")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    ranked = best.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(mine.select("id", "group_id"), "id").select("group_id", "id", "other", "score", "rank")


def mutual_edges(neighbours: DataFrame) -> DataFrame:
    """(group_id, source_uuid, target_uuid): pairs that are among each other's nearest, each once, smaller first."""
    there = neighbours.select("group_id", "id", "other")
    back = neighbours.select("group_id", F.col("other").alias("id"), F.col("id").alias("other"))
    both = there.join(back, ["group_id", "id", "other"], "left_semi").where("id < other")
    return both.select("group_id", F.col("id").alias("source_uuid"), F.col("other").alias("target_uuid"))


def append_mutual(existing: DataFrame, added: DataFrame, edges: DataFrame, k: int = 20) -> DataFrame:
    """Mutual edges after new vectors came in: those of before and those between a new vector and any other.

    existing, added: id, group_id, embedding. A new vector offers itself to its k nearest; one accepts when
    it has fewer than k others or the newcomer is nearer than its k-th. Edges are only ever added. Groups
    with fewer than k vectors before stay as they are. Only the neighbours of new vectors, and then of those that
    these offer themselves to, are searched for.
    """
    full = existing.groupBy("group_id").count().where(F.col("count") >= k).select("group_id")
    fresh = cut_lineage(added.join(full, "group_id", "left_semi").select("group_id", "id", "embedding"))
    every = cut_lineage(existing.select("group_id", "id", "embedding").unionByName(fresh))
    offers = cut_lineage(nearest_neighbours(every, k, asked=fresh).select("group_id", "id", "other"))
    offered = offers.select(F.col("other").alias("id")).distinct().join(fresh.select("id"), "id", "left_anti")
    answers = nearest_neighbours(every, k, asked=every.join(offered, "id", "left_semi")).select("group_id", "id", "other").unionByName(offers)
    accepted = offers.join(answers.select("group_id", F.col("other").alias("id"), F.col("id").alias("other")), ["group_id", "id", "other"], "left_semi")
    new = accepted.select("group_id", F.least("id", "other").alias("source_uuid"), F.greatest("id", "other").alias("target_uuid"))
    return edges.select("group_id", "source_uuid", "target_uuid").unionByName(new).distinct()
