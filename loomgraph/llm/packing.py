"""Documents into context windows of fixed capacity by sum-of-squares packing.

A document goes to the fill level at which the sum of the squared numbers of partly filled windows, counted
by level, becomes least; the numbers are kept in an array over the levels. A document longer than a window
is divided into full windows and a rest, any other stays whole. Shards of documents are packed apart; what lies in
windows that are left with much room is then packed again, over all shards.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut_lineage

SHARD_DOCUMENTS = 250_000  # documents packed in sequence by one task
WELL_FILLED = 0.95  # share of the capacity from which on a window stays as it is


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; a null or empty text has no tokens. Repeated doc_ids count once."""
    path = tokenizer or default_tokenizer()

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(path)
        return pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts])

    counted = documents.where(F.col("doc_id").isNotNull()).select("doc_id", count("text").alias("n_tokens"))
    return counted.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


class Levels:
    """Partly filled windows by fill level."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.counts = capacity, np.zeros(capacity + 1, np.int64)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.fills: list[int] = []

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset) for an item of 1 to capacity tokens; equal sums go to the fuller level."""
        last = self.capacity - size
        change = 2 * (self.counts[size:] - self.counts[: last + 1])
        change[1:] += 1
        change[:-1] += 1
        change[0] = 2 * self.counts[size] + 1 if last else 0
        if last:
            change[last] = 1 - 2 * self.counts[last]
        change[1 : last + 1][self.counts[1 : last + 1] == 0] = np.iinfo(np.int64).max
        level = last - int(np.argmin(change[::-1]))
        if level:
            window = self.bins[level].pop()
            self.counts[level] -= 1
        else:
            window = len(self.fills)
            self.fills.append(0)
        self.put(window, level + size)
        return window, level

    def put(self, window: int, fill: int) -> None:
        self.fills[window] = fill
        if fill < self.capacity:
            self.counts[fill] += 1
            self.bins[fill].append(window)


def _packed(pdf: pd.DataFrame, capacity: int, base: int) -> pd.DataFrame:
    """The parts (doc_id, piece, first_token, n_tokens) in windows numbered from base on, in the order given."""
    levels, windows, offsets = Levels(capacity), [], []
    for size in pdf.n_tokens.tolist():
        window, offset = levels.place(size)
        windows.append(window)
        offsets.append(offset)
    fills = np.array(levels.fills, np.int64)
    window = np.array(windows, np.int64)
    return pdf.assign(window=base + window, offset=np.array(offsets, np.int64), fill=fills[window] if len(window) else window)


PARTS = ["doc_id", "piece", "first_token", "n_tokens"]
PACKED = "window_id int, capacity bigint, shard bigint, doc_id bigint, piece bigint, first_token bigint, n_tokens bigint, window bigint, offset bigint, fill bigint"


def _pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["_order", "doc_id"], kind="stable")
    capacity, shard = int(pdf.capacity.iloc[0]), int(pdf.shard.iloc[0])
    size = pdf.n_tokens.to_numpy()
    pieces = -(-size // capacity)
    row = np.repeat(np.arange(len(pdf)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    parts = pd.DataFrame({"doc_id": pdf.doc_id.to_numpy()[row], "piece": piece, "first_token": piece * capacity, "n_tokens": np.minimum(capacity, size[row] - piece * capacity)})
    return _packed(parts, capacity, shard << 40).assign(window_id=pdf.window_id.iloc[0], capacity=capacity, shard=shard)


def _pack_again(pdf: pd.DataFrame) -> pd.DataFrame:
    """The parts of several windows packed anew, the largest first, unless that takes more windows."""
    ordered = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    again = _packed(ordered[PARTS], int(pdf.capacity.iloc[0]), int(pdf.shard.iloc[0]) << 40)
    if again.window.nunique() > pdf.window.nunique():
        return pdf
    return again.assign(window_id=pdf.window_id.iloc[0], capacity=pdf.capacity.iloc[0], shard=pdf.shard.iloc[0])


def pack_documents(counts: DataFrame, windows: DataFrame, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """(window_id, capacity, window, doc_id, piece, first_token, n_tokens, offset): where each part of each
    document (doc_id, n_tokens) lies, for each capacity in windows (window_id, n_tokens).

    Documents without tokens take no room and have no row; windows without a positive capacity are left
    out, as are null sizes and null doc_ids. Documents are spread by the hash of their id over shards of about
    shard_documents, each packed in sequence. Windows filled less than WELL_FILLED are emptied, and what they held
    is packed again in as few tasks of shard_documents parts as it needs. The window sizes are a few settings that
    the driver holds.
    """
    sizes = windows.where("window_id IS NOT NULL AND n_tokens > 0").groupBy("window_id").agg(F.max("n_tokens").alias("n")).orderBy("window_id").collect()
    spark = counts.sparkSession
    result = ["window_id", "capacity", "window", "doc_id", "piece", "first_token", "n_tokens", "offset"]
    if not sizes:
        return spark.createDataFrame([], PACKED).select(*result)
    each = F.explode(F.array(*[F.struct(F.lit(r.window_id).cast("int").alias("window_id"), F.lit(r.n).cast("bigint").alias("capacity")) for r in sizes]))
    items = counts.where("doc_id IS NOT NULL AND n_tokens > 0").select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"))
    shards = max(1, -(-items.count() // shard_documents))
    order = F.xxhash64("doc_id")
    items = items.withColumn("_order", order).withColumn("shard", F.pmod(F.col("_order"), F.lit(shards))).withColumn("_w", each).select("*", "_w.*")
    placed = cut_lineage(items.groupBy("window_id", "shard").applyInPandas(_pack_shard, PACKED))
    kept = F.col("fill") >= WELL_FILLED * F.col("capacity")
    loose = placed.where(~kept)
    tasks = {r.window_id: -(-r.n // shard_documents) for r in loose.groupBy("window_id").agg(F.count("*").alias("n")).collect()}
    if not tasks:
        return placed.select(*result)
    groups = F.element_at(F.create_map(*[F.lit(x) for pair in tasks.items() for x in pair]), F.col("window_id"))
    again = loose.withColumn("shard", F.lit(shards) + F.pmod(F.xxhash64("window"), groups)).groupBy("window_id", "shard").applyInPandas(_pack_again, PACKED)
    return placed.where(kept).select(*result).unionByName(again.select(*result))


def room_left(packed: DataFrame) -> DataFrame:
    """(window_id, capacity, n_windows, n_tokens, room): how full the windows of each capacity are."""
    used = packed.groupBy("window_id", "capacity").agg(F.countDistinct("window").alias("n_windows"), F.sum("n_tokens").alias("n_tokens"))
    return used.withColumn("room", F.col("n_windows") * F.col("capacity") - F.col("n_tokens"))
