"""The k most similar vectors of given vectors: multi-index hashing over learned rotated binary codes.

Codes are signs of rotated components (principal axes, then rotations fitted so that signs lose least).
Every block of rows is indexed once: its codes are split into four substrings of about the logarithm of a block's
rows, each with a bucket table, and the queries probe all buckets that a code within the Hamming radius must be in
one of; those are ranked again by their floats. The k-th best cosine to a sample sets the radius of a query. Where
its buckets would be so many that they prune nothing, the query is compared with the floats of the whole block,
many queries at once, which loses no row. Rows are never shuffled, only the best k of each block.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.vectors import usable
from loomgraph.session import cut_lineage

SAMPLE_ROWS = 20_000  # rows that the rotations are fitted on, at most about this many
BLOCK_ROWS = 262_144  # rows indexed together, at most: with their index about 100 MB
TASK_ROWS = 196_608  # rows read by one task, about, so that most tasks have one block
BLOCK_QUERIES = 4_096  # queries sent to the executors together: their vectors take about 1 MB
SUBSTRING = 16  # bits of a substring: about as many buckets as a block has rows
LOOKUP = 128  # rows that are compared in the time of one bucket's lookup, about, as measured
TILE = 8_192  # rows compared with TOGETHER queries at once, so that their cosines stay in the processor's cache
TOGETHER = 64
FIRST_LOOK = 8  # nearest codes for each wanted row that raise the floor
SLACK = 1e-5  # more than the error of a cosine in single precision
KEPT = 0.998  # share of the pairs at the k-th best cosine that the Hamming radius is to keep


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Codes:
    """Rotations and the Hamming distance that vectors of a given cosine stay within."""

    def __init__(self, sample: np.ndarray, bits: int = 64, rounds: int = 25, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.centre = sample.mean(0)
        x = sample - self.centre
        rotations = []
        for _ in range(-(-bits // dim)):
            _, axes = np.linalg.eigh(np.cov(x.T) + 1e-9 * np.eye(dim))
            v = x @ axes
            r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
            for _ in range(rounds):
                u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
                r = (u @ w).T
            rotations.append(axes @ r)
        self.rotation = np.concatenate(rotations, axis=1)[:, :bits]
        self.bits = self.rotation.shape[1]
        self._calibrate(sample, rng)

    def _calibrate(self, sample: np.ndarray, rng: np.random.Generator) -> None:
        """radius[i]: the distance that the share KEPT of the pairs of cosine from i / 32 - 1 on stays within."""
        unit, codes = unit_rows(sample), self.encode(sample)
        counts = np.zeros((65, self.bits + 1), np.int64)
        for rows in np.array_split(rng.permutation(len(unit))[:1000], 50):
            step = np.clip(np.floor((unit[rows] @ unit.T + 1) * 32).astype(np.int64), 0, 64)
            far = np.bitwise_count(codes[rows][:, None] ^ codes[None]).astype(np.int64)
            counts += np.bincount((step * (self.bits + 1) + far).ravel(), minlength=counts.size).reshape(counts.shape)
        radius = np.full(65, self.bits, np.int64)
        for i in range(65):
            if (n := counts[i].sum()) >= 2:
                radius[i] = int(np.searchsorted(np.cumsum(counts[i]), KEPT * n))
            elif i:
                radius[i] = radius[i - 1]
        self.radius = np.maximum.accumulate(radius[::-1])[::-1]  # closer pairs are not farther apart

    def encode(self, x: np.ndarray) -> np.ndarray:
        signs = (np.asarray(x, np.float64) - self.centre) @ self.rotation > 0
        packed = np.zeros((len(signs), 8), np.uint8)
        packed[:, : -(-self.bits // 8)] = np.packbits(signs, axis=1)
        return packed.view(np.uint64).ravel()

    def within(self, cosine: float) -> int:
        return int(self.radius[min(64, max(0, int((cosine + 1) * 32)))])


def flips(radius: int) -> np.ndarray:
    """Numbers of SUBSTRING bits with at most radius of them set, by how many are."""
    every = np.arange(1 << SUBSTRING)
    ones = np.bitwise_count(every)
    order = np.argsort(ones, kind="stable")
    return every[order][: int((ones <= radius).sum())].astype(np.uint16)


@functools.cache
def buckets_within(radius: int, parts: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The buckets of a code of zeros that are probed for a radius, how many each substring has, and its radius."""
    a, b = divmod(radius, parts)
    radii = [min(SUBSTRING, a if t <= b else a - 1) for t in range(parts)]
    each = [flips(r).astype(np.uint32) | np.uint32(t << SUBSTRING) for t, r in enumerate(radii)]
    return np.concatenate(each), np.array([len(x) for x in each]), radii


def kth_best(values: np.ndarray, k: int) -> float:
    """-2 where there are fewer than k values."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -2.0


class Block:
    """The multi-index of one block of rows: for each substring the rows and their codes in the order of its value."""

    def __init__(self, model: Codes, uuids: np.ndarray, vectors: np.ndarray) -> None:
        uuids, first = np.unique(uuids, return_index=True)  # sorted, so that ties fall to the smaller uuid
        self.uuids, self.vectors, self.model = uuids, vectors[first], model
        self.unit = np.empty(self.vectors.shape, np.float32)
        self.codes = np.empty(len(uuids), np.uint64)
        for at in range(0, len(uuids), TILE):  # only a tile is held in double precision
            self.unit[at : at + TILE] = unit_rows(self.vectors[at : at + TILE])
            self.codes[at : at + TILE] = model.encode(self.vectors[at : at + TILE])
        self.parts = -(-model.bits // SUBSTRING)
        strings = self.codes.view(np.uint16).reshape(-1, 4)[:, : self.parts].T
        order = [np.argsort(x, kind="stable").astype(np.int32) for x in strings]
        self.order, self.ordered = np.concatenate(order), np.concatenate([self.codes[x] for x in order])
        self.size = np.concatenate([np.bincount(x, minlength=1 << SUBSTRING) for x in strings]).astype(np.int32)
        self.start = (np.cumsum(self.size) - self.size).astype(np.int32)  # tables of all substrings in one

    def pays(self, radius: int) -> bool:
        """Whether the buckets of a radius are so few that their lookup takes less time than to compare all rows."""
        return len(buckets_within(radius, self.parts)[0]) * LOOKUP <= len(self.uuids)

    def near(self, code: np.uint64, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows with a code within radius, each once, and how far they are.

        With radius = parts * a + b, such a code is within a of one of the first b + 1 substrings or within
        a - 1 of one of the others, else its distances would sum up to more.
        """
        flipped, lengths, radii = buckets_within(radius, self.parts)
        buckets = flipped ^ np.repeat(np.array([code]).view(np.uint16)[: self.parts], lengths)
        size = self.size[buckets]
        filled = np.flatnonzero(size)
        size, low = size[filled], self.start[buckets[filled]]
        ends = np.cumsum(size, dtype=np.int32)
        places = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(low - (ends - size), size)
        apart = self.ordered[places] ^ code
        bits = np.bitwise_count(apart)
        hit = np.flatnonzero(bits <= radius)
        places, strings, bits = places[hit], np.bitwise_count(apart[hit].view(np.uint16)).reshape(-1, 4), bits[hit]
        new = np.ones(len(hit), bool)  # not in a bucket of an earlier substring
        for t in range(self.parts - 1):
            new &= (strings[:, t] > radii[t]) | (places < (t + 1) * len(self.codes))
        return self.order[places[new]], bits[new]

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        return self.near(code[0], radius)[0]

    def probed(self, code: np.uint64, radius: int, query: np.ndarray, floor: float, k: int) -> np.ndarray:
        """Of the rows within radius those that may be among the k best: the nearest codes raise the floor, and so lower the radius."""
        rows, far = self.near(code, radius)
        if len(rows) > 4 * FIRST_LOOK * k:
            nearest = np.searchsorted(np.cumsum(np.bincount(far)), FIRST_LOOK * k)
            floor = max(floor, kth_best(self.unit[rows[far <= nearest]] @ query, k + 1) - SLACK)  # one may be the query itself
            rows = rows[far <= self.model.within(floor)]
        return rows[self.unit[rows] @ query >= floor]

    def compared(self, queries: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the query, row) of all rows whose cosine is not below the floor of the query."""
        found, rows = [], []
        least = floors.astype(np.float32)[:, None]
        for at in range(0, len(self.unit), TILE):
            mask = queries @ self.unit[at : at + TILE].T >= least
            wide = mask.shape[1]
            if wide % 8:
                i, j = np.nonzero(mask)
            else:  # words of eight without any are passed over
                words = np.flatnonzero(mask.reshape(-1).view(np.uint64))
                places = (words[:, None] * 8 + np.arange(8)).ravel()
                i, j = np.divmod(places[mask.reshape(-1)[places]], wide)
            found.append(i)
            rows.append(j + at)
        return np.concatenate(found), np.concatenate(rows)

    def best(self, ids: np.ndarray, own: np.ndarray, unit: np.ndarray, codes: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, rows, cosines) of the k best rows for each query that are not below its floor.

        The floor, a cosine that k rows somewhere reach, sets the radius to where hardly a code outside can hold
        a row that beats it. Where the buckets of that radius are too many to pay for their lookup, the query is
        compared with all rows, TILE by TILE. Floats of single precision choose the rows, SLACK below the floor,
        which are ranked in double precision.
        """
        single, floors = unit.astype(np.float32), floors - SLACK
        radius = [self.model.within(x) if x > -2 else self.model.bits for x in floors]
        by_code = np.array([self.pays(r) for r in radius], bool)
        found, rows = [], []
        for i in np.flatnonzero(by_code):
            rows.append(self.probed(codes[i], radius[i], single[i], floors[i], k))
            found.append(np.full(len(rows[-1]), i))
        rest = np.flatnonzero(~by_code)
        for at in range(0, len(rest), TOGETHER):
            some = rest[at : at + TOGETHER]
            i, j = self.compared(single[some], floors[some])
            found.append(some[i])
            rows.append(j)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        found, rows = np.concatenate(found), np.concatenate(rows)
        selves = np.searchsorted(self.uuids, own)
        selves[self.uuids[np.minimum(selves, len(self.uuids) - 1)] != own] = -1
        other = rows != selves[found]
        found, rows = found[other], rows[other]
        value = np.empty(len(rows))
        for at in range(0, len(rows), TILE):
            part = slice(at, at + TILE)
            value[part] = np.round(np.einsum("ij,ij->i", unit_rows(self.vectors[rows[part]]), unit[found[part]]), 9)
        order = np.lexsort((rows, -value, found))
        found, rows, value = found[order], rows[order], value[order]
        rank = np.arange(len(found)) - np.searchsorted(found, found)
        return ids[found[rank < k]], rows[rank < k], value[rank < k]


def _floors(sample, k: int, dim: int):
    """Adds to each query the k-th best cosine to the other uuids of the sample: what the k best of all rows reach at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uuids, unit = sample.value
        for batch in batches:
            own = batch.column("uuid").to_numpy(zero_copy_only=False)
            asked = unit_rows(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)).astype(np.float32)
            selves = np.searchsorted(uuids, own)
            floors = np.empty(len(own))
            for at in range(0, len(own), TOGETHER):
                cosines = asked[at : at + TOGETHER] @ unit.T
                for i, value in enumerate(cosines, at):
                    if selves[i] < len(uuids) and uuids[selves[i]] == own[i]:
                        value[selves[i]] = -2
                    floors[i] = kth_best(value, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors)], names=[*batch.schema.names, "floor"])

    return run


def _search(model, blocks: list, k: int, dim: int):
    """Indexes each block of rows once and searches it for all blocks of queries, of which one is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = model.value
        uuids: list[np.ndarray] = []
        rows: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            index = Block(codes, np.concatenate(uuids), np.concatenate(rows))
            uuids.clear()
            rows.clear()
            names = pa.array(index.uuids, pa.string())
            for queries in blocks:
                ids, own, vectors, floors = queries.value
                found, at, cosines = index.best(ids, own, unit_rows(vectors), codes.encode(vectors), k, floors)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), names.take(pa.array(at)), pa.array(cosines, pa.float64())], names=["query_id", "uuid", "cosine"])
                if len(blocks) > 1:
                    queries.__dict__.pop("_value", None)  # read again from the executor's copy when it is needed

        for batch in batches:
            if batch.num_rows:
                uuids.append(batch.column("uuid").to_numpy(zero_copy_only=False))
                rows.append(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            if sum(map(len, uuids)) >= BLOCK_ROWS:
                yield from flush()
        if uuids:
            yield from flush()

    return run


RESULT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("uuid", T.StringType()), T.StructField("cosine", T.DoubleType())])


def fit_codes(vectors: DataFrame, bits: int = 64, sample_rows: int = SAMPLE_ROWS) -> tuple[Codes, tuple[np.ndarray, np.ndarray], int] | None:
    """Codes fitted on a sample chosen by the hash of the uuid, of about sample_rows rows at any size; the
    sample's distinct uuids in order with their unit vectors; the number of all rows."""
    total = vectors.count()
    if not total:
        return None
    every = max(1, total // sample_rows)
    rows = vectors.where(F.pmod(F.xxhash64("uuid"), F.lit(every)) == 0).select("uuid", "embedding").toPandas()
    if not len(rows):
        rows = vectors.select("uuid", "embedding").limit(sample_rows).toPandas()
    uuids, first = np.unique(rows.uuid.to_numpy(object), return_index=True)
    x = np.stack(rows.embedding.to_list()).astype(np.float64)
    return Codes(x, bits), (uuids, unit_rows(x[first]).astype(np.float32)), total


def nearest(spark: SparkSession, records: DataFrame, queries: DataFrame, k: int = 10, dim: int = 32, bits: int = 64) -> DataFrame:
    """(query_id, uuid, cosine): for each query (query_id, uuid) the k other uuids of records with the highest cosine.

    Cosines are rounded to 9 decimals, ties go to the smaller uuid, of a repeated record one copy counts.
    Vectors that are null, of another length, not finite or zero are neither found nor searched for; a
    query whose uuid has no usable vector has no rows. With fewer than k others all come out. Queries go
    to the rows in blocks of a fixed size, all in one pass over the rows, so neither side is ever gathered whole.
    """
    usable_rows = records.where(F.col("uuid").isNotNull() & usable(F.col("embedding"), dim)).select("uuid", "embedding")
    fitted = fit_codes(usable_rows, bits)
    if fitted is None:
        return spark.createDataFrame([], RESULT)
    model, sample, total = fitted
    context = spark.sparkContext
    wanted = queries.where("query_id IS NOT NULL").select("query_id", "uuid").dropDuplicates(["query_id"])
    own = usable_rows.join(wanted, "uuid").dropDuplicates(["query_id"]).select("uuid", "embedding", "query_id")
    asked = cut_lineage(own.mapInArrow(_floors(context.broadcast(sample), k, dim), T.StructType([*own.schema.fields, T.StructField("floor", T.DoubleType())])))
    parts = max(1, asked.count() // BLOCK_QUERIES)  # read about block by block
    sent, blocks, waiting = context.broadcast(model), [], asked.coalesce(parts).toLocalIterator()
    while rows := list(itertools.islice(waiting, BLOCK_QUERIES)):
        block = (np.array([r.query_id for r in rows]), np.array([r.uuid for r in rows], object), np.array([r.embedding for r in rows], np.float64), np.array([r.floor for r in rows]))
        blocks.append(context.broadcast(block))
    if not blocks:
        return spark.createDataFrame([], RESULT)
    tasks = max(context.defaultParallelism, -(-total // TASK_ROWS))  # neighbouring splits are read together: larger blocks prune more
    merged = usable_rows.coalesce(tasks).mapInArrow(_search(sent, blocks, k, dim), RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "uuid")
    return (
        merged.groupBy("query_id", "uuid").agg(F.max("cosine").alias("cosine"))
        .withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")
    )
