"""Full-text search: postings, corpus statistics and BM25 over prefix terms joined by OR."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomgraph.functions.porter import stem
from loomgraph.functions.text import fields
from loomgraph.session import cut_lineage, release

K1, B = 1.2, 0.75
APART = r"[^\p{L}\p{N}\p{M}]+"
#: Documents and queries of a group that meet in one task.
DOCUMENTS, QUERIES = 16_384, 4_096


def _folded(w: str) -> str:
    return stem("".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def folded_stem(words: pd.Series) -> pd.Series:
    """Accents off, then stemmed; meant for distinct words."""
    return words.map(_folded)


def tokens(c: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(c), APART), lambda x: x != "")


def query_terms(c: Column) -> Column:
    """The terms of a query: split at blanks, quotes and backticks; letters, digits and _ kept; at least two
    bytes or all digits. Words such as AND are ordinary terms."""
    parts = fields(F.regexp_replace(c, "['’`]", " "))
    plain = F.transform(parts, lambda x: F.regexp_replace(x, r"[^\p{L}\p{Nd}_]", ""))
    return F.filter(plain, lambda x: (F.octet_length(x) >= 2) | x.rlike("^[0-9]+$"))


def compiled_query(c: Column) -> Column:
    """Every term as a prefix, joined by OR; empty for a query without terms, which finds nothing."""
    return F.array_join(F.transform(query_terms(c), lambda x: F.concat(x, F.lit("*"))), " OR ")


def _stemmed(df: DataFrame, column: str, use: bool) -> DataFrame:
    """Words replaced by their stems; the stemmer sees each distinct word once."""
    if not use:
        return df
    stems = df.select(column).distinct().withColumn("_stem", folded_stem(column))
    return df.join(stems, column).withColumn(column, F.col("_stem")).drop("_stem")


def postings(documents: DataFrame, stemmed: bool = True) -> DataFrame:
    """(doc, token, tf, dl) of documents (doc, text). Null and empty texts have none."""
    each = documents.where("text IS NOT NULL").select("doc", tokens(F.col("text")).alias("t"))
    words = each.select("doc", F.size("t").alias("dl"), F.explode("t").alias("token"))
    counted = words.groupBy("doc", "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    if not stemmed:
        return counted
    return _stemmed(counted, "token", True).groupBy("doc", "token").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(documents: DataFrame) -> DataFrame:
    """One row: (n_docs, avgdl) over all rows of the corpus, those without tokens too."""
    length = F.coalesce(F.size(tokens(F.col("text"))), F.lit(0))
    return documents.agg(F.count("*").alias("n_docs"), F.avg(F.when(F.col("text").isNull(), 0).otherwise(length)).alias("avgdl"))


class _Begun(dict):
    """Word to the numbers of the terms that begin it, or its stem, found once for each word."""

    def __init__(self, terms: list[str], stemmed: bool):
        super().__init__()
        self.number, self.stemmed = {t: i for i, t in enumerate(terms)}, stemmed
        self.lengths = sorted({len(t) for t in terms})

    def __missing__(self, word: str) -> tuple[int, ...]:
        w = _folded(word) if self.stemmed else word
        found = (self.number.get(w[:n]) for n in self.lengths if n <= len(w))
        self[word] = own = tuple(i for i in found if i is not None)
        return own


def _occurrences(terms, stemmed: bool):
    """Documents with their length and the terms that begin a word of theirs, with how many of their words they begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, n_terms = _Begun(terms.value, stemmed), max(1, len(terms.value))
        for batch in batches:
            ids: list[int] = []
            lengths, hits = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column("words").to_pylist()):
                if text:
                    words, before = text.split(), len(ids)
                    ids.extend(chain.from_iterable(map(begun.__getitem__, words)))
                    lengths[i], hits[i] = len(words), len(ids) - before
            keys, tf = np.unique(np.repeat(np.arange(batch.num_rows), hits) * n_terms + np.array(ids, np.int64), return_counts=True)
            starts = np.searchsorted(keys, np.arange(batch.num_rows + 1) * n_terms).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(starts), pa.array(x.astype(np.int32))) for x in (keys % n_terms, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("group_id"), pa.array(lengths), *lists], ["doc", "group_id", "dl", "terms", "tfs"])

    return run


def _best_of_block(k: int, avgdl: float, out: pa.Schema):
    """The k best of a block of documents for each of a block of queries."""

    def run(asked: pa.Table, docs: pa.Table) -> pa.Table:
        if not asked.num_rows or not docs.num_rows:
            return out.empty_table()
        docs = docs.take(pc.sort_indices(docs["doc"]))  # equal scores go to the smaller
        names, lists = docs["doc"].combine_chunks(), docs["terms"].combine_chunks()
        at = np.repeat(np.arange(len(names)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        term, tf = lists.flatten().to_numpy(), docs["tfs"].combine_chunks().flatten().to_numpy().astype(float)
        by_term = np.argsort(term, kind="stable")
        term, tf, at = term[by_term], tf[by_term], at[by_term]
        bound = tf + K1 * (1 - B + B * docs["dl"].to_numpy().astype(float)[at] / avgdl)
        found: tuple[list, list, list] = ([], [], [])
        for row in range(asked.num_rows):
            own = asked["own"][row].values
            number, idf, times = (own.field(c).to_numpy() for c in ("term", "idf", "times"))
            lo, hi = np.searchsorted(term, number), np.searchsorted(term, number, "right")
            if not (hi > lo).any():
                continue
            parts = [times[j] * (idf[j] * tf[x:y] * (K1 + 1) / bound[x:y]) for j, (x, y) in enumerate(zip(lo, hi, strict=True))]
            scores = np.bincount(np.concatenate([at[x:y] for x, y in zip(lo, hi, strict=True)]), np.concatenate(parts), len(names))
            hit = np.flatnonzero(scores)
            score = np.round(scores[hit], 9)
            if len(hit) > k:
                best = np.flatnonzero(score >= np.partition(score, len(hit) - k)[len(hit) - k])
                best = best[np.lexsort((best, -score[best]))[:k]]
                hit, score = hit[best], score[best]
            found[0].append(np.full(len(hit), row))
            found[1].append(hit)
            found[2].append(score)
        if not found[0]:
            return out.empty_table()
        row, hit, score = (np.concatenate(x) for x in found)
        return pa.table([asked["query_id"].take(pa.array(row)), names.take(pa.array(hit)), pa.array(score)], schema=out)

    return run


def bm25(documents: DataFrame, queries: DataFrame, k: int, stemmed: bool = True) -> DataFrame:
    """(query_id, doc, score, rank): the k best documents of the query's group, rank from 0.

    documents: doc, text, group_id, one row a doc; queries: query_id, text, group_id, one row a query_id.
    Statistics span all groups. A term matches every token that it begins; its frequency is that of all of
    them. A term twice in a query counts twice. idf is at least 1e-6. Scores are rounded to 9 decimals,
    equal ones are ordered by doc.

    Each document is read once and keeps the terms of the queries that it holds; the terms' distinct words are
    sent to all tasks. Blocks of a group's documents and queries then meet in tasks of bounded size, which
    send on only k documents a query, so that no table of scored pairs is written.
    """
    spark = documents.sparkSession
    terms = queries.select("query_id", F.posexplode(query_terms(F.lower("text"))).alias("at", "raw"))
    terms = terms.withColumn("part", F.explode(F.filter(F.split("raw", "_"), lambda x: x != ""))).select("query_id", "at", F.col("part").alias("term"))
    terms = cut_lineage(_stemmed(terms, "term", stemmed).groupBy("query_id", "term").agg(F.count("*").alias("times")))
    wanted = spark.sparkContext.broadcast(sorted(r.term for r in terms.select("term").distinct().collect()))
    words = documents.select("doc", "group_id", F.regexp_replace(F.lower("text"), APART, " ").alias("words"))
    kinds = dict(documents.dtypes) | dict(queries.dtypes)
    held = cut_lineage(words.mapInArrow(_occurrences(wanted, stemmed), f"doc {kinds['doc']}, group_id {kinds['group_id']}, dl bigint, terms array<int>, tfs array<int>"))
    stats = held.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
    number = F.pandas_udf(lambda x: pd.Series(np.searchsorted(np.array(wanted.value, object), x.to_numpy(object)), dtype="int32"), T.IntegerType())
    counts = held.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count("*").alias("n"))
    idf = F.greatest(F.log((F.lit(stats.n_docs) - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    weighed = terms.withColumn("number", number("term")).join(counts, "number").select("query_id", F.struct(F.col("number").alias("term"), idf.alias("idf"), F.col("times").cast("double").alias("times")).alias("own"))
    asked = weighed.groupBy("query_id").agg(F.array_sort(F.collect_list("own")).alias("own")).join(queries.select("query_id", "group_id"), "query_id")
    asked, docs = cut_lineage(asked), held.where(F.size("terms") > 0)
    blocks = lambda df, most, name: df.groupBy("group_id").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = blocks(asked, QUERIES, "xs").join(blocks(docs, DOCUMENTS, "ys"), "group_id")
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "group_id").select("group_id", "query_id", "own", part("query_id", "xs").alias("x"), every("ys").alias("y"))
    right = docs.join(sizes, "group_id").select("group_id", "doc", "dl", "terms", "tfs", every("xs").alias("x"), part("doc", "ys").alias("y"))
    out = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("doc", documents.schema["doc"].dataType), T.StructField("score", T.DoubleType())])
    key = ["group_id", "x", "y"]
    best = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_best_of_block(k, stats.total / max(1, stats.n_docs), to_arrow_schema(out)), out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    best = cut_lineage(best)
    release(held, asked, terms)
    return best.select("query_id", "doc", "score", (F.row_number().over(order) - 1).alias("rank")).where(F.col("rank") < k)
