"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import leaks, markup, matches, names, neighbours, packing, scans, subjects, survivors
from loomgraph.session import cut_lineage, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return matches.match_groups(table(spark, d, "entity_matches"), table(spark, d, "entities"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    # The listing settles ties and undated groups by uuid, so its edges are trusted before those that are learned.
    return survivors.field_sources(cut_lineage(p1_found(spark, d)), table(spark, d, "entities"), trust=("time", "uuid", "learned"))


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.surviving_records(cut_lineage(p1_found(spark, d)), table(spark, d, "entities"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_lines(table(spark, d, "episodes"))


def p4_text(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired_scans(table(spark, d, "episodes"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.name_pairs(table(spark, d, "entities"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "vector_queries")
    found = None
    for kind in ("entities", "episodes", "edges"):
        own = neighbours.nearest(spark, table(spark, d, kind), asked.where(F.col("kind") == kind)).select("query_id", "uuid")
        found = own if found is None else found.unionByName(own)
    return found


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.markup_elements(table(spark, d, "episodes"))


def p7_text(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_markup(table(spark, d, "episodes"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    counts = cut_lineage(packing.token_counts(table(spark, d, "documents")))
    return packing.pack_documents(counts, table(spark, d, "context_windows"))


def p8_room(spark: SparkSession, d: str) -> DataFrame:
    return packing.room_left(p8_packed(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_removals(spark: SparkSession, d: str) -> DataFrame:
    return leaks.removal_spans(leaks.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


def p10_makeup(spark: SparkSession, d: str) -> DataFrame:
    return p10_found(spark, d).groupBy("subject").agg(F.count("*").alias("n_documents"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_survivors": p2_survivors,
    "p4_found": p4_found,
    "p4_text": p4_text,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_text": p7_text,
    "p8_packed": p8_packed,
    "p8_room": p8_room,
    "p9_found": p9_found,
    "p9_removals": p9_removals,
    "p10_found": p10_found,
    "p10_makeup": p10_makeup,
}
