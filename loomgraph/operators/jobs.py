"""The queue of ingestion jobs as states of rows; each operation gives the table's next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import retry_delay

STATES = ("pending", "processing", "done", "failed")
STALE_MINUTES = 5


def latest(jobs: DataFrame) -> DataFrame:
    """One row an id: of repeated and late rows the one updated last, of equal times the most attempts."""
    at = F.struct(F.coalesce(F.unix_micros("updated_at"), F.lit(-1)).alias("t"), F.coalesce("attempts", F.lit(0)).alias("a"), F.coalesce("status", F.lit("")).alias("s"))
    cols = [c for c in jobs.columns if c != "id"]
    return jobs.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct(at.alias("_at"), *cols)).alias("r")).select("id", *[f"r.{c}" for c in cols])


def payload(jobs: DataFrame) -> DataFrame:
    """(id, content, source, group_id, temperature): the decoded payload, nulls where it is cut off or wrapped in other text."""
    read = F.from_json("payload", "content string, source string, group_id string")
    return jobs.select("id", read.alias("p"), F.least(F.lit(0.3) * F.coalesce("attempts", F.lit(0)), F.lit(0.8)).alias("temperature")).select("id", "p.content", "p.source", "p.group_id", "temperature")


def eligible(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where((F.col("status") == "pending") & (F.col("not_before").isNull() | (F.col("not_before") <= now)))


def claim(jobs: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The n oldest eligible jobs; a micro-batch that takes them is the claim, its checkpoint makes it atomic."""
    return eligible(jobs, now).orderBy("created_at", "id").limit(n)


def complete(jobs: DataFrame, done: Column, now: Column) -> DataFrame:
    return jobs.withColumn("status", F.when(done, "done").otherwise(F.col("status"))).withColumn("updated_at", F.when(done, now).otherwise(F.col("updated_at")))


def fail(jobs: DataFrame, failed: Column, reason: Column, now: Column) -> DataFrame:
    """Another attempt counted: failed for good at max_attempts, else pending again after 5, 15 or 30 seconds."""
    attempts = F.coalesce("attempts", F.lit(0)) + 1
    last = attempts >= F.coalesce("max_attempts", F.lit(3))
    later = now + F.make_dt_interval(secs=retry_delay(attempts).cast("decimal(18,6)"))
    new = {
        "status": F.when(last, "failed").otherwise("pending"), "not_before": F.when(last, F.lit(None)).otherwise(later),
        "error": reason, "updated_at": now, "attempts": attempts.cast("int"),
    }
    return jobs.withColumns({c: F.when(failed, v).otherwise(F.col(c)) for c, v in new.items()})


def recover(jobs: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """Jobs processing for longer than so many minutes are pending again."""
    stale = (F.col("status") == "processing") & (F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return jobs.withColumn("status", F.when(stale, "pending").otherwise(F.col("status"))).withColumn("updated_at", F.when(stale, now).otherwise(F.col("updated_at")))


def requeue(jobs: DataFrame, now: Column) -> DataFrame:
    failed = F.col("status") == "failed"
    return jobs.withColumns({
        "attempts": F.when(failed, F.lit(0)).otherwise(F.col("attempts")).cast("int"), "updated_at": F.when(failed, now).otherwise(F.col("updated_at")),
        "status": F.when(failed, "pending").otherwise(F.col("status")),
    })


def stats(jobs: DataFrame) -> DataFrame:
    """(status, n) for the four states, zeros filled in."""
    zero = jobs.sparkSession.createDataFrame([(s,) for s in STATES], "status string")
    return zero.join(jobs.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def push(chunks: DataFrame, kind: str = "ingest") -> DataFrame:
    """(type, payload, status, attempts, max_attempts) for chunks (content, source, group_id)."""
    return chunks.select(F.lit(kind).alias("type"), F.to_json(F.struct("content", "source", "group_id")).alias("payload"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(3).alias("max_attempts"))
