"""Conversation benchmarks in JSON: samples with sessions under numbered keys, and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import answer_text

SCHEMA = "sample_id string, conversation map<string,string>, qa array<struct<question:string,answer:string,adversarial_answer:string,category:int,evidence:array<string>>>"
TURN = "array<struct<speaker:string,dia_id:string,text:string,img_url:array<string>,blip_caption:string>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Samples with conversation as a map of JSON texts; answers are the raw values as text."""
    return spark.read.schema(SCHEMA).option("multiLine", "true").json(path)


def turns(samples: DataFrame) -> DataFrame:
    """(sample_id, session, date, turn, speaker, text, caption): sessions from 1 up to before the first that is missing."""
    entries = samples.select("sample_id", F.explode("conversation").alias("key", "value"))
    number = F.regexp_extract("key", r"^session_(\d+)$", 1)
    sessions = entries.where(number != "").select("sample_id", number.cast("int").alias("session"), "value").where("session BETWEEN 1 AND 100")
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy("session"))
    unbroken = sessions.withColumn("_n", place).where("_n = session").drop("_n")
    dates = entries.withColumn("_d", F.regexp_extract("key", r"^session_(\d+)_date_time$", 1)).where("_d <> ''").select("sample_id", F.col("_d").cast("int").alias("session"), F.col("value").alias("date"))
    each = unbroken.join(dates, ["sample_id", "session"], "left").select("sample_id", "session", "date", F.posexplode(F.from_json("value", TURN)).alias("turn", "t"))
    return each.select("sample_id", "session", "date", "turn", "t.speaker", "t.text", F.col("t.blip_caption").alias("caption"))


def questions(samples: DataFrame) -> DataFrame:
    """(sample_id, question_no, question, gold, category)."""
    each = samples.select("sample_id", F.posexplode("qa").alias("question_no", "q"))
    return each.select("sample_id", "question_no", "q.question", answer_text(F.col("q.answer"), F.col("q.adversarial_answer"), F.col("q.category")).alias("gold"), "q.category")
