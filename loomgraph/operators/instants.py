"""Mixed timestamp texts to one unambiguous UTC instant each."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.instants import parse_instants


@F.pandas_udf(T.LongType())
def utc_micros(text: pd.Series, zone: pd.Series, order: pd.Series) -> pd.Series:
    micros, ok = parse_instants(text.tolist(), zone.tolist(), order.tolist())
    return pd.Series(micros).astype("Int64").where(ok, None)


def normalise_instants(
    records: DataFrame, workspaces: DataFrame, fields: tuple[str, ...] = ("valid_at", "invalid_at")
) -> DataFrame:
    """(uuid, field, utc_micros), one row for each record and field whose text denotes an instant.

    records: uuid, group_id and the fields. A record of a workspace that is not listed is read as UTC
    and DMY. Repeated records come out once; null, blank and undatable texts have no row; other columns
    of either table are ignored. Texts are parsed before the repeats are removed, so that only the three
    short result columns are shuffled.
    """
    zones = (
        workspaces.where(F.col("group_id").isNotNull())
        .select("group_id", F.col("time_zone").alias("_zone"), F.col("date_order").alias("_order"))
        .dropDuplicates(["group_id"])
    )
    texts = (
        records.select("uuid", "group_id", *fields)
        .where(F.col("uuid").isNotNull())
        .unpivot(["uuid", "group_id"], list(fields), "field", "_text")
        .where(F.col("_text").rlike("[0-9]"))
    )
    return (
        texts.join(zones, "group_id", "left")
        .select("uuid", "field", utc_micros("_text", "_zone", "_order").alias("utc_micros"))
        .where(F.col("utc_micros").isNotNull())
        .dropDuplicates(["uuid", "field", "utc_micros"])
    )
