"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "loomgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators count on; a cluster's own master stays."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names the shared folder in spark.checkpoint.dir; a temporary one takes its place only
    where none is set and all runs on this machine, as in tests. Other executors could not read it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomgraph-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes the rows once to the shared folder of checkpoints and reads them from there.

    They survive lost executors, and unlike a checkpointed plan they carry exact sizes and neither
    statistics nor constraints of what they were made from, so that plans of many rounds stay small. The
    files go with release(), else when the driver's JVM ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"rows-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(path.toString())
    rows = spark.read.schema(df.schema).parquet(path.toString())
    rows._cut_path = path
    return rows


def release(*cuts: DataFrame) -> None:
    """Deletes the files of cut tables of which all consumers have been written."""
    for df in cuts:
        path = getattr(df, "_cut_path", None)
        if path is not None:
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once for a context, so that their workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_loomgraph_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="loomgraph-")) / "loomgraph.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, Path("loomgraph") / source.relative_to(root))
    context.addPyFile(str(archive))
    context._loomgraph_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def distinct_records(df: DataFrame, *columns: str) -> DataFrame:
    """One row for each uuid. A redelivered row repeats everything but seq, so any copy serves; only
    the columns asked for travel through the shuffle."""
    keep = [c for c in columns if c != "uuid"]
    if not keep:
        return df.select("uuid").where(F.col("uuid").isNotNull()).distinct()
    return df.where(F.col("uuid").isNotNull()).select("uuid", *keep).dropDuplicates(["uuid"])
