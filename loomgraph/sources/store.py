"""Versioned tables in a folder, stamped with the space of their embeddings."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

LEGACY_SPACE = "local-v1"


class SpaceMismatch(Exception):
    """The folder's vectors come from another model than the one asked for."""


class Store:
    """Each write of a table makes a new version beside the old one and then points to it, so that readers
    never see half a table and no job overwrites what it reads. Every table has a pointer of its own, so that writers
    of different tables do not meet; of one table the last writer stays. The version before is kept for its readers.
    """

    def __init__(self, spark: SparkSession, root: str, space: str = LEGACY_SPACE) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        stamp = self._get("space")
        if stamp is None:
            # An unstamped folder with tables is one of the first space, an empty one takes the space asked for.
            stamp = LEGACY_SPACE if self.tables() else space
            self._put("space", stamp)
        if stamp != space:
            raise SpaceMismatch(f"{self.root} holds {stamp}, not {space}")

    def _get(self, name: str) -> str | None:
        at = self._path(f"{self.root}/{name}.pointer")
        return "\n".join(r.value for r in self.spark.read.text(at.toString()).collect()) if self._fs.exists(at) else None

    def _put(self, name: str, value: str) -> None:
        """Written beside and moved into place."""
        new, at = self._path(f"{self.root}/{name}.{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}.pointer")
        out = self._fs.create(new, True)
        out.write(bytearray(value.encode()))
        out.close()
        self._fs.delete(at, False)
        self._fs.rename(new, at)

    def tables(self) -> dict[str, str]:
        root = self._path(self.root)
        if not self._fs.exists(root):
            return {}
        names = [s.getPath().getName() for s in self._fs.listStatus(root) if s.getPath().getName().endswith(".pointer")]
        return {n[: -len(".pointer")]: self._get(n[: -len(".pointer")]).split("\n")[0] for n in names if n != "space.pointer"}

    def read(self, name: str) -> DataFrame:
        """The current version, of the schema that it was written with."""
        path, _, schema = (self._get(name) or "").split("\n")
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(path)

    def write(self, name: str, df: DataFrame) -> None:
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        writer = df.write
        (writer.partitionBy("group_id") if "group_id" in df.columns else writer).parquet(path)
        before = (self._get(name) or "\n").split("\n")
        self._put(name, "\n".join([path, before[0], df.schema.json()]))
        if before[1]:
            self._fs.delete(self._path(before[1]), True)
