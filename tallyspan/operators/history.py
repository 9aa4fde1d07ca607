"""Filed runs of clients: three Parquet tables under one root, partitioned by client.

A run is filed documents first and its own row last, so a run that is listed is whole.
"""

from __future__ import annotations

import json
from dataclasses import fields
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import keep
from .anomalies import Config

SCHEMAS = {
    "clients": "client_id string, name string, created_at timestamp, config string",
    "runs": "run_id string, client_id string, created_at timestamp, headline string, payload string",
    "documents": "document_id string, client_id string, run_id string, created_at timestamp, file_name string, content binary",
}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _exists(self, table: str) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, table: str) -> DataFrame:
        """A table, with columns that older files lack as null."""
        if not self._exists(table):
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(self._path(table))

    def append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("client_id").parquet(self._path(table))

    def add_client(self, client_id: str, name: str, at: datetime, config: str | None = None) -> None:
        """Names are unique whatever their case."""
        if self.read("clients").where(F.lower("name") == name.strip().lower()).limit(1).count():
            raise ValueError(f"a client named {name!r} exists")
        self.append("clients", self.spark.createDataFrame([(client_id, name.strip(), at, config)], SCHEMAS["clients"]))

    def configure(self, client_id: str, name: str | None = None, config: str | None = None) -> None:
        """Rewrites one client's partition; a config replaces, it never merges."""
        own = self.read("clients").where(F.col("client_id") == client_id)
        held = own.collect()  # one row
        if not held:
            raise KeyError(client_id)
        row = (client_id, name or held[0].name, held[0].created_at, config if config is not None else held[0].config)
        self._replace("clients", client_id, self.spark.createDataFrame([row], SCHEMAS["clients"]))

    def _replace(self, table: str, client_id: str, rows: DataFrame | None) -> None:
        if rows is not None:
            rows.drop("client_id").write.mode("overwrite").parquet(f"{self._path(table)}/client_id={client_id}")
            return
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(table)}/client_id={client_id}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def file_run(self, run: DataFrame, documents: DataFrame) -> None:
        self.append("documents", documents)
        self.append("runs", run)

    def delete_client(self, client_id: str) -> None:
        """With all its runs and documents; the client's own row goes last."""
        for table in ("documents", "runs", "clients"):
            self._replace(table, client_id, None)

    def clients(self) -> DataFrame:
        return client_activity(self.read("clients"), self.read("runs"))

    def runs(self, client_id: str) -> DataFrame:
        """Newest first, without their payloads: only one client's files are read."""
        return run_list(self.read("runs").where(F.col("client_id") == client_id)).orderBy("place")

    def documents(self, run_id: str) -> DataFrame:
        """The files that a run was made from."""
        return self.read("documents").where(F.col("run_id") == run_id).select("document_id", "file_name", "content")

    def has_documents(self, run_id: str) -> bool:
        return bool(self.read("documents").where(F.col("run_id") == run_id).limit(1).count())

    def thresholds(self, client_id: str | None, request: str | None = None) -> Config:
        """The settings of a run: the request's, if it has any, else the client's, else the
        usual ones; they replace each other whole. Unknown settings raise."""
        held = request
        if not (held or "").strip() and client_id is not None:
            row = self.read("clients").where(F.col("client_id") == client_id).select("config").first()
            held = row and row.config
        return Config(**_settings(json.loads(held))) if (held or "").strip() else Config()

    def export(self, client_id: str, path: str) -> None:
        """One client's tables as JSON lines (contents in base 64), readable without this
        library; written by tasks."""
        for table in SCHEMAS:
            own = self.read(table).where(F.col("client_id") == client_id)
            own.write.mode("overwrite").json(f"{path.rstrip('/')}/{table}")

    def run(self, run_id: str) -> DataFrame:
        return self.read("runs").where(F.col("run_id") == run_id).join(self.read("clients").select("client_id", "name"), "client_id")

    def purge_older(self, client_id: str, days: int, now: datetime) -> int:
        """Deletes one client's documents that are more than so many days old."""
        if days < 0:
            raise ValueError("a retention window can't be negative")
        return self.purge_documents(client_id, now - timedelta(days))

    def purge_documents(self, client_id: str, before: datetime) -> int:
        """Deletes one client's documents older than a time; runs and results stay."""
        own = self.read("documents").where(F.col("client_id") == client_id)
        gone = own.where(F.col("created_at") < before).count()
        if gone:
            kept = keep(own.where(F.col("created_at") >= before), "kept-documents")
            self._replace("documents", client_id, kept)
        return gone


def _settings(given: dict) -> dict:
    unknown = set(given) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return {name: tuple(value) if isinstance(value, list) else value for name, value in given.items()}


def run_list(runs: DataFrame) -> DataFrame:
    """client_id, run_id, created_at, headline and place of runs: each client's newest first."""
    newest = F.row_number().over(Window.partitionBy("client_id").orderBy(F.desc("created_at"), "run_id"))
    return runs.select("client_id", "run_id", "created_at", "headline", newest.cast("long").alias("place"))


def client_activity(clients: DataFrame, runs: DataFrame) -> DataFrame:
    """Clients with how many runs they have and when the last was, the busiest last first."""
    held = runs.groupBy("client_id").agg(F.count("run_id").alias("runs"), F.max("created_at").alias("last_run"))
    joined = clients.join(held, "client_id", "left").withColumn("runs", F.coalesce("runs", F.lit(0)))
    return joined.orderBy(F.coalesce("last_run", "created_at").desc())


def purged(documents: DataFrame, runs: DataFrame, cutoff) -> DataFrame:
    """documents without those of runs created before the cutoff."""
    old = runs.where(F.col("created_at") < cutoff).select("run_id")
    return documents.join(old, "run_id", "left_anti")
