"""The stored tables of a deployment: append-only folders, collapsed to their latest rows when they are read.

Appends never rewrite files, so writers do not wait for each other and a lost job leaves whole files or none; what an
update replaces is decided by the greatest sequence number when the table is read, with partial aggregation.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "entries": "hash string, content string, label string, size_bytes long, seq long",
    "metrics": "request_id string, ts double, raw_tokens long, compressed_tokens long, latency_ms double, upstream_ms double, breakdown string, cache_hit boolean, offloaded boolean, component_id string, run_id string, budget_tier int",
    "mask_log": "ts double, pattern string, count long",
    "versions": "path string, version long, hash string, content string, seq long",
    "ledger": "run_id string, hash string, owner string, seq long",
    "symbols": "file string, symbol string, kind string, seq long",
    "calls": "caller_file string, caller_symbol string, callee_symbol string, seq long",
    "indexed": "file string, seq long",
}
#: Tables that :meth:`Storage.flush` empties.
FLUSHED = ("entries", "metrics")


class Storage:
    """Tables below ``folder``, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, table: str) -> str:
        if table not in SCHEMAS:
            raise KeyError(table)
        return f"{self.folder}/{table}"

    def _fs(self, table: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def append(self, table: str, rows: DataFrame) -> None:
        """Append ``rows``; columns they lack are null, others are left out."""
        schema = self.spark.createDataFrame([], SCHEMAS[table]).schema
        columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        rows.select(*columns).write.mode("append").parquet(self.path(table))

    def read(self, table: str) -> DataFrame:
        """All rows ever appended; an absent table is empty."""
        fs, where = self._fs(table)
        if not fs.exists(where):
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(self.path(table))

    def entries(self) -> DataFrame:
        """One row a hash, as last put."""
        latest = self.read("entries").groupBy("hash").agg(F.max_by(F.struct("content", "label", "size_bytes"), "seq").alias("e"))
        return latest.select("hash", "e.*")

    def owners(self) -> DataFrame:
        """Who said a text of a run first."""
        return self.read("ledger").groupBy("run_id", "hash").agg(F.min_by("owner", "seq").alias("owner"))

    def latest_versions(self) -> DataFrame:
        last = self.read("versions").groupBy("path").agg(F.max_by(F.struct("version", "hash", "content"), F.struct("version", "seq")).alias("v"))
        return last.select("path", "v.*")

    def index_files(self, files: list[str] | DataFrame, symbols: DataFrame, calls: DataFrame, seq: int) -> int:
        """Replace what is stored of ``files`` by ``symbols`` and ``calls``; returns how many files were indexed."""
        names = files if isinstance(files, DataFrame) else self.spark.createDataFrame([(f,) for f in files], "file string")
        names = names.select("file").distinct()
        for table, rows in (("symbols", symbols), ("calls", calls), ("indexed", names)):
            self.append(table, rows.withColumn("seq", F.lit(seq)))
        return names.count()

    def _current(self, table: str, file: str) -> DataFrame:
        last = self.read("indexed").groupBy(F.col("file").alias("_file")).agg(F.max("seq").alias("_seq"))
        rows = self.read(table)
        return rows.join(last, (F.col(file) == F.col("_file")) & (F.col("seq") == F.col("_seq"))).drop("_file", "_seq", "seq")

    def symbols(self) -> DataFrame:
        return self._current("symbols", "file")

    def calls(self) -> DataFrame:
        return self._current("calls", "caller_file")

    def flush(self) -> None:
        """Empty the store and the metrics; versions, ledger, masks and call graphs stay."""
        for table in FLUSHED:
            fs, where = self._fs(table)
            fs.delete(where, True)


def write_report(report: DataFrame, path: str, **parts: DataFrame) -> None:
    """Write a report of one row as one JSON text file, with the rows of ``parts`` as lists; a report's parts are small tables."""
    row = report.limit(1).toJSON().collect()
    body = json.loads(row[0]) if row else {}
    body |= {name: [json.loads(x) for x in part.toJSON().collect()] for name, part in parts.items()}
    spark = report.sparkSession
    spark.createDataFrame([(json.dumps(body, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)
