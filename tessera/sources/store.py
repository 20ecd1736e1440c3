"""A store of evidence: its tables as folders of Parquet with a fixed schema, opened to read or to write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The tables and their columns (fixed values).
TABLES = {
    "sources": "source_id string, source_type string, record_id string, title string, doi string, url string, retrieved_at timestamp, filename string, sha256 string, mime_type string, status string",
    "documents": "document_id string, source_id string, title string",
    "document_metadata": "document_id string, authors string, year int, publisher string, report_number string, language string, pages int, abstract string",
    "passages": "evidence_id string, document_id string, page int, section string, text string, start_offset int, end_offset int, raw_file string, checksum string",
    "evidence_refs": "evidence_id string, source_id string",
    "evidence_locations": "evidence_id string, payload string",
    "structured_cells": "evidence_id string, column_ordinal int, header string, value string, payload string",
    "ingestion_batches": "batch_id string, created_at timestamp, status string, payload string",
    "source_artifacts": "artifact_id string, source_id string, kind string, sha256 string, payload string",
    "candidate_records": "candidate_id string, candidate_type string, source_id string, evidence_id string, review_status string, payload string",
    "review_queue": "candidate_id string, reason string, created_at timestamp, payload string",
    "extraction_cache": "cache_key string, kind string, payload string, created_at timestamp",
    "query_cache": "cache_key string, kind string, payload string, created_at timestamp",
    "semantic_staging": "candidate_id string, proposal string, staged_at timestamp",
}


class EvidenceStore:
    """Opens a folder; tables that are missing are made unless it is read-only, where a write is an error."""

    def __init__(self, spark: SparkSession, folder: str, read_only: bool = False):
        self.spark, self.folder, self.read_only = spark, folder, read_only
        for name, schema in TABLES.items():
            if not self._exists(name):
                if read_only:
                    raise FileNotFoundError(f"{folder}/{name}")
                spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")

    def _exists(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows with the columns of the table, in any order; missing ones are null."""
        if self.read_only:
            raise PermissionError(f"{self.folder} is open to read only")
        empty = self.spark.createDataFrame([], TABLES[name])
        if unknown := set(rows.columns) - set(empty.columns):
            raise ValueError(f"{name} has no columns {sorted(unknown)}")
        empty.unionByName(rows, allowMissingColumns=True).write.mode("append").parquet(f"{self.folder}/{name}")
