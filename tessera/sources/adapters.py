"""Adapters: how an external collection is discovered, described and read, also as a Spark data source."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass(frozen=True)
class Artifact:
    """One file of a source."""

    source_id: str
    name: str
    path: str


class Adapter:
    """The contract of a collection; subclasses read what they stand for, without a network in this package."""

    def discover(self) -> list[str]:
        """Ids of the sources there are."""
        raise NotImplementedError

    def metadata(self, source_id: str) -> dict[str, str]:
        raise NotImplementedError

    def artifacts(self, source_id: str) -> list[Artifact]:
        raise NotImplementedError

    def fetch(self, artifact: Artifact) -> bytes:
        with open(artifact.path, "rb") as f:
            return f.read()

    def fingerprint(self, artifact: Artifact) -> str:
        return hashlib.sha256(self.fetch(artifact)).hexdigest()


class FolderAdapter(Adapter):
    """Each subfolder of a folder that all executors can read is a source, each file in it an artefact."""

    def __init__(self, folder: str, limit: int = 50 << 20):
        self.folder, self.limit = folder, limit

    def discover(self) -> list[str]:
        return sorted(e.name for e in os.scandir(self.folder) if e.is_dir())

    def metadata(self, source_id: str) -> dict[str, str]:
        return {"source_id": source_id, "url": f"file://{self.folder}/{source_id}"}

    def artifacts(self, source_id: str) -> list[Artifact]:
        files = sorted((e for e in os.scandir(os.path.join(self.folder, source_id)) if e.is_file()), key=lambda e: e.name)
        return [Artifact(source_id, e.name, e.path) for e in files if e.stat().st_size <= self.limit]


class _Part(InputPartition):
    def __init__(self, source_id: str):
        self.source_id = source_id


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.adapter = FolderAdapter(folder)

    def partitions(self) -> list[InputPartition]:
        return [_Part(s) for s in self.adapter.discover()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for a in self.adapter.artifacts(partition.source_id):
            raw = self.adapter.fetch(a)
            yield a.source_id, a.name, hashlib.sha256(raw).hexdigest(), len(raw), raw.decode("utf-8-sig", "replace")


class FolderSource(DataSource):
    """spark.dataSource.register(FolderSource); spark.read.format("tessera_folder").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "tessera_folder"

    def schema(self) -> str:
        return "source_id string, name string, sha256 string, size long, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])
