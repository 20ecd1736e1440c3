"""Registered queries of the engine on the driver's tables, each with the SQL that it must equal."""

from __future__ import annotations

from tessera.catalog import binding, documents, evidence, extraction, facts, graphs, ingestion, preparation, questions, records, search, selection, windows
from tessera.catalog.registry import ORACLES, QUERIES

FLAGSHIP = "classify_direct_related"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "binding", "documents", "evidence", "extraction", "facts", "graphs", "ingestion", "preparation", "questions", "records", "search", "selection", "windows"]
