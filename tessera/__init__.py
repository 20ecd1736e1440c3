"""Tessera: a Spark-first engine for evidence queries over documents, facts, vectors and graphs."""
