"""Retrieval corpora, hybrid search and answer evaluation as Spark DataFrame jobs."""

from passagemill.session import build_session, read_table

__all__ = ["build_session", "read_table"]
