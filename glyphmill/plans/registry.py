"""Queries by name, and the SQL that checks them."""

from __future__ import annotations

from glyphmill.plans import acquisition_queries, corpus_queries, detector_queries, material_queries, protocol_queries, report_queries, rewrite_queries, source_queries, sql_queries, stream_queries, summary_queries, text_queries

_MODULES = [sql_queries, acquisition_queries, detector_queries, text_queries, corpus_queries, stream_queries, report_queries, rewrite_queries, source_queries, summary_queries, material_queries, protocol_queries]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
