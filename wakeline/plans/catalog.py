"""Registered queries and their oracle SQL."""

from __future__ import annotations

from . import analysis_queries, case_queries, drift_queries, export_queries, grid_queries, outline_queries, scene_queries, vessel_queries

_MODULES = [vessel_queries, analysis_queries, case_queries, drift_queries, export_queries, grid_queries, scene_queries, outline_queries, export_queries]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
