"""The driver queries of the engine and their SQL."""

from __future__ import annotations

from . import gradebook, grading, media, texts

_MODULES = (gradebook, texts, grading, media)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
