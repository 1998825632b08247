"""Registered queries and the equivalent DuckDB SQL."""

from __future__ import annotations

from quillspark.plans import catalog, folds, journal, layout, records, usage, web

QUERIES: dict = usage.QUERIES | catalog.QUERIES | web.QUERIES | folds.QUERIES | journal.QUERIES | layout.QUERIES | records.QUERIES
SQL: dict[str, str] = usage.SQL | catalog.SQL | web.SQL | folds.SQL | journal.SQL | layout.SQL | records.SQL
