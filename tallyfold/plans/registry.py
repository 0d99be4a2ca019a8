"""Every registered query of the analytics operators, and its SQL."""

from __future__ import annotations

from tallyfold.plans import composed, facts, lake, logs, metrics, more, text
from tallyfold.plans.base import Query

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
for _module in (facts, metrics, logs, text, lake, more, composed):
    QUERIES |= _module.P.queries
    SQL |= _module.P.sql
