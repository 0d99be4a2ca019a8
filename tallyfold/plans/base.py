"""How a query and its SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    """Queries of one module by name, and SQL for those it can express."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None, *views: str) -> None:
        """``views``: common table expressions that ``sql`` builds on."""
        assert name not in self.queries, name
        self.queries[name] = query
        if sql:
            head, body = "", sql.strip()
            for start in ("with recursive ", "with "):
                if body.startswith(start):
                    head, body = start, body.removeprefix(start)
                    break
            parts = [v.strip() for v in views]
            self.sql[name] = f"{head or 'with '}{', '.join([*parts, body]) if head else ', '.join(parts) + chr(10) + body}" if parts or head else body
