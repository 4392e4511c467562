"""A family's queries and their SQL side by side."""

from __future__ import annotations

from collections.abc import Callable


class Family:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable:
        """Register a function of (spark, folder) under its own name, with its SQL where there is one."""

        def wrap(fn: Callable) -> Callable:
            key = name or fn.__name__
            self.queries[key] = fn
            if sql is not None:
                self.oracles[key] = sql.strip()
            return fn

        return wrap
