"""A module's queries by name, each with the SQL it has to agree with."""

from __future__ import annotations

from collections.abc import Callable


class Registry(dict):
    """name -> (function of (spark, sf_dir), SQL or None)."""

    def query(self, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self[f.__name__] = f, sql
            return f

        return add
