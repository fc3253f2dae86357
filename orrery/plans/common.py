"""A register of queries, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Book:
    """Queries by name, with their SQL where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        """Registers the function below under its name; ``sql`` answers it from the same tables."""
        def keep(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


def r6(*names: str) -> dict[str, Column]:
    """The named columns rounded to six places, as their SQL rounds them."""
    return {n: F.round(F.col(n), 6) for n in names}


def listed(array: Column) -> Column:
    """An array of numbers as text, in millionths, so that engines agree on it."""
    return F.array_join(F.transform(array, lambda x: F.round(x.cast("double") * 1e6).cast("bigint").cast("string")), ",")


def listed_sql(array: str) -> str:
    return f"coalesce(array_to_string(list_transform({array}, lambda z: round(z::DOUBLE * 1e6)::BIGINT), ','), '')"
