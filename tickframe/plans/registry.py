"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from ..session import ship

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(function):
        @functools.wraps(function)
        def run(spark, sf_dir):
            ship(spark)
            return function(spark, sf_dir)

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add
