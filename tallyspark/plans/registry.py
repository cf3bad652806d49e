"""Every bound query and, where DuckDB can express it, its oracle SQL."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from tallyspark.session import settle

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query of (spark, sf_dir) under a name, with its oracle SQL."""

    def keep(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        @functools.wraps(f)
        def run(spark, sf_dir):
            settle(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


for _part in ("checks", "scalars", "words", "store", "golden", "infer", "sources", "learning", "engine", "trials", "ruled", "codec", "runs"):
    importlib.import_module(f"tallyspark.plans.{_part}")
