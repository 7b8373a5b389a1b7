"""The registered queries of the engine and, beside each, the SQL that checks it."""

from __future__ import annotations

from functools import wraps

from tideframe.functions.workers import with_workers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: file a (spark, sf_dir) -> DataFrame query under its name, with its oracle SQL."""

    def put(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            with_workers(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put
