"""Registry of this package's queries: a function (spark, sf_dir) and its SQL, if any."""

from __future__ import annotations

from tallyloom.plans.registry import Query

LLM: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        LLM[name] = Query(name, fn, sql)
        return fn

    return add
