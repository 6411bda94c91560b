"""Query registry: named Spark jobs over the driver tables, each paired
with an optional DuckDB oracle statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, oracle, (fn.__doc__ or "").strip())
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the plan modules fills the registry
    from quaymind.plans import (  # noqa: F401
        q_recommend, q_text, q_classify, q_match, q_profile, q_documents, q_sources, q_models,
    )
    return REGISTRY
