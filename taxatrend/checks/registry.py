"""Named queries, each with the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taxatrend.corpus import PARAMS, Corpus
from taxatrend.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_corpora: dict[tuple, Corpus] = {}


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """One corpus per application and directory, so queries of a session share its written tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _corpora:
        _corpora[key] = Corpus(Workspace(spark), sf_dir, PARAMS)
    return _corpora[key]


def query(name: str, sql: str | None = None):
    """Register ``fn(corpus) -> DataFrame`` under a name, with its SQL twin."""

    def add(fn: Callable[[Corpus], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(corpus(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
