"""Registered queries: name -> (Spark callable, reference SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.functions.scalar import rounded
from matchlake.sources.fixtures import FixtureTables

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the fixture tables under a name."""

    def wrap(fn: Callable[[FixtureTables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = (lambda spark, sf_dir: fn(FixtureTables(spark, sf_dir)), sql)
        return fn

    return wrap


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Selected columns (all by default) with doubles rounded to six digits."""
    df = df.select(*columns) if columns else df
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: rounded(c, 6) for c in doubles})


def long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})
