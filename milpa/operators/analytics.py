"""Analytics: the questions asked of the warehouse, each one plan over facts and dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def where(df: DataFrame, filters: Mapping[str, Any] | None) -> DataFrame:
    """Rows in which each column equals its value, or is one of a list's."""
    for c, v in (filters or {}).items():
        df = df.where(F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return df


def select(df: DataFrame, filters: Mapping[str, Any] | None, columns: Sequence[str], limit: int = 100) -> DataFrame:
    """Q1: filtered and projected, at most ``limit`` rows, in the order of the columns."""
    return where(df, filters).select(*columns).orderBy(*columns).limit(limit)


def extreme(df: DataFrame, filters: Mapping[str, Any] | None = None, n: int = 1, ascending: bool = False, value: str = "valor", ties: Sequence[str] = ()) -> DataFrame:
    """Q2, Q3, Q13: the whole rows of the ``n`` highest or lowest values; nulls never count."""
    return where(df, filters).where(F.col(value).isNotNull()).orderBy(F.asc(value) if ascending else F.desc(value), *ties).limit(n)


def extreme_by(df: DataFrame, by: str, value: str = "valor", ascending: bool = False) -> DataFrame:
    """Q2, grouped: the row of the highest or lowest value of each group."""
    rest = [c for c in df.columns if c != by]
    pick = (F.min_by if ascending else F.max_by)(F.struct(*rest), value)
    return df.where(F.col(value).isNotNull()).groupBy(by).agg(pick.alias("r")).select(by, "r.*")


def count(df: DataFrame, filters: Mapping[str, Any] | None = None) -> DataFrame:
    """Q4."""
    return where(df, filters).agg(F.count("*").alias("total"))


def average(df: DataFrame, filters: Mapping[str, Any] | None = None, value: str = "valor") -> DataFrame:
    """Q5."""
    return where(df, filters).agg(F.avg(value).alias("promedio"))


def bounds(df: DataFrame, filters: Mapping[str, Any] | None = None, value: str = "valor") -> DataFrame:
    """Q6."""
    return where(df, filters).agg(F.min(value).alias("minimo"), F.max(value).alias("maximo"))


def count_by(fact: DataFrame, dim: DataFrame | None = None, on: Sequence[str] = (), keys: Sequence[str] = (), filters: Mapping[str, Any] | None = None) -> DataFrame:
    """Q7, Q8, Q9: facts, joined with a dimension if there is one, counted by keys (or in all), in key order."""
    rows = where(fact if dim is None else fact.join(dim, list(on)), filters)
    return rows.groupBy(*keys).agg(F.count("*").alias("total")).orderBy(*keys) if keys else rows.agg(F.count("*").alias("total"))


def labelled_union(sources: Mapping[str, DataFrame], columns: Sequence[str], filters: Mapping[str, Any] | None = None, limit: int = 100) -> DataFrame:
    """Q10: the sources' rows one below the other with a label, never joined; at most ``limit`` in order."""
    parts = [where(df, filters).select(F.lit(label).alias("fuente"), *columns) for label, df in sources.items()]
    return reduce(DataFrame.unionByName, parts).orderBy("fuente", *columns).limit(limit)


def compare(df: DataFrame, entities: Sequence[str], column: str = "entidad") -> DataFrame:
    """Q11."""
    return df.where(F.col(column).isin(*entities))


def listing(dim: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q12."""
    return dim.select(*columns).orderBy(*columns)


def star(fact: DataFrame, dims: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Q14: facts with each dimension's attributes; Spark broadcasts what is small enough."""
    return reduce(lambda f, d: f.join(d[0], d[1], "left"), dims, fact)
