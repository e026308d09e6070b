"""Sinks: CSV with a header, one folder of JSON a document, summaries, databases."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str) -> None:
    """CSV with header; the first column's name carries the byte order mark that spreadsheet programs look for."""
    df.withColumnRenamed(df.columns[0], f"﻿{df.columns[0]}").write.option("header", True).option("encoding", "UTF-8").csv(path)


def per_document(df: DataFrame, path: str, kind: str = "json", by: str = "documento") -> None:
    """One folder a document."""
    df.write.partitionBy(by).format(kind).save(path)


def summary(df: DataFrame) -> DataFrame:
    """A long summary (metric, key, value) as one JSON object a metric: ``metric, json``."""
    return df.groupBy("metric").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))).alias("json"))


def relational(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """S9."""
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def relational_swapped(df: DataFrame, url: str, table: str, **options: str) -> None:
    """S9, all or nothing: rows go into a staged table, in parallel; a single transaction then puts them in the place of the table's.

    A run that breaks off leaves the table as it was; the staged table, of a name of its own, can be dropped. The table must be there.
    """
    staged = f"{table}_{uuid.uuid4().hex[:12]}"
    df.write.format("jdbc").options(url=url, dbtable=staged, **options).mode("errorifexists").save()
    expected = df.sparkSession.read.format("jdbc").options(url=url, dbtable=staged, **options).load().count()
    jvm = df.sparkSession._jvm
    given = jvm.java.util.Properties()
    for name in {"user", "password"} & options.keys():
        given.setProperty(name, options[name])
    connection = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        dialect = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)
        names = ", ".join(dialect.quoteIdentifier(c) for c in df.columns)
        statement.executeUpdate(f"DELETE FROM {table}")
        stored = statement.executeUpdate(f"INSERT INTO {table} ({names}) SELECT {names} FROM {staged}")
        if stored != expected:
            raise ValueError("not all staged rows were stored")
        statement.executeUpdate(f"DROP TABLE {staged}")
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()
