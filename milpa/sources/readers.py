"""Sources: folders of texts, CSV of either encoding, nested JSON, tables in HTML, chunk files; all through Spark's readers."""

from __future__ import annotations

import csv as _csv
import io
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = "tema string, subtema string, indicador string, tabla struct<columnas: array<string>, filas: array<array<string>>>"
CHUNKS = "documento string, pagina int, chunk_id int, texto string"


def file_name() -> Column:
    """The name of a row's file; Spark gives it in the form that addresses have, a blank as ``%20``."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """``file, text``, one row a file."""
    return spark.read.text(path, wholetext=True).select(file_name().alias("file"), F.col("value").alias("text"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CSV texts to ``archivo_origen, names, cells``, a row for each record; quotes may hold commas, quotes and line breaks."""
    for batch in batches:
        for file, body in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
            rows = (r for r in _csv.reader(io.StringIO((body or "").removeprefix("\ufeff"), newline="")) if r)
            names = next(rows, None)
            while names and (some := list(islice(rows, 10_000))):
                cells = [[c or None for c in r[: len(names)]] + [None] * (len(names) - len(r)) for r in some]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(some)), pa.array([names] * len(some), pa.list_(pa.string())), pa.array(cells, pa.list_(pa.string()))], names=["archivo_origen", "names", "cells"])


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with header and ``archivo_origen``; files that aren't UTF-8 are read as Latin-1, decided file by file; an empty folder has no rows.

    Files are decoded and cut into records where they are read; of their paths the driver sees none. Columns go by name: those of ``schema``, a
    cell that doesn't fit its type being null, or else all that any file has, as text. Empty cells are null, cells beyond the header are dropped.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path)
    body = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    rows = raw.select(file_name().alias("file"), body.alias("text")).mapInArrow(_records, "archivo_origen string, names array<string>, cells array<string>")
    if schema is None:
        heads = [r[0] for r in rows.select("names").distinct().sort("names").collect()]  # the different headers, not the files
        fields = [T.StructField(n, T.StringType()) for n in dict.fromkeys(x for h in heads for x in h)]
    else:
        fields = T.StructType.fromDDL(schema).fields
    cell = lambda f: F.try_element_at("cells", F.array_position("names", f.name).cast("int")).try_cast(f.dataType).alias(f.name)
    return rows.select(*(F.when(F.array_contains("names", f.name), cell(f)).alias(f.name) for f in fields), "archivo_origen")


def nested_json(spark: SparkSession, path: str) -> DataFrame:
    """S3: the records of array files."""
    return spark.read.schema(NESTED).json(path, multiLine=True)


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def close_cell(self) -> None:
        if self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("table", "tr", "td", "th"):
            self.close_cell()
        if tag == "table":
            self.tables.append([])
        elif self.tables and tag == "tr":
            self.tables[-1].append([])
        elif self.tables and tag in ("td", "th"):
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell = []

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self.close_cell()


def tables_of(html: str | None) -> list[tuple[int, int, list[str | None]]]:
    """``table, row, cells`` of a page: tables from 1; rows and columns without any text are dropped, ragged rows filled up."""
    parser = _Tables()
    parser.feed(html or "")
    out = []
    for number, rows in enumerate(parser.tables, 1):
        width = max(map(len, rows), default=0)
        full = [[*(c or None for c in r), *[None] * (width - len(r))] for r in rows]
        used = [i for i in range(width) if any(r[i] for r in full)]
        out += [(number, i, [r[j] for j in used]) for i, r in enumerate(r for r in full if any(r))]
    return out


def html_tables(pages: DataFrame, file: str = "file", column: str = "html") -> DataFrame:
    """``file, table_no, row_no, cells`` of every table in HTML texts (or bytes, whatever their name says)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, *t) for f, h in zip(b[file], b[column], strict=True) for t in tables_of(h.decode("utf-8", "replace") if isinstance(h, bytes) else h)]
            yield pd.DataFrame(rows, columns=["file", "table_no", "row_no", "cells"])

    return pages.select(F.col(file).alias(file), column).mapInPandas(run, "file string, table_no int, row_no int, cells array<string>")


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """S5."""
    return spark.read.schema(CHUNKS).json(path, multiLine=True)


def relational(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of a database; with a numeric ``key`` in ``parts`` parallel ranges between its least and greatest value, null keys in the first."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    if key is None:
        return reader.option("dbtable", table).load()
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    ends = reader.option("dbtable", f"(SELECT MIN({quoted}) AS lo, MAX({quoted}) AS hi FROM {table}) ends").load().first()
    if ends[0] is None:
        return reader.option("dbtable", table).load()
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(int(ends[0])), upperBound=str(int(ends[1]) + 1), numPartitions=str(parts), **options).load()
