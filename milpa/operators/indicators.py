"""Indicators: metadata, required columns, keep-first, wide to long, nested and text tables to long facts, audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milpa.functions import text
from milpa.operators.posts import dedupe_first


def attach_metadata(df: DataFrame, meta: DataFrame, how: str = "inner", file: str = "archivo_origen", default: str | None = None) -> DataFrame:
    """Metadata by file name; ``inner`` drops files without any, ``left`` keeps them and may fill ``default`` with the name."""
    out = df.join(meta, file, how)
    return out if default is None else out.withColumn(default, F.coalesce(default, file))


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The frame itself, or an error that lists what is missing; nothing is read."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """I3."""
    return df.dropna(subset=list(keys))


#: I4: keep-first by keys and ordinal.
dedupe_first = dedupe_first


def distinct_rows(df: DataFrame) -> DataFrame:
    """Whole rows, nulls equal."""
    return df.distinct()


def unpivot_years(df: DataFrame, id_cols: Sequence[str], lo: int = 1900, hi: int = 2100) -> DataFrame:
    """Columns named by a year between ``lo`` and ``hi`` become rows ``anio, valor`` (number or null); ids that are missing are skipped."""
    years = [c for c in df.columns if c.isdigit() and lo <= int(c) <= hi]
    ids = [c for c in id_cols if c in df.columns]
    if not years:
        return df.select(*ids, F.lit(None).cast("int").alias("anio"), F.lit(None).cast("double").alias("valor")).limit(0)
    long = df.select(*ids, *(F.col(f"`{y}`").cast("string").alias(y) for y in years)).unpivot(ids, years, "anio", "valor")
    return long.withColumns({"anio": F.col("anio").cast("int"), "valor": text.number(F.col("valor"))})


def union_files(dfs: Sequence[DataFrame]) -> DataFrame:
    """By name; columns a file lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def _is_year(c: Column, lo: int = 1900, hi: int = 2100) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit(r"^\d{1,9}$")) & c.try_cast("int").between(lo, hi), F.lit(False))


def header_years(rows: Column) -> Column:
    """I8: of an array of token rows, those with one token that is a year, in order."""
    return F.transform(F.filter(rows, lambda r: (F.size(r) == 1) & _is_year(F.try_element_at(r, F.lit(1)))), lambda r: F.try_element_at(r, F.lit(1)).cast("int"))


def split_row(row: Column) -> Column:
    """Numeric tokens as ``values``, the others joined as ``name``."""
    return F.struct(
        F.array_join(F.filter(row, lambda t: text.number(t).isNull() & (text.strip(t) != "")), " ").alias("name"),
        F.filter(F.transform(row, text.number), lambda v: v.isNotNull()).alias("values"),
    )


def nested_to_long(df: DataFrame, rows: str = "rows") -> DataFrame:
    """Each row's values against the table's years: one a year; several a year with a category; else no year, one category each."""
    keep = [c for c in df.columns if c != rows]
    parsed = df.select(*keep, header_years(F.col(rows)).alias("_years"), F.posexplode(rows).alias("row_no", "_row"))
    parsed = parsed.where(~((F.size("_row") == 1) & _is_year(F.try_element_at("_row", F.lit(1))))).withColumn("_s", split_row(F.col("_row"))).where("_s.name != '' and size(_s.values) > 0")
    cells = parsed.select(*keep, "row_no", "_years", F.col("_s.name").alias("entidad"), F.size("_s.values").alias("_n"), F.posexplode("_s.values").alias("_i", "valor"))
    y = F.size("_years")
    per = F.when((y > 0) & (F.col("_n") % y == 0), (F.col("_n") / y).cast("int"))
    at = F.floor(F.col("_i") / per).cast("int") + 1
    return cells.select(
        *keep,
        "row_no",
        "entidad",
        F.when(per.isNotNull(), F.try_element_at("_years", at)).alias("anio"),
        F.when(per == 1, F.lit(None)).when(per.isNotNull(), F.concat(F.lit("categoria_"), (F.col("_i") % per + 1).cast("string"))).otherwise(F.concat(F.lit("valor_"), (F.col("_i") + 1).cast("string"))).alias("categoria"),
        "valor",
    )


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), text.strip), lambda x: x != "")


def parse_text_table(c: Column) -> Column:
    """``columns``: lines before the first with a digit; ``rows``: the others cut at white space."""
    lines = _lines(c)
    marks = F.transform(lines, lambda x: F.regexp_like(x, F.lit(r"\d")))
    head = F.when(F.array_contains(marks, True), F.array_position(marks, True) - 1).otherwise(F.size(lines)).cast("int")
    return F.struct(F.slice(lines, F.lit(1), head).alias("columns"), F.transform(F.slice(lines, head + 1, F.size(lines)), lambda x: F.split(x, r"\s+")).alias("rows"))


def parse_fixed_tail(c: Column, years: Sequence[int], skip: int = 5) -> Column:
    """Array of ``name, anio, valor`` from lines whose last tokens are the given years' values; bad numbers are left out."""
    lines, n = _lines(c), len(years)
    rows = F.filter(F.transform(F.slice(lines, skip + 1, F.greatest(F.size(lines), F.lit(1))), lambda x: F.split(x, r"\s+")), lambda r: F.size(r) > n)
    wide = F.transform(
        rows,
        lambda r: F.transform(
            F.arrays_zip(F.slice(r, -n, n).alias("v"), F.array(*map(F.lit, years)).alias("y")),
            lambda z: F.struct(F.array_join(F.slice(r, F.lit(1), F.size(r) - n), " ").alias("name"), z["y"].alias("anio"), text.number(z["v"]).alias("valor")),
        ),
    )
    return F.filter(F.flatten(wide), lambda x: x["valor"].isNotNull())


def audit_tables(df: DataFrame, topic: str = "tema", key: Sequence[str] = ("tema", "subtema", "indicador"), rows: str = "filas") -> DataFrame:
    """By topic the tables, those without rows, and the distinct keys."""
    return df.groupBy(topic).agg(F.count("*").alias("tables"), F.count_if(F.coalesce(F.size(rows), F.lit(0)) <= 0).alias("empty"), F.count_distinct(F.struct(*key)).alias("indicators"))


def summarize_indicators(df: DataFrame, top: int = 10) -> DataFrame:
    """A2: ``metric, key, value``: rows by indicator, by year, and the ``top`` entities."""
    by = lambda c, name: df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("key")).agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "key", "value")
    return by("nombre_indicador", "indicator").union(by("anio", "year")).union(by("entidad", "entity").orderBy(F.desc("value"), "key").limit(top))
