"""Chunk review: length profiles, flags, duplicates, residual noise, kept content, before and after."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from milpa.functions import lexicons, text

KEY = ["documento", "chunk_id"]


def length_profile(df: DataFrame, trimmed: bool = True) -> DataFrame:
    """Per document chunks, pages, and least, most, mean and median length."""
    n = F.length(text.strip(F.col("texto")) if trimmed else F.col("texto"))
    return df.groupBy("documento").agg(F.count("*").alias("chunks"), F.count_distinct("pagina").alias("pages"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.try_divide(F.sum(n), F.count(n)), 6).alias("mean"), F.round(F.median(n), 6).alias("median"))


def flags(df: DataFrame, short: int = 150, long: int = 1500) -> DataFrame:
    """R2: adds ``is_short, is_long, has_control, suspicious_start``, on trimmed text."""
    t = text.strip(F.col("texto"))
    first = F.substring(t, 1, 1)
    return df.withColumns(
        {
            "is_short": F.length(t) < short,
            "is_long": F.length(t) > long,
            "has_control": F.regexp_like(t, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")),
            "suspicious_start": F.regexp_like(first, F.lit(r"[\p{Ll},.;:)]")),
        }
    )


def duplicates(df: DataFrame) -> DataFrame:
    """Adds ``is_duplicate``: the same text as an earlier chunk of its document, null documents being one. Found by a hash of the key, with the first id
    aggregated. A null text is no duplicate, a null id comes after none."""
    keyed = df.withColumn("_k", F.sha2(text.duplicate_key(F.col("texto")), 256))
    first = keyed.where("_k is not null").groupBy(F.col("documento").alias("_d"), F.col("_k").alias("_h")).agg(F.min("chunk_id").alias("_first"))
    both = keyed.join(first, keyed["documento"].eqNullSafe(first["_d"]) & (keyed["_k"] == first["_h"]), "left")
    return both.withColumn("is_duplicate", F.coalesce(F.col("chunk_id") > F.col("_first"), F.lit(False))).drop("_k", "_first", "_d", "_h")


def strong_problems(df: DataFrame, short: int = 150, long: int = 1500) -> DataFrame:
    """Per document and in all (``total``): chunks, those short, long, with control characters or duplicate, and their percent. A null text has no
    problem, a null document is one of its own."""
    bad = duplicates(flags(df, short, long)).withColumn("bad", F.expr("coalesce(is_short or is_long or has_control, false) or is_duplicate"))
    per = bad.groupBy(*KEY).agg(F.max("bad").alias("bad"))
    sums = per.rollup("documento").agg(F.count("*").alias("chunks"), F.count_if("bad").alias("problems"), (F.grouping("documento") == 1).alias("total"))
    return sums.withColumn("percent", F.round(F.try_divide(100 * F.col("problems"), F.col("chunks")), 2))


def sample(df: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """At most ``n`` chunks a document, the same in every run: those of least hash."""
    w = Window.partitionBy("documento").orderBy(F.xxhash64("documento", "chunk_id", F.lit(seed)), "chunk_id")
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def residual(df: DataFrame, patterns: Mapping[str, str] = lexicons.RESIDUAL_PATTERNS) -> DataFrame:
    """One row for each chunk and pattern, in any case, that it still holds; one pass over the chunks."""
    hits = F.array(*(F.when(F.regexp_like("texto", F.lit(f"(?iu){p}")), F.lit(name)) for name, p in patterns.items()))
    return df.select(*KEY, F.explode(F.array_compact(hits)).alias("pattern"))


def preserved(df: DataFrame, doc: str, patterns: Mapping[str, str] = lexicons.KEPT_PATTERNS) -> DataFrame:
    """How often each pattern occurs in a document's whole text, chunks joined by line breaks; ok if at all."""
    whole = df.where(F.col("documento") == doc).groupBy("documento").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "texto"))), lambda x: x["texto"]), "\n").alias("t"))
    found = F.array(*(F.struct(F.lit(name).alias("pattern"), F.regexp_count("t", F.lit(f"(?iu){p}")).alias("times")) for name, p in patterns.items()))
    return whole.select("documento", F.inline(found)).withColumn("ok", F.col("times") > 0)


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Chunks in both whose trimmed texts differ, with both lengths."""
    b, a = before.select(*KEY, text.strip(F.col("texto")).alias("b")), after.select(*KEY, text.strip(F.col("texto")).alias("a"))
    return b.join(a, KEY).where("a != b").select(*KEY, F.length("b").alias("before"), F.length("a").alias("after"))


def corpus_totals(df: DataFrame, short: int = 150, long: int = 1500) -> DataFrame:
    """Over all documents: documents, chunks, characters, and chunks under each flag."""
    f = duplicates(flags(df, short, long))
    return f.agg(F.count_distinct("documento").alias("documents"), F.count("*").alias("chunks"), F.sum(F.length("texto")).alias("chars"), *(F.count_if(c).alias(c) for c in ("is_short", "is_long", "has_control", "suspicious_start", "is_duplicate")))


def absent(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """For each name its chunks left, ok if none."""
    wanted = df.sparkSession.createDataFrame([(n,) for n in names], "documento string")
    return wanted.join(df.where(F.col("documento").isin(*names)).groupBy("documento").count(), "documento", "left").select("documento", F.coalesce("count", F.lit(0)).alias("chunks"), F.col("count").isNull().alias("ok"))
