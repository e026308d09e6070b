"""Question and statement logs: route questions, take statements out of model output, screen them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milpa.functions import lexicons, text


def route_questions(df: DataFrame, column: str, lists: Mapping[str, Sequence[str]]) -> DataFrame:
    """Adds ``route`` (the first of ``new_query``, ``follow_up`` any of whose words occur, else ``neither``) and ``entities`` mentioned."""
    c = F.lower(F.coalesce(column, F.lit("")))
    holds = lambda words: F.exists(F.array(*map(F.lit, words)).cast("array<string>"), lambda w: F.contains(c, w))
    named = F.filter(F.array(*map(F.lit, lists["entities"])).cast("array<string>"), lambda w: F.contains(c, w))
    return df.withColumns({"route": F.when(holds(lists["new_query"]), "new_query").when(holds(lists["follow_up"]), "follow_up").otherwise("neither"), "entities": named})


def extract_statement(c: Column, refusal: str = lexicons.REFUSAL) -> Column:
    """Without fences; the refusal word if it occurs; else from the first ``select`` to the first ``;`` after it."""
    c = text.strip(F.regexp_replace(text.strip(c), "```(sql|SQL)?", ""))
    at = F.instr(F.upper(c), "SELECT")
    tail = F.when(at > 0, F.substring(c, at, F.length(c))).otherwise(c)
    end = F.instr(tail, ";")
    return F.when(F.contains(F.upper(c), F.lit(refusal)), refusal).otherwise(text.strip(F.when((at > 0) & (end > 0), F.substring(tail, F.lit(1), end)).otherwise(tail)))


def screen_statements(df: DataFrame, column: str, banned: Sequence[str] = lexicons.BANNED_WORDS, refusal: str = lexicons.REFUSAL) -> DataFrame:
    """Adds ``reason`` (null if the statement may run) and ``allowed``."""
    c = F.lower(text.strip(F.coalesce(column, F.lit(""))))
    reason = F.when(c == refusal.lower(), "refused").when(~c.startswith("select"), "not a select").when(F.regexp_like(c, F.lit("|".join(banned))), "banned word").when(F.contains(F.regexp_replace(c, ";+$", ""), F.lit(";")), "several statements")
    return df.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())
