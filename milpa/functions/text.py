"""Text scalars: each takes a column and gives a column, in the JVM but for the two that need full Unicode tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from milpa.functions import lexicons


def _bare(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")


# Latin letters whose bare form is one letter, by Unicode's own tables
_LATIN = {chr(i): _bare(chr(i)) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(_bare(chr(i))) == 1 and _bare(chr(i)) != chr(i)}
# marks that stand alone
_MARKS = "".join(chr(i) for i in range(0x300, 0x20000) if unicodedata.category(chr(i)) == "Mn")


@F.pandas_udf(T.StringType())
def _strip_any(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _bare(t))


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_accents(c: Column, full: bool = False) -> Column:
    """Lower case without accents, whether letters carry them or they stand alone; null stays null.

    ``full`` goes beyond Latin letters, in an Arrow batch.
    """
    if full:
        return _strip_any(F.lower(c))
    low = F.lower(c)
    bare = F.translate(low, "".join(_LATIN) + _MARKS, "".join(_LATIN.values()))  # what has no counterpart is dropped
    return F.when(F.octet_length(c) == F.char_length(c), low).otherwise(bare)


def clean_post(c: Column, phrases: Iterable[str] = lexicons.UI_PHRASES) -> Column:
    """Lower, bare letters, no links, mentions, hash signs, interface phrases or odd characters, white space squeezed."""
    c = F.regexp_replace(F.regexp_replace(strip_accents(c), r"http\S+", " "), r"@\w+", " ")
    c = F.replace(c, F.lit("#"), F.lit(""))
    for phrase in phrases:
        c = F.replace(c, F.lit(phrase), F.lit(" "))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^a-zA-Z0-9áéíóúñ\s]", " "), r"\s+", " "))


def compose(c: Column) -> Column:
    """Canonical composition, white space squeezed and trimmed; null stays null."""
    return F.trim(F.regexp_replace(_compose(c), r"(?U)\s+", " "))


def slug(c: Column, every: bool = True) -> Column:
    """T4 for values: lower case; runs of anything but ``a-z0-9`` (or only spaces) become ``_``."""
    if not every:
        return F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))
    return F.regexp_replace(F.regexp_replace(strip_accents(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def slug_columns(df: DataFrame, every: bool = True) -> DataFrame:
    """T4 for headers."""
    one = (lambda n: re.sub("[^a-z0-9]+", "_", _bare(n.strip().lower())).strip("_")) if every else (lambda n: n.strip().lower().replace(" ", "_"))
    return df.toDF(*map(one, df.columns))


def null_like(c: Column, words: Iterable[str] = lexicons.NULL_WORDS) -> Column:
    """T5: trimmed; words that stand for nothing become null."""
    return F.when(~F.lower(strip(c)).isin(*words), strip(c))


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(c: Column) -> Column:
    """A plain decimal number, thousands commas dropped; anything else is null (also inf, nan and underscores)."""
    c = F.replace(strip(c), F.lit(","), F.lit(""))
    return F.when(F.regexp_like(c, F.lit(_NUMBER)), c.try_cast("double"))


def year(c: Column) -> Column:
    """A whole number through double, else null."""
    return F.when(number(c) == F.floor(number(c)), number(c).try_cast("int"))


def date(c: Column) -> Column:
    """A date by year, month and day, with or without leading zeros, parted by ``-`` or ``/``, a time of day behind it or not; else null."""
    day = F.regexp_extract(strip(c), r"^(\d{4}([-/])\d{1,2}\2\d{1,2})([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$", 1)
    return F.replace(day, F.lit("/"), F.lit("-")).try_cast("date")


def repaired(c: Column) -> Column:
    """A text whose UTF-8 bytes were read as Latin-1, read rightly; any other text as it is."""
    garbled = F.regexp_like(c, F.lit(r"[\u00C2-\u00F4][\u0080-\u00BF]")) & F.regexp_like(c, F.lit(r"^[\u0000-\u00FF]*$"))
    raw = F.encode(F.when(garbled, c), "ISO-8859-1").cast("string")
    return F.when(garbled & F.is_valid_utf8(raw), raw).otherwise(c)


def canonical_name(c: Column, mapping: Mapping[str, str] = lexicons.STATE_NAMES) -> Column:
    """Garbled names are repaired, others looked up once; names not in the map pass."""
    known, name = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair)), F.trim(c)
    right = repaired(name)
    return F.when(right != name, right).otherwise(F.coalesce(F.try_element_at(known, name), name))


def clean_page(c: Column) -> Column:
    """Line ends unified, no control characters, blanks squeezed, none before punctuation, at most one empty line."""
    c = F.regexp_replace(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\s+([.,;:!?])", "$1")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def squeeze(c: Column) -> Column:
    """Blanks squeezed, at most one empty line, trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def duplicate_key(c: Column) -> Column:
    """Lower case, white space squeezed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def expand_acronyms(c: Column, mapping: Mapping[str, str] = lexicons.ACRONYMS) -> Column:
    """The text with ``(meaning)`` of every acronym that it holds as a word, in the map's order."""
    return F.concat(c, *(F.when(F.regexp_like(c, F.lit(rf"(?iu)\b{re.escape(k)}\b")), F.lit(f" ({v})")).otherwise("") for k, v in mapping.items()))
