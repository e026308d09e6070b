"""Posts: cut dumps into posts, take fields, flag noise, classify by rules, find places, rate confidence, summarise."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milpa.functions import lexicons, text


def segment(df: DataFrame, column: str = "text", min_len: int = 50) -> DataFrame:
    """One row per block between blank lines that is longer than ``min_len``: adds ``pos`` (from 0) and ``block``."""
    blocks = F.filter(F.transform(F.split(column, r"\n\s*\n"), text.strip), lambda b: F.length(b) > min_len)
    return df.select("*", F.posexplode(blocks).alias("pos", "block"))


def fields(c: Column, year_mark: str = "202") -> Column:
    """``user`` from the last line that begins with ``@``, ``date`` from the last other line with a year mark."""
    lines = F.split(c, "\n")
    last = lambda test: F.try_element_at(F.filter(lines, test), F.lit(-1))
    return F.struct(text.strip(last(lambda x: x.startswith("@"))).alias("user"), text.strip(last(lambda x: ~x.startswith("@") & x.contains(year_mark))).alias("date"))


def parse_name(c: Column, years: Sequence[int] = lexicons.YEARS, topic_map: Mapping[str, str] = lexicons.TOPICS) -> Column:
    """Year and topic from a file name; topics not in the map pass."""
    name = F.lower(F.regexp_replace(c, r"\.txt$", ""))
    found = F.nullif(F.regexp_extract(name, f"({'|'.join(map(str, years))})", 1), F.lit(""))
    topic = F.trim(F.replace(F.replace(name, F.coalesce(found, F.lit("\0")), F.lit("")), F.lit("violencia"), F.lit("")))
    known = F.create_map(*(F.lit(x) for pair in topic_map.items() for x in pair))
    return F.struct(found.cast("int").alias("year"), F.coalesce(F.try_element_at(known, topic), topic).alias("topic"))


def mentioned_year(c: Column, years: Sequence[int] = lexicons.YEARS) -> Column:
    """The first of the years that stands as a word."""
    return F.nullif(F.regexp_extract(c, rf"\b({'|'.join(map(str, years))})\b", 1), F.lit("")).cast("int")


def any_of(words: Sequence[str]) -> str:
    """One pattern for any of the words as substrings."""
    return "|".join(map(re.escape, words))


def plain_word(pattern: str) -> bool:
    return re.escape(pattern).replace("\\ ", " ") == pattern


def found(c: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern is found: plain words as substrings, which is far quicker than trying them as a pattern at every place."""
    plain = [p for p in patterns if plain_word(p)]
    rest = [p for p in patterns if p not in plain]
    tests = [F.contains(c, F.lit(p)) for p in plain] + ([F.regexp_like(c, F.lit("|".join(rest)))] if rest else [])
    return reduce(Column.__or__, tests)


def first_words(c: Column, lists: Sequence[Sequence[str]]) -> Column:
    """For each list of words the place, from 0, of the first of them in the list's order that the text holds, null if none: an array.

    All words of all lists lie in one automaton, so a text is read once, however many words there are. A null text holds none.
    """
    lists = [list(words) for words in lists]

    @F.pandas_udf("array<int>")
    def hits(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        places: dict[str, list[tuple[int, int]]] = {}
        for i, words in enumerate(lists):
            for rank, word in reversed(list(enumerate(words))):
                places.setdefault(word, []).append((i, rank))
        automaton = ahocorasick.Automaton()
        for word, where in places.items():
            automaton.add_word(word, where)
        automaton.make_automaton()

        def one(t: str | None) -> list[int | None]:
            best: list[int | None] = [None] * len(lists)
            for where in {id(w): w for _, w in automaton.iter(t or "")}.values() if places else ():
                for i, rank in where:
                    if best[i] is None or rank < best[i]:
                        best[i] = rank
            return best

        for s in texts:
            yield s.map(one)

    return hits(c)


def flag(c: Column, words: Sequence[str] = lexicons.WOMEN_WORDS) -> Column:
    """P5: ``si`` if any word occurs, else ``incierto``."""
    return F.when(found(c, words), "si").otherwise("incierto")


def noise(c: Column, words: Sequence[str] = lexicons.SPAM_WORDS, min_len: int = 25, media: Sequence[str] = lexicons.MEDIA_WORDS) -> Column:
    """``is_noise`` and ``reason``; the first that holds of too short, spam, media only."""
    c = F.lower(text.strip(c))
    reason = F.when(F.length(c) < min_len, "texto_vacio_o_muy_corto").when(found(c, words), "spam_o_irrelevante").when(c.isin(*media), "solo_multimedia")
    return F.struct(F.when(reason.isNotNull(), "si").otherwise("no").alias("is_noise"), reason.alias("reason"))


def classify(c: Column, tiers: Mapping[str, Sequence[str]] = lexicons.CONTENT_TIERS, other: str = lexicons.OTHER) -> Column:
    """The first tier any of whose patterns is found. The plain words of all tiers are sought at once, then the patterns of the tiers before the one that they give."""
    split = {k: ([p for p in patterns if plain_word(p)], [p for p in patterns if not plain_word(p)]) for k, patterns in tiers.items()}
    hits = first_words(c, [words for words, _ in split.values()])

    def chain(h: Column) -> Column:
        tests = [h[i].isNotNull() | F.regexp_like(c, F.lit("|".join(rest))) if rest else h[i].isNotNull() for i, (_, rest) in enumerate(split.values())]
        return F.coalesce(*(F.when(test, F.lit(k)) for k, test in zip(split, tests, strict=True)), F.lit(other))

    return F.element_at(F.transform(F.array(hits), chain), 1)  # bound to a variable, or the automaton would run for every tier


def locate(c: Column, user: Column | None = None, places: Mapping[str, tuple] = lexicons.PLACES) -> Column:
    """The longest place name that text or user holds, in map order among equals: ``key, town, state, level``."""
    user = F.lit(None).cast("string") if user is None else user
    whole = text.strip_accents(F.concat_ws(" ", c, user))
    order = sorted(places, key=len, reverse=True)
    row = lambda k: F.struct(F.lit(k).alias("key"), F.lit(places[k][1]).cast("string").alias("town"), F.lit(places[k][0]).alias("state"), F.lit(places[k][2]).alias("level"))
    state, town, level = lexicons.NO_PLACE
    none = F.struct(F.lit(None).cast("string").alias("key"), F.lit(town).cast("string").alias("town"), F.lit(state).alias("state"), F.lit(level).alias("level"))
    return F.coalesce(F.try_element_at(F.array(*map(row, order)), first_words(whole, [order])[0] + 1), none) if order else none


def confidence(kind: Column, c: Column, base: Mapping[str, int] = lexicons.CONFIDENCE, strong: Mapping[str, Sequence[str]] = lexicons.STRONG_WORDS) -> Column:
    """Hundredths by type, five more for each strong word, 0.99 at most."""
    start = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in base.items() for x in pair)), kind), F.lit(20))
    more = F.lit(0)
    for k, words in strong.items():
        more = F.when(kind == k, reduce(Column.__add__, (F.contains(F.lower(c), F.lit(w)).cast("int") for w in words))).otherwise(more)
    return (F.least(start + 5 * more, F.lit(99)) / 100).cast("decimal(4,2)")


def clean_posts(df: DataFrame, file: str = "file", column: str = "text") -> DataFrame:
    """P10: from dumps (file, text) to classified posts, one projection after the cut."""
    posts = segment(df, column).withColumns({"f": fields(F.col("block")), "n": parse_name(F.col(file)), "clean": text.clean_post(F.col("block"))})
    posts = posts.withColumns({"noise": noise(F.col("clean")), "place": locate(F.col("clean"), F.col("f.user")), "kind": classify(F.col("clean"))})
    return posts.select(
        F.col(file).alias("archivo_origen"),
        "pos",
        F.col("n.year").alias("anio"),
        F.col("n.topic").alias("tipo_violencia_archivo"),
        F.col("f.user").alias("usuario"),
        F.col("f.date").alias("fecha"),
        F.col("n.year").alias("anio_publicacion"),
        mentioned_year(F.col("clean")).alias("anio_mencionado"),
        F.col("block").alias("texto_original"),
        F.col("clean").alias("texto_limpio"),
        F.col("kind").alias("tipo_contenido"),
        confidence(F.col("kind"), F.col("clean")).alias("nivel_confianza"),
        F.col("place.key").alias("lugar_detectado"),
        F.col("place.town").alias("municipio_alcaldia"),
        F.col("place.state").alias("estado"),
        F.col("place.level").alias("nivel_ubicacion"),
        flag(F.col("clean")).alias("violencia_mujer"),
        F.col("noise.is_noise").alias("es_basura"),
        F.col("noise.reason").alias("motivo_basura"),
    )


def flatten_posts(df: DataFrame, query: str, platform: str = "X") -> DataFrame:
    """Raw API posts (id, created_at, text, user, url, lang, hashtags, mentions, repost_of) to flat ones."""
    return df.select(
        F.col("id").cast("string").alias("id_publicacion"),
        F.col("created_at").cast("timestamp").alias("fecha"),
        F.year("created_at").alias("anio"),
        F.month("created_at").alias("mes"),
        F.col("text").alias("texto"),
        F.col("user").alias("usuario"),
        "url",
        F.col("lang").alias("idioma"),
        F.coalesce("hashtags", F.array().cast("array<string>")).alias("hashtags"),
        F.coalesce("mentions", F.array().cast("array<string>")).alias("menciones"),
        F.col("repost_of").isNotNull().alias("es_repost"),
        F.lit(query).alias("query_origen"),
        F.lit(platform).alias("plataforma"),
    )


def dedupe_first(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Of rows with equal keys (nulls equal) the one with the least ordinal, by aggregation rather than a sort.

    A null ordinal comes last; among equal ordinals the row of the least hash stays.
    """
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col(ordinal).isNull(), F.col(ordinal), F.xxhash64(*rest))).alias("r"))
    return first.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(df.columns)


def summarize_posts(df: DataFrame, counts: Sequence[str], score: str, by: str) -> DataFrame:
    """A1: long ``metric, key, value``: total, counts by each column (nulls left out), mean score, and mean score by ``by``; one scan."""
    sets = [[], *([c] for c in dict.fromkeys([*counts, by]))]
    keys = [c for (c,) in sets[1:]]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, keys)).agg(F.count("*").alias("n"), F.sum(F.col(score).cast("decimal(18,4)")).alias("total"), F.count(score).alias("scored"), F.grouping_id().alias("g"))
    code = {c: sum(1 << i for i, k in enumerate(reversed(keys)) if k != c) for c in keys}
    every = (1 << len(keys)) - 1
    key = F.coalesce(*(F.when(F.col("g") == code[c], F.col(c).cast("string")) for c in keys))
    mean = F.try_divide(F.col("total").cast("double"), F.col("scored"))
    rows = [F.when(F.col("g") == every, F.struct(F.lit("total").alias("metric"), F.lit("").alias("key"), F.col("n").cast("double").alias("value")))]
    rows.append(F.when(F.col("g") == every, F.struct(F.lit(f"mean {score}").alias("metric"), F.lit("").alias("key"), mean.alias("value"))))
    rows += [F.when((F.col("g") == code[c]) & key.isNotNull(), F.struct(F.lit(c).alias("metric"), key.alias("key"), F.col("n").cast("double").alias("value"))) for c in counts]
    rows.append(F.when((F.col("g") == code[by]) & key.isNotNull(), F.struct(F.lit(f"mean {score} by {by}").alias("metric"), key.alias("key"), F.round(mean, 2).alias("value"))))
    return grouped.select(F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))
