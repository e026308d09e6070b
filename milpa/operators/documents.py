"""Documents: page coverage, page markers, packing paragraphs into overlapping chunks, numbering, scrubbing and its statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from milpa.functions import lexicons, text
from milpa.storage import written

PAGE = "--- PÁGINA {} ---"
_PAGE_RE = r"--- PÁGINA (\d+) ---"


def page_coverage(pages: DataFrame, column: str = "texto") -> DataFrame:
    """Per document pages, pages with text, percent and status."""
    per = pages.groupBy("documento").agg(F.count("*").alias("pages"), F.count_if(text.strip(F.col(column)) != "").alias("with_text"))
    share = F.coalesce(F.round(F.try_divide(100 * F.col("with_text"), F.col("pages")), 2), F.lit(0.0))
    return per.withColumn("percent", share).withColumn("status", F.when(F.col("percent") >= 90, "OK").when(F.col("percent") >= 50, "REVISAR").otherwise("POSIBLE PDF ESCANEADO"))


def split_pages(docs: DataFrame) -> DataFrame:
    """(documento, texto) with page lines to one row a page: ``pos`` from 0 in order, ``pagina``, ``texto``; what stands before the first is dropped.

    For documents that fit a cell; ``split_lines`` takes documents of any length.
    """
    numbers = F.regexp_extract_all("texto", F.lit(_PAGE_RE), 1)
    parts = F.split("texto", _PAGE_RE)
    zipped = F.arrays_zip(F.transform(numbers, lambda n: n.try_cast("int")).alias("pagina"), F.slice(parts, F.lit(2), F.size(parts)).alias("texto"))
    return docs.select("documento", F.posexplode(zipped).alias("pos", "p")).select("documento", "pos", F.col("p.pagina").alias("pagina"), text.strip(F.col("p.texto")).alias("texto"))


def split_lines(lines: DataFrame) -> DataFrame:
    """D2 for documents of any length: (documento, linea, texto), each row one line or more, to what ``split_pages`` gives for the rows joined by line breaks.

    Rows are dealt out by ranges of (documento, linea) and written; page lines are counted inside a range and carried on from range to range,
    so only a page, never a document, meets in one task. Null documents are one, null lines come first, rows of one number are ordered by a hash of
    their text, a null text is empty; a number beyond an int is null.
    """
    t = F.coalesce("texto", F.lit(""))
    numbers, order = F.regexp_extract_all(t, F.lit(_PAGE_RE), 1), ["linea", "h", "k"]
    cut = F.transform(F.split(t, _PAGE_RE), lambda x, i: F.struct(i.alias("k"), F.get(numbers, i - 1).try_cast("int").alias("pagina"), x.alias("texto")))
    ranges = lines.select("documento", "linea", "texto").repartitionByRange("documento", "linea").select("documento", "linea", F.spark_partition_id().alias("part"), F.xxhash64(t).alias("h"), F.inline(cut))
    ranges = written(ranges)
    begins = F.count_if(F.col("k") > 0)
    inside = ranges.withColumn("inside", begins.over(Window.partitionBy("part", "documento").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    counts = ranges.groupBy("part", "documento").agg(begins.alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("documento").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("part").alias("_p"), F.col("documento").alias("_d"), before.alias("before"))
    placed = inside.join(counts, (inside["part"] == counts["_p"]) & inside["documento"].eqNullSafe(counts["_d"])).withColumn("pos", (F.col("before") + F.col("inside") - 1).cast("int"))
    held = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "texto"))), lambda x: x["texto"]), "\n")
    return placed.where("pos >= 0").groupBy("documento", "pos").agg(F.max("pagina").alias("pagina"), text.strip(held).alias("texto"))


def mark_pages(pages: DataFrame) -> DataFrame:
    """D2 back, for documents of any length: (documento, linea, texto), a row a page that begins with its page line. Null numbers are no pages."""
    return pages.where("pagina is not null").select("documento", F.col("pagina").alias("linea"), F.concat(F.lit("--- PÁGINA "), F.col("pagina").cast("string"), F.lit(" ---\n"), F.coalesce("texto", F.lit(""))).alias("texto"))


def join_pages(pages: DataFrame) -> DataFrame:
    """D2 back: pages by number to one marked text per document, for documents that fit a cell."""
    one = F.concat(F.lit("--- PÁGINA "), F.col("pagina").cast("string"), F.lit(" ---\n"), F.coalesce("texto", F.lit("")))
    return pages.groupBy("documento").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pagina", one.alias("t")))), lambda x: x["t"]), "\n\n").alias("texto"))


def pack(page: str | None, max_chars: int = 1400, overlap: int = 1) -> list[str]:
    """Chunks of one cleaned page: paragraphs are lines; a full chunk is closed and the next begins with its last ``overlap`` paragraphs.

    A paragraph above the limit is cut into stretches of the limit and breaks the overlap. A chunk may pass the limit by its overlap.
    """
    chunks: list[str] = []
    held: list[str] = []
    size = 0
    for paragraph in filter(None, (line.strip() for line in (page or "").split("\n"))):
        cost = len(paragraph) + 1
        if size + cost > max_chars:
            if held:
                chunks.append("\n".join(held))
            held = held[-overlap:] if overlap else []
            if len(paragraph) > max_chars:
                chunks += filter(None, (paragraph[i : i + max_chars].strip() for i in range(0, len(paragraph), max_chars)))
                held, size = [], 0
                continue
            size = sum(len(p) + 1 for p in held)
        held.append(paragraph)
        size += cost
    if held:
        chunks.append("\n".join(held))
    return chunks


def pack_pages(pages: DataFrame, max_chars: int = 1400, overlap: int = 1) -> DataFrame:
    """D3: (documento, pos, pagina, texto) to chunks (documento, pos, pagina, chunk_pos, texto); pages never share a chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b.assign(texto=b["texto"].map(lambda t: pack(t, max_chars, overlap))).explode("texto")
            out["chunk_pos"] = out.groupby(level=0).cumcount()
            yield out[out["texto"].notna()][["documento", "pos", "pagina", "chunk_pos", "texto"]]

    cleaned = pages.select("documento", F.col("pos").cast("int").alias("pos"), F.col("pagina").cast("int").alias("pagina"), text.clean_page(F.col("texto")).alias("texto"))
    return cleaned.mapInPandas(run, "documento string, pos int, pagina int, chunk_pos int, texto string")


def number_chunks(chunks: DataFrame, min_chars: int = 100) -> DataFrame:
    """Chunks below ``min_chars`` are dropped, the others numbered from 1 by page and place within a document.

    Over a whole document only counts per page are put in order; texts are sorted within their page. Null documents are one, and so are null
    pages of a document, which come first.
    """
    kept = chunks.where(F.length(F.trim("texto")) >= min_chars).withColumn("in_page", F.row_number().over(Window.partitionBy("documento", "pos").orderBy("chunk_pos")))
    counts = kept.groupBy("documento", "pos").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("documento").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("documento").alias("_d"), F.col("pos").alias("_p"), before.alias("before"))
    return kept.join(counts, kept["documento"].eqNullSafe(counts["_d"]) & kept["pos"].eqNullSafe(counts["_p"])).select("documento", "pagina", (F.col("before") + F.col("in_page")).cast("int").alias("chunk_id"), "texto")


def exclude(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """D5."""
    return df.where(~F.col("documento").isin(*names))


def drop_lines(c: Column, headers: Sequence[str] = lexicons.HEADER_LINES) -> Column:
    """Without lines that are, trimmed, one of the headers."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~text.strip(x).isin(*headers)), "\n")


def apply_rules(df: DataFrame, rules: Sequence[tuple[str, str, str]], column: str = "texto") -> DataFrame:
    """Rules (document, pattern, replacement), in order, each on its document only."""
    c = F.col(column)
    for name, pattern, instead in rules:
        c = F.when(F.col("documento") == name, F.regexp_replace(c, pattern, instead)).otherwise(c)
    return df.withColumn(column, c)


#: The default rules of D7: what is taken out of one document.
RULES = tuple((lexicons.LAW, pattern, "") for pattern in lexicons.LAW_RULES)


def scrub(chunks: DataFrame, headers: Sequence[str] = lexicons.HEADER_LINES, rules: Sequence[tuple[str, str, str]] = RULES, excluded: Sequence[str] = ()) -> DataFrame:
    """Without excluded documents, header lines and what rules remove; emptied chunks go, ids stay."""
    out = apply_rules(exclude(chunks, excluded).withColumn("texto", drop_lines(F.col("texto"), headers)), rules)
    return out.withColumn("texto", text.squeeze(F.col("texto"))).where("texto != ''")


def scrub_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per document and in all (``total``): chunks in, out, modified, emptied; characters before, after, removed.

    Only lengths and hashes of texts move. Null documents are one, and so are null ids; a null text counts as empty.
    """
    told = lambda df, n: df.select(F.col("documento").alias(f"_d{n}"), F.col("chunk_id").alias(f"_c{n}"), F.coalesce(F.length("texto"), F.lit(0)).alias(f"_n{n}"), F.sha2(text.strip(F.coalesce("texto", F.lit(""))), 256).alias(f"_h{n}"))
    b, a = told(before, "b").withColumnRenamed("_db", "documento"), told(after, "a")
    both = b.join(a, b["documento"].eqNullSafe(a["_da"]) & b["_cb"].eqNullSafe(a["_ca"]), "left")
    out = both.rollup("documento").agg(
        F.count("*").alias("chunks_in"),
        F.count("_ha").alias("chunks_out"),
        F.count_if(F.col("_ha") != F.col("_hb")).alias("modified"),
        F.count_if(F.col("_ha").isNull()).alias("emptied"),
        F.sum("_nb").alias("chars_before"),
        F.sum(F.coalesce("_na", F.lit(0))).alias("chars_after"),
        (F.grouping("documento") == 1).alias("total"),
    )
    return out.withColumn("chars_removed", F.col("chars_before") - F.col("chars_after"))


def curated_chunks(records: DataFrame) -> DataFrame:
    """(documento, registros) to chunks: those marked for use with text, numbered from 0 in order."""
    usable = F.filter("registros", lambda r: r["incluir_rag"] & (text.strip(r["texto_rag"]) != ""))
    return records.select("documento", F.posexplode(usable).alias("chunk_id", "r")).select("documento", "chunk_id", "r.pagina", text.strip(F.col("r.texto_rag")).alias("texto"), "r.tema", "r.tipo_contenido", "r.tipo_registro", "r.periodo", "r.ambito_geografico")


def chunk_stats(chunks: DataFrame, min_chars: int = 100) -> DataFrame:
    """Per document pages, chunks kept, and chunks dropped as too small."""
    small = F.length(F.trim("texto")) < min_chars
    return chunks.groupBy("documento").agg(F.count_distinct("pagina").alias("pages"), F.count_if(~small).alias("chunks"), F.count_if(small).alias("dropped"))
