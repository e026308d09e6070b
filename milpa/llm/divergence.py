"""Source divergence audit by chunk factorization: how far the term shares of each language's sources lie apart.

A chunk is a run without white space. The chunks of every document are counted where the document lies; equal chunks of a language then meet,
so that each globally distinct chunk is cut into terms once; its terms take over its counts and documents, and equal terms meet. On the
way a chunk or term carries its occurrences by source and the documents that hold it. As only "at least ``least`` documents" is asked, a
set of documents that has reached ``least`` is given up for that fact, which keeps every row small and the answer exact.

A term is kept in a language if ``least`` of its documents hold it. Shares are integers: ``1 + floor(10^9 (count + 5) / (N + 5 V))``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from milpa.llm._shared import slices, texts_of, words_of, written

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: bytes of text that are counted at a time, and terms in a block of (source, term) shares, about
SLICE, TERMS = 16 << 20, 2048
ROWS = "key string, records binary"


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of seven bits a byte, the last byte of each below 128; and where each ends."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        more = values >= np.int64(1) << np.int64(7 * k)
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        out[ends[live] - size[live] + k] = (values[live] >> np.int64(7 * k)) & 127 | np.where(size[live] > k + 1, 128, 0)
    return out, ends


def unpacked(data: np.ndarray) -> np.ndarray:
    """The numbers of :func:`packed`."""
    ends = np.flatnonzero(data < 128) + 1
    size = np.diff(ends, prepend=0)
    out = np.zeros(len(ends), np.int64)
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        out[live] |= (data[ends[live] - size[live] + k].astype(np.int64) & 127) << np.int64(7 * k)
    return out


def settled(row: np.ndarray, place: np.ndarray, doc: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Records in order of row and document, none twice; where a row has ``least`` documents, or is marked by document -1, one record a place
    with document -1."""
    rows = int(row[-1]) + 1 if len(row) else 0
    full = (np.bincount(row, minlength=rows) >= least) | (np.bincount(row, doc < 0, minlength=rows) > 0)
    hot = full[row]
    if not hot.any():
        return row, place, doc, n
    r, p, c = row[hot], place[hot], n[hot]
    order = np.lexsort((p, r))
    r, p, c = r[order], p[order], c[order]
    first = np.flatnonzero((np.diff(r, prepend=-1) != 0) | (np.diff(p, prepend=-1) != 0))
    r, p, c = r[first], p[first], np.add.reduceat(c, first)
    row, place, doc, n = np.concatenate([row[~hot], r]), np.concatenate([place[~hot], p]), np.concatenate([doc[~hot], np.full(len(r), -1)]), np.concatenate([n[~hot], c])
    order = np.argsort(row, kind="stable")
    return row[order], place[order], doc[order], n[order]


def merged(row: np.ndarray, place: np.ndarray, doc: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Records in any order: those of one row, place and document are added up, then :func:`settled`."""
    order = np.lexsort((place, doc, row))
    row, place, doc, n = row[order], place[order], doc[order], n[order]
    first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(doc, prepend=-2) != 0) | (np.diff(place, prepend=-1) != 0))
    return settled(row[first], place[first], doc[first], np.add.reduceat(n, first) if len(first) else n, least)


def _binary(keys: pa.Array, row: np.ndarray, place: np.ndarray, doc: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """One row a key; its records as numbers: place, step from the last document (0 where documents are given up), count."""
    begins = np.diff(row, prepend=-1) != 0
    step = np.where(begins, doc + 1, np.diff(doc, prepend=0))
    data, ends = packed(np.column_stack([place, step, n]).ravel().astype(np.int64))
    stops = np.concatenate([[0], ends[3 * np.cumsum(np.bincount(row, minlength=len(keys))) - 1]]) if len(keys) else np.zeros(1)
    records = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([keys.cast(pa.string()), records], names=["key", "records"])


def _records(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``row, place, doc, n`` of all records of a binary column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    count = np.diff(np.concatenate([[0], np.cumsum(data < 128)])[offsets - offsets[0]]) // 3
    place, step, n = unpacked(data).reshape(-1, 3).T
    row = np.repeat(np.arange(len(column)), count)
    total = np.cumsum(step)
    before = np.concatenate([[0], total])[np.cumsum(count) - count]
    return row, place, total - np.repeat(before, count) - 1, n


def _counted(least: int):
    def run(batches):
        base = TaskContext.get().partitionId() << 36
        for batch in slices(batches, "text", SLICE):
            codes, words, ends = words_of(texts_of(batch.column("text")))
            n, langs = batch.num_rows, batch.column("lang").dictionary_encode()
            lang, group = langs.indices.to_numpy().astype(np.int64), batch.column("group").to_numpy()
            doc = np.repeat(np.arange(n), np.diff(ends))
            pair, times = np.unique((codes * len(langs.dictionary) + lang[doc]) * n + doc, return_counts=True)
            key, d = np.divmod(pair, n)
            begins = np.diff(key, prepend=-1) != 0
            names = key[begins]
            terms, tongues = words.cast(pa.large_string()).take(pa.array(names // len(langs.dictionary))), langs.dictionary.cast(pa.large_string()).take(pa.array(names % len(langs.dictionary)))
            keys = pc.binary_join_element_wise(terms, tongues, pa.scalar("\n", pa.large_string()))
            if len(names):
                yield _binary(keys, *settled(np.cumsum(begins) - 1, group[d], base + d, times, least))
            base += n

    return run


def _met(least: int, last: bool):
    """Rows in order of ``key``: those of one key become one. ``last``: a row for each place of the keys that ``least`` documents hold."""

    def done(keys, row, place, doc, n):
        if not last:
            return _binary(keys, row, place, doc, n)
        kept = doc < 0
        return pa.RecordBatch.from_arrays([keys.take(pa.array(row[kept])).cast(pa.string()), pa.array(place[kept], pa.int64()), pa.array(n[kept], pa.int64())], names=["key", "group", "n"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, (row, place, doc, n) = batch.column("key"), _records(batch.column("records"))
            row = np.concatenate([[0], np.cumsum(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False))])[row]
            firsts = np.flatnonzero(np.diff(row, prepend=-1) != 0)
            starts = np.flatnonzero(np.concatenate([[True], pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)]))
            assert len(firsts) == len(starts)  # every row has records
            names = keys.take(pa.array(starts))
            if held is not None:
                if held[0][0] != names[0]:
                    yield done(held[0], *held[1])
                else:
                    row, place, doc, n = (np.concatenate([a, b]) for a, b in zip(held[1], (row, place, doc, n), strict=True))
            row, place, doc, n = merged(row, place, doc, n, least)
            end = int(np.searchsorted(row, len(names) - 1))
            if end:
                yield done(names[:-1], row[:end], place[:end], doc[:end], n[:end])
            held = names[-1:], (row[end:] * 0, place[end:], doc[end:], n[end:])
        if held is not None:
            yield done(held[0], *held[1])

    return run


def _keyed(df: DataFrame) -> DataFrame:
    """Equal keys side by side in one partition. A key has a row for each task before at most, so none outgrows the others."""
    return df.repartition("key").sortWithinPartitions("key")


def _name(key: str = "key") -> Column:
    return F.substring_index(key, "\n", 1)


def _lang(key: str = "key") -> Column:
    return F.expr(f"substring({key}, char_length(substring_index({key}, '\n', 1)) + 2)")


def kept_terms(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """``(groups(lang, source, group), counts(lang, term, group, n))``: all language and source pairs with a number, and the occurrences in each
    of the terms that at least ``least`` documents of the language hold, where there are any. See :func:`audit`."""
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    groups = written(docs.select("lang", "source").distinct().withColumn("group", F.monotonically_increasing_id()))
    numbered = docs.join(groups, ["lang", "source"]).select("text", "lang", "group")  # Spark broadcasts the pairs where they are small
    chunks = _keyed(numbered.mapInArrow(_counted(least), ROWS)).mapInArrow(_met(least, False), ROWS)
    terms = chunks.select(F.explode(F.regexp_extract_all(_name(), F.lit(TERM), F.lit(0))).alias("term"), _lang().alias("lang"), "records")
    met = _keyed(terms.select(F.concat_ws("\n", "term", "lang").alias("key"), "records")).mapInArrow(_met(least, True), "key string, group long, n long")
    return groups, written(met.select(_lang().alias("lang"), _name().alias("term"), "group", "n"))


def _share(n: str, total: str, kinds: str) -> Column:
    return F.expr(f"1 + ((cast(1000000000 as decimal(20,0)) * ({n} + 5)) div ({total} + 5 * {kinds}))")


def _apart(shares: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Sums over a block of terms of how far the shares of each two of a language's sources lie apart."""
    groups = groups.sort_values("group")
    names, codes = groups["group"].to_numpy(), pd.factorize(shares["term"])[0]
    cells = np.repeat(groups["p0"].to_numpy(np.int64)[:, None], codes.max(initial=-1) + 1, axis=1)
    cells[np.searchsorted(names, shares["group"].to_numpy()), codes] = shares["p"].to_numpy(np.int64)
    far = np.array([np.abs(cells - one).sum(axis=1) for one in cells])
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    return pd.DataFrame({"a": names[a], "b": names[b], "value": far[a, b]})


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank`` of ``docs(text, lang, source)``; every row is a document.

    Part ``pair``: for each other source of the language the sum, over all its kept terms, of the difference of both shares. Part ``term``: the
    ``top`` terms whose share in the source is most above that in the language. Ranks go from 1 by falling value, then by the item's UTF-8.
    A null text, language or source is the empty string; a source without terms has the share of count 0 for all; where a language has no
    kept term, its pairs have value 0; a language of one source has no pairs. Repeated rows are documents each. A text of any length is
    counted whole, by itself if it is longer than a slice of 16 MB. Further columns are ignored, an empty table gives no rows.
    """
    groups, counts = kept_terms(docs, least)
    kinds = counts.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kinds"))
    totals = counts.groupBy("group").agg(F.sum("n").alias("total"))
    sizes = groups.join(totals, "group", "left").join(kinds, "lang", "left").fillna(0, ["total", "kinds"])
    sizes = written(sizes.withColumn("p0", F.when(F.col("kinds") > 0, _share("0", "total", "kinds")).otherwise(F.lit(0).cast("long"))))
    shares = counts.join(sizes.select("group", "total", "kinds"), "group").select("lang", "term", "group", _share("n", "total", "kinds").alias("p"))
    languages = sizes.groupBy("lang").agg(F.sum("total").alias("total"), F.max("kinds").alias("kinds"))
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(languages, "lang").select("lang", "term", _share("n", "total", "kinds").alias("q"))

    above = shares.join(whole, ["lang", "term"]).where("p > q").select("group", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("value"), "item"))
    terms = above.withColumn("rank", place).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    blocks = -(-(sizes.agg(F.max("kinds")).first()[0] or 0) // TERMS) or 1
    left = shares.withColumn("block", F.expr(f"pmod(xxhash64(term), {blocks})")).groupBy("lang", "block")
    right = sizes.select("lang", "group", "p0", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")).groupBy("lang", "block")
    far = left.cogroup(right).applyInPandas(_apart, "a long, b long, value long").groupBy("a", "b").agg(F.sum("value").alias("value"))
    other = groups.select(F.col("group").alias("b"), F.col("source").alias("item"))
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("value"), "item"))
    pairs = far.join(other, "b").select(F.col("a").alias("group"), "item", "value").withColumn("rank", place).withColumn("part", F.lit("pair"))
    return pairs.unionByName(terms).join(groups, "group").select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
