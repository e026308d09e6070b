"""Ranked lexical search: accumulator-limited, term at a time.

An index of the documents is written once: in blocks of documents, each term with its documents and counts. Blocks gather in shards, which
score by themselves. There the terms of an item come rarest first, and a document gets an accumulator when a term brings it for the first
time. As soon as what the terms still to come can add is less than the k-th best partial score, no new accumulator can reach the best
``k``: none is made from then on, those that can't reach it either are given up, and the others are updated exactly. The best of all
shards are merged.

A document's score sums ``weight * ((10^9 tf) div (1000 tf + 8 m))`` over the item's terms, repeats included, with
``weight = floor(1000 ln((2 N + 2) / (2 df + 1)))`` and ``m = 25 + (75 n N) div L``; all but the logarithm is 64-bit integer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from milpa.llm._shared import bytes_of, slices, texts_of, words_of, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: bytes of text in a block of the index, of postings in a shard, and of items that are scored in one pass
SLICE, SHARD, ITEMS = 8 << 20, 16 << 20, 4 << 20
INDEX = "block long, term string, docs binary, counts binary, n_docs long, n_terms long"
#: what each byte of a text becomes: digits, letters and all beyond ASCII stay, anything else separates terms
KEPT = np.array([x if chr(x).isalnum() and x < 128 or x >= 128 else 32 for x in range(256)], np.uint8)


def _terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all terms, the distinct terms, and offsets by text."""
    data, offsets = bytes_of(texts)
    return words_of(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(KEPT[data])))


def _indexed(batches):
    base = TaskContext.get().partitionId() << 32
    for seq, batch in enumerate(slices(batches, "text", SLICE)):
        codes, words, ends = _terms_of(texts_of(batch.column("text")))
        n, lengths = batch.num_rows, np.diff(ends)
        ids = batch.column("doc_id")
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        pair, times = np.unique(codes * n + np.repeat(np.arange(n), lengths), return_counts=True)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(pair // n, minlength=len(words)))]).astype(np.int32) * 4 if len(pair) else np.zeros(len(words) + 1, np.int32)
        column = lambda x: pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(cuts), pa.py_buffer(x.astype("<u4"))])  # noqa: B023, E731
        block = base + seq
        # one row of the block itself: ids, and lengths, -1 - length where there is no id
        yield pa.RecordBatch.from_pylist(
            [{"block": block, "term": "", "docs": ids.fill_null(0).to_numpy().astype("<i8").tobytes(), "counts": np.where(missing, -1 - lengths, lengths).astype("<i8").tobytes(), "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum())}],
            pa.schema([("block", pa.int64()), ("term", pa.string()), ("docs", pa.binary()), ("counts", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())]),
        )
        sized = pa.array(np.diff(cuts) // 4, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block)), words.cast(pa.string()), column(pair % n if n else pair), column(times), sized, pa.nulls(len(words), pa.int64())], names=["block", "term", "docs", "counts", "n_docs", "n_terms"])


def index(docs: DataFrame) -> DataFrame:
    """``block, term, docs, counts, n_docs, n_terms`` of ``docs(doc_id, text)``: per block of documents each term with its documents (places in the
    block) and how often they hold it; the row of the empty term has the block's ``doc_id`` and lengths."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_indexed, INDEX)


def best(postings: list[tuple[np.ndarray, np.ndarray, int]], n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of all documents of ``n`` that can be among the best ``k``: ``postings`` has, rarest term first, the places that hold a
    term, in order, what a single weight gives them, and the weight."""
    coming = np.cumsum([w * int(part.max(initial=0)) for _, part, w in reversed(postings)])[::-1].tolist() + [0]
    score, made, alive = np.zeros(n, np.int64), np.zeros(n, bool), None
    for i, (at, part, weight) in enumerate(postings):
        if alive is None:
            score[at] += weight * part
            made[at] = True
            held = np.flatnonzero(made)
            if len(held) >= k and i + 1 < len(postings):
                partial = score[held]
                kth = np.partition(partial, len(held) - k)[len(held) - k]
                if coming[i + 1] < kth:  # an equal score could still win by its id
                    alive = held[partial + coming[i + 1] >= kth]
        elif len(at):
            place = np.minimum(np.searchsorted(at, alive), len(at) - 1)
            hit = at[place] == alive
            score[alive[hit]] += weight * part[place[hit]]
    if alive is None:
        alive = np.flatnonzero(made)
    return alive, score[alive]


def _scored(n_docs: int, n_terms: int, k: int):
    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        found = {"item_id": [], "item_key": [], "doc_id": [], "score": []}
        shard, asked = shard.combine_chunks(), asked.to_pandas()
        blocks, terms = shard.column("block").to_pylist(), shard.column("term").to_pylist()
        docs, counts = shard.column("docs"), shard.column("counts")
        heads = sorted((b, i) for i, (b, t) in enumerate(zip(blocks, terms, strict=True)) if not t)
        if heads:
            lengths = [np.frombuffer(counts[i].as_py(), "<i8") for _, i in heads]
            first = dict(zip((b for b, _ in heads), np.cumsum([0] + [len(x) for x in lengths]).tolist()))
            ids, lengths = np.concatenate([np.frombuffer(docs[i].as_py(), "<i8") for _, i in heads]), np.concatenate(lengths)
            missing = lengths < 0
            m = 25 + 75 * np.where(missing, -1 - lengths, lengths) * n_docs // max(n_terms, 1)
            held: dict[str, list] = {}
            for i in sorted(range(len(terms)), key=blocks.__getitem__):
                if terms[i]:
                    held.setdefault(terms[i], []).append((np.frombuffer(docs[i].as_py(), "<u4").astype(np.int64) + first[blocks[i]], np.frombuffer(counts[i].as_py(), "<u4")))
            parts = {}
            for t, x in held.items():
                at, tf = np.concatenate([a for a, _ in x]), np.concatenate([b for _, b in x]).astype(np.int64)
                parts[t] = at, 1_000_000_000 * tf // (1000 * tf + 8 * m[at])
            asked = asked[asked["term"].isin(parts.keys())].sort_values(["df", "term"])
            for (item, key), group in asked.groupby(["item_id", "item_key"], dropna=False):
                at, score = best([(*parts[t], w) for t, w in zip(group["term"], group["weight"].tolist(), strict=True)], len(m), k)
                at, score = at[score > 0], score[score > 0]
                order = np.lexsort((ids[at], missing[at], -score))[:k]
                found["item_id"] += [None if pd.isna(item) else int(item)] * len(order)
                found["item_key"] += [key] * len(order)
                found["doc_id"] += [None if gone else x for x, gone in zip(ids[at[order]].tolist(), missing[at[order]].tolist(), strict=True)]
                found["score"] += score[order].tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in found.items()})

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item of ``items(item_id, text)`` the ``k`` best documents of ``docs(doc_id, text)`` with a score above 0.

    Equal scores go by ascending ``doc_id``; documents without one are ranked too, after those with one. A null or empty text has no terms: it finds and
    counts nothing. Repeated documents are documents each; a repeated item is one, items of one ``item_id`` and different texts are ranked apart.
    A text of any length is indexed whole. Further columns are ignored; an empty table on either side gives no rows.
    """
    items = items.select(F.col("item_id").cast("long"), "text").distinct().withColumn("item_key", F.xxhash64("item_id", "text"))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = written(items.select("item_id", "item_key", F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term")).groupBy("item_id", "item_key", "term").agg(F.count("*").alias("times")))
    wanted = written(asked.select("term").union(docs.sparkSession.range(1).select(F.lit("").alias("term"))).distinct())  # small: Spark broadcasts it, or else joins by term
    postings = written(index(docs).join(wanted, "term").select("block", "term", "docs", "counts", "n_docs", "n_terms"))
    whole = postings.where("term = ''").agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n_docs, n_terms = whole["docs"] or 0, whole["terms"] or 0
    df = postings.where("term != ''").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighed = written(asked.join(df, "term").select("item_id", "item_key", "term", "df", (F.col("times") * weight).alias("weight")).where("weight > 0"))

    sizes = postings.agg(F.sum(F.octet_length("docs") + F.octet_length("counts")).alias("n")).first()["n"] or 0
    shards = max(-(-sizes // SHARD), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    passes = -(-(weighed.agg(F.sum(F.octet_length("term") + 32).alias("n")).first()["n"] or 0) // ITEMS)
    left = postings.withColumn("shard", F.expr(f"pmod(xxhash64(block), {shards})")).groupBy("shard")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    found = None
    for i in range(passes):  # a stated set of items against all shards, ITEMS bytes at a time
        mine = weighed.where(F.expr(f"pmod(item_key, {passes}) = {i}")).select(every, "item_id", "item_key", "term", "df", "weight").groupBy("shard")
        one = left.cogroup(mine).applyInArrow(_scored(n_docs, n_terms, k), "item_id long, item_key long, doc_id long, score long")
        found = one if found is None else found.union(one)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item_id long, item_key long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id", "item_key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
