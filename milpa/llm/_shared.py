"""Helpers that several operators of this subpackage use: reliable checkpoints, batch sizes, words, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names. Where it is unset, one is made in local mode only, as in tests; a cluster must name it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = context.getCheckpointDir()
    return folder


def reliable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that it outlives a lost executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: like :func:`reliable`, but compressed, for many small rows, and small parts are read several in a task."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (murmur3's), element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U64(33))


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array of strings with 64-bit offsets from 0 on, null as the empty text.

    Arrow's ``ascii_lower`` loses bytes of a slice whose first offset isn't 0, so the offsets are rebased here.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return pa.array([], pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = (column.buffers()[2] or pa.py_buffer(b"")).slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets - offsets[0]), data)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and the n + 1 places where texts begin and end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts with A-Z lower-cased: codes of all words, the distinct words, offsets by text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, ends = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, ends


def hashes_of(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.large_binary()).to_pylist()), U64, len(words))


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` holds about ``most`` bytes in each; one longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        pa.default_memory_pool().release_unused()
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = size[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(size, before + most, "right")))
            yield batch.slice(first, last - first)
            first = last


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the links that one partition holds; each node with its smallest known relative comes back."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    yield pd.DataFrame({"a": [root(x) for x in nodes], "b": nodes}, dtype="int64")


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)``: ``(node, component)``, the component being its smallest node.

    Union-find first contracts the links inside each partition, then alternate large-star and small-star rounds make every component
    a star around its smallest node. A round is two aggregations with map-side combine and two joins; its stars are written as a table, so
    that the few that are left are read in few tasks. Nothing but whether there are more to join comes to the driver. An empty table
    gives an empty table.
    """
    stars = written(links.selectExpr("least(a, b) as a", "greatest(a, b) as b").where("a < b").mapInPandas(_forest, "a long, b long").distinct())
    while True:  # settled: every node that isn't a centre has one centre, and no centre has any
        ends = stars.selectExpr("inline(array(named_struct('node', b, 'under', 1), named_struct('node', a, 'under', 0)))")
        if ends.groupBy("node").agg(F.sum("under").alias("centres"), F.min("under").alias("least")).where("centres > 1 or (centres = 1 and least = 0)").isEmpty():
            break
        both = stars.selectExpr("inline(array(named_struct('a', a, 'b', b), named_struct('a', b, 'b', a)))")
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a and b > m").selectExpr("m as a", "b").distinct()
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        again = large.join(small, "b")
        kept = again.selectExpr("inline(array(named_struct('a', m, 'b', a), named_struct('a', m, 'b', b)))")
        stars = written(kept.where("a != b").distinct())
    return stars.groupBy("b").agg(F.min("a").alias("component")).selectExpr("b as node", "component").union(stars.selectExpr("a as node", "a as component").distinct())
