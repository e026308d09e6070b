"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared in lower case with white space squeezed. An item of ``m`` characters may occur with up to
``k = floor(rate * m)`` edits. It is split into ``k + 1`` pieces: an occurrence with at most ``k`` edits leaves one piece whole. All
pieces of a block of items are searched at once (Aho-Corasick); around each hit the stretch in which the item could lie is checked by
Myers' bit-parallel edit distance, so nothing is missed and nothing is guessed.

Items are taken in blocks of bounded size, one pass over the documents for each, so what goes to the executors has a bound whatever the
size of the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milpa.llm._shared import slices

BLOCK_CHARS = 4 << 20
HITS = "doc_id long, item_id long, distance int, start long, stop long"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces_of(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length, with their places."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of ``text``, and where the first such substring ends."""
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | down
        h = ((eq & up) + up ^ up) | eq
        plus, minus = down | ~(h | up) & full, up & h
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(x | plus) & full, plus & x
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, int(rate * len(t))) for i, t in items]
        self.masks: dict[int, dict[str, int]] = {}
        self.search = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, errors) in enumerate(self.items):
            for at, piece in pieces_of(text, errors):
                places.setdefault(piece, []).append((n, at))
        for piece, where in places.items():
            self.search.add_word(piece, (len(piece), where))
        if places:
            self.search.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """Per item that occurs: item id, least distance, begin of the stretch searched and end of the match."""
        if not len(self.search):
            return
        starts: dict[int, set[int]] = {}
        for end, (length, where) in self.search.iter(text):
            for n, at in where:
                starts.setdefault(n, set()).add(end + 1 - length - at)
        for n, found in starts.items():
            item, pattern, errors = self.items[n]
            if n not in self.masks:
                masks: dict[str, int] = {}
                for i, c in enumerate(pattern):
                    masks[c] = masks.get(c, 0) | 1 << i
                self.masks[n] = masks
            best, window = None, []
            for start in sorted(found):
                a, b = max(0, start - errors), min(len(text), start + len(pattern) + errors)
                if window and a <= window[-1][1]:
                    window[-1][1] = b
                else:
                    window.append([a, b])
            for a, b in window:
                distance, end = myers(self.masks[n], len(pattern), text[a:b])
                if distance <= errors and (best is None or distance < best[1]):
                    best = (item, distance, a, a + end)
            if best:
                yield best


def blocks_of(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Items in their normal form, in blocks of at most ``most`` characters (one longer item is a block); empty items never match."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").distinct().toLocalIterator():
        text = normal(row["text"])
        if text:
            if block and size + len(text) > most:
                yield block
                block, size = [], 0
            block.append((row["item_id"], text))
            size += len(text)
    if block:
        yield block


def _searcher(items: list[tuple[int, str]], rate: float):
    def run(batches):
        matcher = Matcher(items, rate)
        for batch in slices(batches, "text"):
            hits = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for hit in matcher.find(normal(t))]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "distance", "start", "stop"), h, strict=True)) for h in hits], pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))

    return run


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, distance, start, stop``: every document and test item that occurs in it with up to ``rate`` edits a character.

    ``start`` and ``stop`` bound the match in the normal form of the text. Null and empty texts and items match nothing; repeated rows
    and items give one row per pair, that of least distance. Rows without ids are left out; further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    found = [docs.mapInArrow(_searcher(items, rate), HITS) for items in blocks_of(benchmark, block_chars)]
    hits = reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], HITS)
    return hits.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "start", "stop")).alias("h")).select("doc_id", "item_id", "h.*")


def _keeper(items: list[tuple[int, str]], rate: float):
    def run(batches):
        matcher = Matcher(items, rate)
        for batch in slices(batches, "text"):
            clean = [not t or next(matcher.find(normal(t)), None) is None for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def without_items(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no test item occurs; decided where they are, without a shuffle."""
    schema = docs.schema
    for items in blocks_of(benchmark, block_chars):
        docs = docs.mapInArrow(_keeper(items, rate), schema)
    return docs
