"""Byte-level BPE over whole texts by tree concatenation, and its decoding.

A short text is encoded by the tokenizer at once. A long one is halved until its pieces are short; pieces are encoded in parallel, wherever
Spark puts them, and their ids then concatenated pairwise up the tree of halves. A cut can change the ids on both its sides: around each
join a window of ids is turned back into text and encoded again, and it grows until it agrees with both sides:

* The window begins and ends where a word (a match of the tokenizer's splitting pattern) begins. From the first word of the right side
  on that begins where a word of the window begins, both split alike, as the pattern never looks back; words that end well before the
  cut can't depend on what lies behind it.
* Where one unsplit run of letters, digits, signs or blanks covers the whole window, the window begins and ends at any ids. It agrees when its
  first and its last id are those that stood there: a sequence of ids is the encoding of a run exactly if each two neighbours are
  that of theirs, and every two neighbours of the result are neighbours in one of three encodings.

Words are told by the highest bit of an id, which is set where one begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milpa.llm._shared import slices, texts_of
from milpa.llm.pieces import gathered
from milpa.llm.tokenbin import encode_all, special_texts, the_tokenizer

#: bytes of a text that is encoded at once, ids on each side of a join at first, and what no word's end can depend on beyond (in bytes)
WHOLE, WINDOW, MARGIN = 32 << 10, 16, 12
BEGIN = np.uint32(1 << 31)


def _alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@cache
def _table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids end to end, and where each begins; a special text stands for itself."""
    tokenizer, byte = the_tokenizer(path), _alphabet()
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    size, special = max(vocabulary.values()) + 1, set(special_texts(path))
    names = [b""] * size
    for token, i in vocabulary.items():
        names[i] = token.encode() if token in special else bytes(byte[c] for c in token)
    return np.frombuffer(b"".join(names), np.uint8), np.cumsum([0] + [len(x) for x in names])


def bytes_of_ids(ids: np.ndarray, path: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids end to end, and where the groups of ids given by ``ends`` then end."""
    flat, cuts = _table(path)
    return gathered(flat, cuts, ids.astype(np.int64), ends)


def _text(coded: np.ndarray, path: str) -> bytes:
    return bytes_of_ids(coded & ~BEGIN, path, np.array([len(coded)]))[0].tobytes()


def encoded(text: str, path: str) -> np.ndarray:
    """The ids of a text by the tokenizer alone, marked where words begin."""
    e = the_tokenizer(path).encode(text, add_special_tokens=False)
    ids, words = np.array(e.ids, np.uint32), np.array(e.word_ids, np.int64)
    return ids | np.where(np.diff(words, prepend=-1) != 0, BEGIN, np.uint32(0))


def leaves(text: str, path: str, most: int = WHOLE) -> Iterator[str]:
    """The pieces of a text, halved until none has more than ``most`` characters; special texts are pieces of their own."""
    special = special_texts(path)
    for part in re.split(f"({'|'.join(map(re.escape, special))})", text) if special else [text]:
        stack = [part] if part else []
        while stack:
            one = stack.pop()
            if len(one) <= most or one in special:
                yield one
            else:
                stack += [one[len(one) // 2 :], one[: len(one) // 2]]


def _starts(coded: np.ndarray, path: str) -> np.ndarray:
    """Where each id's bytes begin, and where the last one's end."""
    cuts = _table(path)[1]
    ids = (coded & ~BEGIN).astype(np.int64)
    return np.concatenate([[0], np.cumsum(cuts[ids + 1] - cuts[ids])])


def _on_characters(at: int, coded: np.ndarray, path: str, step: int) -> int:
    """The next place from ``at`` on, in direction ``step``, at which the ids' bytes don't cut a character."""
    flat, cuts = _table(path)
    while 0 < at < len(coded) and flat[cuts[int(coded[at] & ~BEGIN)]] & 0xC0 == 0x80:
        at += step
    return at


def joined(left: np.ndarray, right: np.ndarray, path: str) -> np.ndarray:
    """The encoding of two texts end to end, from theirs."""
    if not len(left) or not len(right):
        return np.concatenate([left, right])
    k = WINDOW
    while True:
        # a run that covers both sides of the join: any ids will do as ends, if they agree
        if k < len(left) and k < len(right):
            a, b = _on_characters(len(left) - k, left, path, -1), _on_characters(k, right, path, 1)
            if not (left[a:] & BEGIN).any() and not (right[1:b] & BEGIN).any():
                again = encoded((_text(left[a:], path) + _text(right[:b], path)).decode(), path)
                if not (again[1:] & BEGIN).any() and again[0] & ~BEGIN == left[a] and again[-1] == right[b - 1]:
                    return np.concatenate([left[:a], again[:1] & ~BEGIN, again[1:], right[b:]])
        begins = np.flatnonzero(left[: max(0, len(left) - k) + 1] & BEGIN)
        a = int(begins[-1])
        begins = np.flatnonzero(right[k:] & BEGIN)
        b = k + int(begins[0]) if len(begins) else len(right)
        again = encoded((_text(left[a:], path) + _text(right[:b], path)).decode(), path)
        if a == 0 and b == len(right):
            return again
        there, here = _starts(again, path), _starts(right[:b], path)
        here = here + there[-1] - here[-1]
        same = np.intersect1d(there[:-1][again & BEGIN != 0], here[:-1][right[:b] & BEGIN != 0])
        same = same[same <= there[-1] - MARGIN] if b < len(right) else same
        if b == len(right) and not len(same):
            return np.concatenate([left[:a], again])
        if len(same):
            i, j = np.searchsorted(there, same[0]), np.searchsorted(here, same[0])
            return np.concatenate([left[:a], again[:i], right[j:]])
        k *= 2


def concatenated(parts: list[np.ndarray], path: str) -> np.ndarray:
    """The encodings of a text's pieces as that of the text, joined pairwise, level by level."""
    while len(parts) > 1:
        parts = [joined(*parts[i : i + 2], path) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] & ~BEGIN if parts else np.zeros(0, np.uint32)


def _short(path: str):
    def run(batches):
        for batch in slices(batches, "text"):
            flat, cuts = encode_all(texts_of(batch.column("text")), path)
            ids = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((4 * cuts).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat, "<u4"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return run


def _cut(path: str, most: int):
    def run(batches):
        for batch in slices(batches, "text"):
            for row, doc, text in zip(*(batch.column(c) for c in ("row", "doc_id", "text")), strict=True):
                for i, piece in enumerate(leaves(text.as_py(), path, most)):
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()]), pa.array([doc.as_py()], pa.int64()), pa.array([i], pa.int64()), pa.array([piece])], names=["row", "doc_id", "piece", "text"])

    return run


def _coded(path: str):
    def run(batches):
        for batch in slices(batches, "text"):
            coded = [encoded(t, path).astype("<u4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("piece"), pa.array(coded, pa.binary())], names=["row", "doc_id", "piece", "coded"])

    return run


def _tree(path: str):
    def one(doc, parts):
        ids = concatenated([np.frombuffer(x, "<u4") for x in parts], path)
        return pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([ids.astype("<u4").tobytes()], pa.binary())], names=["doc_id", "ids"])

    def run(batches):
        row, doc, parts = None, None, []
        for batch in batches:
            for r, d, x in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "coded")), strict=True):
                if r != row and parts:
                    yield one(doc, parts)
                    parts = []
                row, doc = r, d
                parts.append(x)
        if parts:
            yield one(doc, parts)

    return run


def encode(docs: DataFrame, path: str, whole: int = WHOLE) -> DataFrame:
    """``doc_id, ids`` of ``docs(doc_id, text)``: ids as little-endian unsigned 32-bit integers end to end, a row for each row.

    Equal to the tokenizer's own ids of the whole text, without added ones; a special text inside a text is its special id. Texts of more than
    ``whole`` bytes are cut and joined as said above, which the ids don't show; a task then holds one such text's ids. A null or empty
    text has no ids. Rows without ``doc_id`` and repeated rows stay. Further columns are ignored, an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    short = docs.where(F.octet_length("text") <= whole).mapInArrow(_short(path), "doc_id long, ids binary")
    long = docs.where(F.octet_length("text") > whole).withColumn("row", F.monotonically_increasing_id())
    pieces = long.mapInArrow(_cut(path, whole), "row long, doc_id long, piece long, text string").repartition("row", "piece")
    coded = pieces.mapInArrow(_coded(path), "row long, doc_id long, piece long, coded binary").repartition("row").sortWithinPartitions("row", "piece")
    return short.union(coded.mapInArrow(_tree(path), "doc_id long, ids binary"))


def _decoded(path: str):
    def run(batches):
        for batch in slices(batches, "ids"):
            column = batch.column("ids").fill_null(b"")
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            ids = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].tobytes()
            data, ends = bytes_of_ids(np.frombuffer(ids, "<u4"), path, (offsets - offsets[0]) // 4)
            texts = pa.Array.from_buffers(pa.string(), len(column), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            try:
                texts.validate(full=True)
            except pa.ArrowInvalid:  # ids that were not made from a text
                texts = pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())
            out = {c: batch.column(c) for c in batch.schema.names} | {"text": texts}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` of ``ids`` as :func:`encode` gives them, with their ``text``, special ids included; bytes that are no UTF-8 become U+FFFD, and a
    ``text`` that was there is replaced. Null ids give the empty text."""
    rest = coded.drop("text")
    return rest.mapInArrow(_decoded(path), rest.withColumn("text", F.lit("")).schema)
