"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Pieces and scores come from a SentencePiece model file (nothing is trained here); a file of merge ranks gives an order of its pieces, from which
Zipf's law makes log-probabilities. Spaces become the marker U+2581 and a text begins
with one. A text falls apart into units, a run of markers and the word after it: no piece holds a marker after another character, so the
best path of a text is that of its units one after another, and each distinct unit of a batch is segmented once. A character that no
piece covers costs ten less than the worst score and becomes its bytes. A U+2581 that a text itself holds is written as bytes, so decoding
gives back every text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milpa.llm._shared import slices, texts_of

MARK, UNKNOWN_COST = "▁", 10.0
KEPT_UNITS = 400_000
#: Mandelbrot's shift in Zipf's law
ZIPF_SHIFT = 2.7
_UNITS = re.compile(r" +[^ ]*|[^ ]+")


class DoubleArray:
    """A trie in two arrays: the child of node ``s`` by byte ``c`` is ``base[s] + c + 1``, if ``check`` there says ``s``."""

    def __init__(self, words: dict[bytes, int]):
        keys = sorted(words)
        size = 1 << 16
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        free = 1
        todo = [(0, 0, len(keys), 0)]
        while todo:
            node, lo, hi, depth = todo.pop()
            if lo < hi and len(keys[lo]) == depth:
                self.value[node] = words[keys[lo]]
                lo += 1
            if lo == hi:
                continue
            groups, a = [], lo
            while a < hi:
                c, b = keys[a][depth], a + 1
                while b < hi and keys[b][depth] == c:
                    b += 1
                groups.append((c, a, b))
                a = b
            while self.check[free] >= 0:
                free += 1
                self._reach(free + 300)
            place, tried = max(free - groups[0][0] - 1, 0), 0
            while True:
                self._reach(place + 300)
                if all(self.check[place + c + 1] < 0 for c, _, _ in groups):
                    break
                place, tried = place + 1, tried + 1
            if tried > 50:  # what is left below is too scattered to be tried again and again
                free = max(free, place)
            self.base[node] = place
            for c, a, b in groups:
                self.check[place + c + 1] = node
                todo.append((place + c + 1, a, b, depth + 1))

    def _reach(self, n: int) -> None:
        while len(self.check) <= n:
            for x, fill in ((self.base, 0), (self.check, -1), (self.value, -1)):
                x.extend([fill] * len(x))


def log_scores(pieces: list[tuple[str, float, str]], shift: float = ZIPF_SHIFT) -> list[tuple[str, float, str]]:
    """Pieces whose scores are merge ranks (whole numbers all, none above 0) with log-probabilities by their order instead: the ``r``-th best of ``n``
    has ``1 / (r + shift)`` over the sum of these, pieces of equal score in order of id. Scores that aren't ranks are log-probabilities already and stay.
    """
    normal = [i for i, (_, _, kind) in enumerate(pieces) if kind == "normal"]
    if not normal or any(pieces[i][1] > 0 or pieces[i][1] != int(pieces[i][1]) for i in normal):
        return pieces
    odds = 1 / (np.arange(1, len(normal) + 1) + shift)
    by_rank = sorted(normal, key=lambda i: (-pieces[i][1], i))
    new = dict(zip(by_rank, np.log(odds / odds.sum()).tolist(), strict=True))
    return [(p, new.get(i, s), kind) for i, (p, s, kind) in enumerate(pieces)]


class Unigram:
    """Pieces with log scores: segmentation of units, and the bytes of every id."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        """``pieces``: by id the piece, its score, and its kind: ``normal``, ``byte`` or ``other``."""
        self.score = [s for _, s, _ in pieces]
        normal = {p.encode(): i for i, (p, _, k) in enumerate(pieces) if k == "normal" and p}
        if any(MARK in p.lstrip(MARK) for p, _, k in pieces if k == "normal"):
            raise ValueError("a piece holds the space marker after another character")
        self.trie = DoubleArray(normal)
        self.of_byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == "byte"}
        self.unknown = min([s for s, (_, _, k) in zip(self.score, pieces, strict=True) if k == "normal"] or [0.0]) - UNKNOWN_COST
        if len(self.of_byte) != 256:
            raise ValueError("the model has no byte fallback")
        self.output = [p.replace(MARK, " ").encode() if k == "normal" else bytes([int(p[3:5], 16)]) if k == "byte" else b"" for p, _, k in pieces]
        self.known: dict[str, bytes] = {}  # two generations, so that frequent units are kept when the younger is full
        self.older: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Unigram:
        """The pieces of a model file. No unigram model is among the public files: theirs have merge ranks, see :func:`log_scores`."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
        return cls(log_scores([(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]))

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation of a text without literal markers; of equal paths the one found first, from left to right."""
        data = text.encode()
        n, base, check, value, score = len(data), self.trie.base, self.trie.check, self.trie.value, self.score
        best, back, ident = [None] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            so_far = best[at]
            width = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            node, single = 0, False
            for j in range(at, n):
                step = base[node] + data[j] + 1
                if check[step] != node:
                    break
                node = step
                if value[node] >= 0:
                    total = so_far + score[value[node]]
                    if best[j + 1] is None or total > best[j + 1]:
                        best[j + 1], back[j + 1], ident[j + 1] = total, at, value[node]
                    single |= j + 1 == at + width
            if not single and (best[at + width] is None or so_far + self.unknown > best[at + width]):
                best[at + width], back[at + width], ident[at + width] = so_far + self.unknown, at, -1
            at += width
        out: list[int] = []
        while n:
            out.extend([ident[n]] if ident[n] >= 0 else [self.of_byte[b] for b in reversed(data[back[n] : n])])
            n = back[n]
        return out[::-1]

    def unit(self, unit: str) -> bytes:
        """Ids (32-bit) of a unit whose spaces are still spaces; literal markers become bytes."""
        ids = self.known.get(unit)
        if ids is not None:
            return ids
        ids = self.older.get(unit)
        if ids is None:
            parts = unit.split(MARK)
            out = self.viterbi(parts[0].replace(" ", MARK))
            for part in parts[1:]:
                out += [self.of_byte[b] for b in MARK.encode()] + self.viterbi(part.replace(" ", MARK))
            ids = np.array(out, np.int32).tobytes()
        if len(self.known) >= KEPT_UNITS:
            self.known, self.older = {}, self.known
        self.known[unit] = ids
        return ids

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and offsets by text."""
        words = pc.split_pattern(texts, " ")
        flat, ends = words.flatten(), words.offsets.to_numpy().astype(np.int64)
        plain = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        if plain.all():  # single spaces between words: every word with one space before it is a unit
            coded, prefix = flat.dictionary_encode(), " "
        else:
            units = [_UNITS.findall(" " + t) if t else [] for t in texts.to_pylist()]
            ends = np.cumsum([0] + [len(x) for x in units])
            coded, prefix = pa.array([u for x in units for u in x], pa.large_string()).dictionary_encode(), ""
        ids = [self.unit(prefix + u) for u in coded.dictionary.to_pylist()]
        return gathered(np.frombuffer(b"".join(ids), np.int32), np.cumsum([0] + [len(x) // 4 for x in ids]), coded.indices.to_numpy().astype(np.int64), ends)

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        if not hasattr(self, "flat"):
            self.flat, self.cuts = np.frombuffer(b"".join(self.output), np.uint8), np.cumsum([0] + [len(x) for x in self.output])
        data, cuts = gathered(self.flat, self.cuts, ids.astype(np.int64), ends)
        data = data.tobytes()
        return [data[a + 1 : b].decode("utf-8", "replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def gathered(flat: np.ndarray, cuts: np.ndarray, picks: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``flat[cuts[i]:cuts[i + 1]]`` of all picks end to end, and where the groups given by ``ends`` then end."""
    sizes = (cuts[1:] - cuts[:-1])[picks]
    stops = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(cuts[:-1][picks] - stops[:-1], sizes) + np.arange(stops[-1])], stops[ends]


def _encode(model: Unigram):
    def run(batches):
        for batch in slices(batches, "text"):
            ids, ends = model.encode_all(texts_of(batch.column("text")))
            out = {x: batch.column(x) for x in batch.schema.names}
            out["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def _decode(model: Unigram):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                ids = pc.fill_null(part.column("ids"), [])
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
                out = {x: part.column(x) for x in part.schema.names}
                out["decoded"] = pa.array(model.decode_all(ids.flatten().to_numpy(), ends), pa.string())
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def encode(docs: DataFrame, model: Unigram) -> DataFrame:
    """``docs`` with a column ``ids``, in place of any of that name; null and empty texts have no ids. Repeated rows are encoded each, an empty table
    gives an empty table; of segmentations with equal score the one found first from left to right is taken. A very long text is worked whole in one task.
    """
    docs = docs.drop("ids")
    return docs.mapInArrow(_encode(model), f"{_ddl(docs)}, ids array<int>")


def decode(encoded: DataFrame, model: Unigram) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``, in place of any column of that name; no ids or null give an empty text, ids of control pieces give nothing."""
    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(_decode(model), f"{_ddl(encoded)}, decoded string")


def _coded(model: Unigram):
    def run(batches):
        for batch in slices(batches, "text", 2 << 20):
            texts = texts_of(batch.column("text"))
            ids, ends = model.encode_all(texts)
            same = [a == b for a, b in zip(model.decode_all(ids, ends), texts.to_pylist(), strict=True)]
            names = [*batch.schema.names, "ids", "round_trip"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), pa.array(same, pa.bool_())], names=names)

    return run


def coded(docs: DataFrame, model: Unigram) -> DataFrame:
    """``docs`` with ``ids`` and ``round_trip``, in place of any columns of these names, the latter true where decoding the ids gives the text (null: empty);
    both steps in one pass. For all else see :func:`encode`.
    """
    docs = docs.drop("ids", "round_trip")
    return docs.mapInArrow(_coded(model), f"{_ddl(docs)}, ids array<int>, round_trip boolean")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def round_trip(docs: DataFrame, model: Unigram) -> DataFrame:
    """Per document: ``doc_id, n_pieces, n_byte_pieces, ids_hash, round_trip``, the last true where decoding gives the text.

    One row for every row, also repeated ones and those without a ``doc_id``; further columns are ignored. For all else see :func:`encode`.
    """
    both = coded(docs.select(F.col("doc_id").cast("long"), "text"), model)
    low, high = min(model.of_byte.values()), max(model.of_byte.values())
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.size(F.filter("ids", lambda x: x.between(low, high))).cast("long").alias("n_byte_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        "round_trip",
    )
