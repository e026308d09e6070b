"""Repeated substrings: every byte covered by a string of ``length`` bytes that also starts anywhere else, by blockwise suffix sorting.

Sorting every suffix of a large corpus isn't needed to find these strings, so the work is cut down first, without losing any:

1. Every window of ``length`` bytes names an anchor: the position in it whose gram of a third of ``length`` hashes lowest (leftmost of equals). The
   choice depends on the window's bytes alone, so equal windows have equal anchors at equal distance. Consecutive windows with one
   anchor form a *context*. A window can only repeat if its anchor's hash does.
2. Anchors and contexts are counted. A context that occurs twice or more, bytes and alignment equal, is repeated as a whole; copies
   of documents and most of near copies end here, in counts with map-side combine, however large their groups are.
3. What is left are contexts that share an anchor but not all bytes, as at both ends of a repeated passage. Their suffixes are sorted
   blockwise with a difference cover (Kärkkäinen, 2007): ranks of the suffixes at cover positions are computed first by prefix
   doubling; then one bucket of suffixes at a time is sorted by its first ``COVER`` bytes, and longer ties are settled by comparing
   the cover ranks at the shift at which both suffixes meet the cover. Equal windows end up side by side.

Only one bucket's order is held at a time; contexts come to a task sorted by anchor and are worked off in groups of anchors.

Most repeats are found by counting (2), the rest by suffix order (3). Two contexts count as equal if their anchors' 64-bit hashes and an
xxh3 hash of all their bytes and their alignment agree; the suffix order compares bytes.

An anchor with more than ``HOT_KINDS`` different contexts, as at the ends of a passage that very many documents share, is not sorted in
one task: its windows are counted one by one, by anchor and xxh3 of their bytes, with map-side combine. The result is the same.

Passages are found in the same passes: the windows are then ``words`` words, white space aside, and contexts that share an anchor
but not all words are compared window by window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from milpa.llm._shared import U64, bytes_of, hashes_of, mix, slices, texts_of, written

COVER, BUFFER, BUCKET, GROUP_BYTES, SPANS, PASSAGES = 64, 1 << 20, 1 << 16, 2 << 20, "_repeated_spans", "_passage_bytes"
HOT_KINDS = 2000
#: An anchor is found by so many hundredths of a window: fewer make fewer contexts, but more of them that share an anchor and not all bytes.
GRAM, WORD_GRAM = 32, 20
_tables: dict[str, np.ndarray] = {}


def _powers() -> dict[str, np.ndarray]:
    if not _tables:
        base = 0x9E3779B97F4A7C15 | 1
        with np.errstate(over="ignore"):
            for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
                x = np.full(BUFFER + 1, b, U64)
                x[0] = 1
                _tables[name] = np.multiply.accumulate(x)
            _tables["byte"] = mix(np.arange(1, 257, dtype=U64))
    return _tables


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from running minima of blocks seen from both ends."""
    n = len(x) - width + 1
    blocks = np.full((-(-len(x) // width) * width), np.iinfo(x.dtype).max, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts(values: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Contexts of up to ``BUFFER`` units (bytes or words, by their hashes) of the texts between ``ends``: text, first and last window, place and hash of the anchor."""
    n = len(values)
    if n < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U64),)
    t = _powers()
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U64)
        np.cumsum(values * t["up"][:n], out=sums[1:])
        grams = mix((sums[gram:] - sums[:-gram]) * t["down"][: n - gram + 1])
    place = np.arange(len(grams), dtype=U64)
    anchor = (sliding_least((grams & ~U64(BUFFER - 1)) | place, length - gram + 1) & U64(BUFFER - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: n - length + 1]
    whole = np.arange(n - length + 1) + length <= ends[text + 1]
    begins = whole.copy()
    begins[1:] &= ~(whole[:-1] & (anchor[1:] == anchor[:-1]))
    stops = whole.copy()
    stops[:-1] &= ~(whole[1:] & (anchor[1:] == anchor[:-1]))
    first, last = np.flatnonzero(begins), np.flatnonzero(stops)
    return text[first], first, last, anchor[first], grams[anchor[first]]


def _content(raw: bytes, starts: np.ndarray, stops: np.ndarray, off: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A hash of each context's bytes and of where its windows and its anchor lie in them."""
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), U64, len(starts))
    return mix(hashed ^ mix((windows << 24 | off).astype(U64) + U64(1)))


def word_places(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts begin and stop, in bytes."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    return np.flatnonzero(inside & (edge | ~np.roll(inside, 1))), np.flatnonzero(inside[:-1] & (edge[1:] | ~inside[1:])) + 1


def _word_hashes(raw: bytes, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    words = pa.array([raw[a:b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)], pa.binary()).dictionary_encode()
    return hashes_of(words.dictionary)[words.indices.to_numpy()] if len(first) else np.zeros(0, U64)


def _stretches(n: int, ends: np.ndarray, length: int) -> list[tuple[int, int, np.ndarray]]:
    """Begin, end and inner ends; texts longer than the buffer fall into stretches that share ``length - 1`` units, so that each window is in one."""
    if n <= BUFFER:
        return [(0, n, ends)]
    return [(a, min(n, a + BUFFER), np.array([0, min(n, a + BUFFER) - a])) for a in range(0, max(1, n - length + 1), BUFFER - length + 1)]


def _find_contexts(length: int, passage: int | None):
    names = ["doc_id", "text_key", "lo", "hi", "off", "anchor", "content", "passage"]

    def rows(batch, text, lo, hi, off, anchor, content, passage):
        own = pa.array(text)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(own),
                batch.column("text_key").take(own),
                pa.array(lo, pa.int64()),
                pa.array(hi, pa.int64()),
                pa.array(off, pa.int32()),
                pa.array(anchor.view(np.int64)),
                pa.array(content.view(np.int64)),
                pa.array(np.full(len(text), passage)),
            ],
            names=names,
        )

    def run(batches):
        for batch in slices(batches, "text", BUFFER // 2):  # a longer text is a batch of its own
            data, ends = bytes_of(texts_of(batch.column("text")))
            raw, values = data.tobytes(), _powers()["byte"]
            for base, stop, cuts in _stretches(len(data), ends, length):
                text, first, last, at, anchor = contexts(values[data[base:stop]], cuts, length, length * GRAM // 100)
                content = _content(raw, first + base, last + base + length, at - first, last - first)
                start = base - (cuts[text] if len(text) else 0)
                yield rows(batch, text, first + start, last + start, at - first, anchor, content, False)
            if passage:
                begin, close = word_places(data, ends)
                hashed, word_ends = _word_hashes(raw, begin, close), np.searchsorted(begin, ends)
                for base, stop, cuts in _stretches(len(begin), word_ends, passage):
                    text, first, last, at, anchor = contexts(hashed[base:stop], cuts, passage, max(1, passage * WORD_GRAM // 100))
                    if not len(text):
                        continue
                    # equal words are equal bytes here but for white space, which is left out of the hash
                    sums = np.zeros(stop - base + 1, U64)
                    with np.errstate(over="ignore"):
                        np.cumsum(mix(hashed[base:stop]) * _powers()["up"][: stop - base], out=sums[1:])
                        content = mix((sums[last + passage] - sums[first]) * _powers()["down"][first] + mix(((last - first) << 24 | (at - first)).astype(U64)))
                    yield rows(batch, text, begin[first + base] - ends[text], close[last + base + passage - 1] - ends[text], at - first, mix(anchor + U64(1)), content, True)

    return run


class CoverRanks:
    """Ranks of the suffixes that start at positions of a difference cover modulo ``period``, told apart to ``depth`` bytes at least.

    The cover is ``0 .. r-1`` and the multiples of ``r``, ``r`` being the root of the period; any two positions have a shift below the
    period that takes both into it. Doubling steps stay in the cover, as they are multiples of the period.
    """

    def __init__(self, data: np.ndarray, depth: int, period: int = COVER):
        self.period, root = period, int(np.ceil(np.sqrt(period)))
        held = np.zeros(period, bool)
        held[:root] = held[::root] = True
        cover = np.flatnonzero(held)
        self.index = np.cumsum(held) - 1
        residue = np.arange(period)
        meet = held[(residue[:, None, None] + residue) % period] & held[(residue[None, :, None] + residue) % period]
        self.shift = meet.argmax(2)
        blocks = len(data) // period + 2
        self.padded = np.concatenate([data, np.zeros((depth // period + 4) * period + 8, np.uint8)])
        places = (np.arange(blocks)[:, None] * period + cover).ravel()
        keys = [self.word(places + 8 * j) for j in range(period // 8)]
        self.rank, reached = self._ranked(keys), period
        while reached < depth:
            step = reached // period * len(cover)
            later = np.concatenate([self.rank[step:] + 1, np.zeros(min(step, len(self.rank)), np.int64)])
            self.rank, reached = self._ranked([self.rank, later]), 2 * reached
        self.size = len(cover)

    def word(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes from each position on, as a number in their order."""
        return np.lib.stride_tricks.sliding_window_view(self.padded, 8)[at].view(">u8").ravel().astype(U64)

    @staticmethod
    def _ranked(keys: list[np.ndarray]) -> np.ndarray:
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new)
        return out

    def of(self, at: np.ndarray) -> np.ndarray:
        return self.rank[at // self.period * self.size + self.index[at % self.period]]

    def compared(self, at: np.ndarray, pivot: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for suffixes that agree with their pivots in their first ``period`` bytes."""
        shift = self.shift[at % self.period, pivot % self.period]
        return np.sign(self.of(at + shift) - self.of(pivot + shift))


def sorted_bucket(ranks: CoverRanks, at: np.ndarray) -> np.ndarray:
    """The suffixes of one bucket in order: by their first bytes, then three-way quicksort of all ties at once by cover ranks."""
    keys = [ranks.word(at + 8 * j) for j in range(ranks.period // 8)]
    order = np.lexsort(keys[::-1])
    tie = np.zeros(len(at), bool)
    tie[1:] = True
    for key in keys:
        tie[1:] &= key[order][1:] == key[order][:-1]
    out, group = at[order], np.cumsum(~tie)
    slots = np.arange(len(at))
    while True:
        _, first, inverse, count = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
        open_ = count[inverse] > 1
        if not open_.any():
            return out
        slots, group = slots[open_], group[open_]
        _, first, inverse, count = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
        members = out[slots]
        side = ranks.compared(members, members[first + count // 2][inverse])
        parted = np.argsort(inverse * 3 + side + 1, kind="stable")
        out[slots] = members[parted]
        side, inverse = side[parted], inverse[parted]
        group, live = inverse * 3 + side + 1, side != 0
        slots, group = slots[live], group[live]


def repeated_windows(data: np.ndarray, at: np.ndarray, length: int, bucket: int = BUCKET) -> np.ndarray:
    """Which windows ``data[at : at + length]`` occur at another of the given positions."""
    ranks = CoverRanks(data, length)
    lead = ranks.word(at)
    order = np.argsort(lead, kind="stable")
    lead = lead[order]
    new = np.concatenate([[0], np.flatnonzero(lead[1:] != lead[:-1]) + 1, [len(at)]])
    out = np.zeros(len(at), bool)
    a = 0
    while a < len(at):
        b = int(new[min(np.searchsorted(new, a + bucket), len(new) - 1)])
        own = order[a:b]
        place = np.argsort(at[own], kind="stable")
        by_position = at[own][place]
        ordered = sorted_bucket(ranks, at[own])
        equal = np.arange(1, len(ordered))
        for j in [*range(0, length - 8, 8), length - 8]:
            equal = equal[ranks.word(ordered[equal] + j) == ranks.word(ordered[equal - 1] + j)]
        same = np.zeros(len(ordered), bool)
        same[equal] = same[equal - 1] = True
        out[own[place[np.searchsorted(by_position, ordered[same])]]] = True
        a = b
    return out


def _runs(row: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of runs of neighbouring windows of one row."""
    breaks = np.flatnonzero((row[1:] != row[:-1]) | (local[1:] != local[:-1] + 1))
    return np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(row) - 1]])


def _repeated_bytes(rows: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of stretches of bytes in windows that occur again."""
    data, ends = bytes_of(pc.fill_null(rows["content_bytes"].combine_chunks().cast(pa.large_binary()), b""))
    windows = np.diff(ends) - length + 1
    row = np.repeat(np.arange(len(windows)), windows)
    local = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    hit = repeated_windows(data, ends[:-1][row] + local, length)
    row, local = row[hit], local[hit]
    if not len(row):
        return row, local, local
    first, last = _runs(row, local)
    return row[first], local[first], local[last] + length


def _repeated_words(rows: pa.Table, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for windows of words."""
    data, ends = bytes_of(pc.fill_null(rows["content_bytes"].combine_chunks().cast(pa.large_binary()), b""))
    begin, close = word_places(data, ends)
    hashed, t, found = _word_hashes(data.tobytes(), begin, close), _powers(), []
    owner = np.searchsorted(ends, begin, "right") - 1
    for a in range(0, max(1, len(begin) - words + 1), BUFFER - words + 1):
        part = hashed[a : a + BUFFER]
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, U64)
            np.cumsum(part * t["up"][: len(part)], out=sums[1:])
            found.append(mix((sums[words:] - sums[:-words]) * t["down"][: max(0, len(part) - words + 1)]))
    value = np.concatenate(found)
    at = np.flatnonzero(owner[: len(value)] == owner[words - 1 : words - 1 + len(value)])
    _, inverse, times = np.unique(value[at], return_inverse=True, return_counts=True)
    at = at[times[inverse] > 1]
    if not len(at):
        return at, at, at
    first, last = _runs(owner[at], at)
    base = ends[owner[at[first]]]
    return owner[at[first]], begin[at[first]] - base, close[at[last] + words - 1] - base


def _resolve(length: int, passage: int | None):
    def work(table: pa.Table):
        for words in (False, True) if passage else (False,):
            rows = table.filter(pc.equal(table["passage"], words))
            if not rows.num_rows:
                continue
            row, start, stop = _repeated_words(rows, passage) if words else _repeated_bytes(rows, length)
            keep = rows["single"].combine_chunks().to_numpy(zero_copy_only=False)[row]  # those counted as a whole stand for all of them
            row, start, stop = row[keep], start[keep], stop[keep]
            lo = rows["lo"].to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                [rows[c].combine_chunks().take(pa.array(row)) for c in ("doc_id", "text_key")] + [pa.array(lo + start), pa.array(lo + stop), pa.array(np.full(len(row), words))],
                names=["doc_id", "text_key", "lo", "stop", "passage"],
            )

    def run(batches):
        waiting, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("anchor").to_numpy()
            waiting.append(batch)
            size += batch.nbytes
            cut = int(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))[-1])  # the last anchor may go on
            if size > GROUP_BYTES and (cut or waiting[0].column("anchor")[0].as_py() != own[0]):
                waiting[-1] = batch.slice(0, cut)
                yield from work(pa.Table.from_batches(waiting))
                waiting, size = [batch.slice(cut)], batch.nbytes * (batch.num_rows - cut) // batch.num_rows
        if waiting:
            yield from work(pa.Table.from_batches(waiting))

    return run


def _each_window(length: int, passage: int | None):
    """Every window of the contexts with the hash of its bytes, or of its words' hashes."""

    def run(batches):
        for batch in slices(batches, "content_bytes", 1 << 18):
            row, start, stop, window = [], [], [], []
            for i, (raw, words) in enumerate(zip(batch.column("content_bytes").to_pylist(), batch.column("passage").to_pylist(), strict=True)):
                if words:
                    begin, close = word_places(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    units, width, step = _word_hashes(raw, begin, close).tobytes(), 8 * passage, 8
                    n = max(0, len(begin) - passage + 1)
                    begin, close = begin[:n], close[len(close) - n :]
                else:
                    units, width, step, n = raw, length, 1, max(0, len(raw) - length + 1)
                    begin = np.arange(n)
                    close = begin + length
                window += [xxhash.xxh3_64_intdigest(units[a : a + width]) for a in range(0, n * step, step)]
                row.append(np.full(n, i))
                start.append(begin)
                stop.append(close)
            own = pa.array(np.concatenate(row))
            lo = batch.column("lo").to_numpy()[np.concatenate(row)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(own) for c in ("doc_id", "text_key", "anchor", "passage", "single")]
                + [pa.array(lo + np.concatenate(start), pa.int64()), pa.array(lo + np.concatenate(stop), pa.int64()), pa.array(np.array(window, U64).view(np.int64))],
                names=["doc_id", "text_key", "anchor", "passage", "single", "lo", "stop", "window"],
            )

    return run


def _merged(batches):
    """Maximal runs of each document's covered stretches, and how many bytes its passages cover."""

    def runs(row, lo, stop):
        order = np.lexsort((lo, row))
        row, lo, stop = row[order], lo[order], stop[order]
        wide = int(stop.max(initial=0)) + 1  # every row has a range of its own
        reached = np.maximum.accumulate(row * wide + stop)
        first = np.flatnonzero(np.concatenate([[True], (row * wide + lo)[1:] > reached[:-1]])[: len(row)])
        last = np.append(first[1:], len(row))[: len(first)] - 1
        return row[first], lo[first], reached[last] - row[last] * wide

    for batch in batches:
        found = batch.column("found")
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(found).to_numpy(zero_copy_only=False))
        lo, stop, passage = (pc.struct_field(found.flatten(), c).to_numpy(zero_copy_only=False) for c in ("lo", "stop", "passage"))
        passage = passage.astype(bool)
        own, first, last = runs(row[~passage], lo[~passage], stop[~passage])
        ends = pa.array(np.searchsorted(own, np.arange(batch.num_rows + 1)), pa.int32())
        spans = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["lo", "stop"]))
        own, first, last = runs(row[passage], lo[passage], stop[passage])
        covered = np.bincount(own, last - first, batch.num_rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), spans, pa.array(covered)], names=["doc_id", "text_key", "spans", "passage_bytes"])


def _short_windows(words: int, length: int):
    """Windows of ``words`` words that have fewer than ``length`` bytes, from the first byte of the first word to the last of the last."""

    def run(batches):
        for batch in slices(batches, "text", BUFFER // 2):
            data, ends = bytes_of(texts_of(batch.column("text")))
            first, stop = word_places(data, ends)
            n = max(0, len(first) - words + 1)
            text = np.searchsorted(ends, first, "right") - 1
            found = np.flatnonzero((text[:n] == text[len(first) - n :]) & (stop[len(first) - n :] - first[:n] < length))
            lo, hi, text, raw = first[found], stop[found + words - 1], text[found], data.tobytes()
            hashes = b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(lo.tolist(), hi.tolist(), strict=True))
            base = ends[text]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(text)), batch.column("text_key").take(pa.array(text)), pa.array(lo - base, pa.int64()), pa.array(hi - base, pa.int64()), pa.array(np.frombuffer(hashes, np.int64))],
                names=["doc_id", "text_key", "lo", "stop", "window"],
            )

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """Adds a hash of the text, which tells apart rows that share a ``doc_id`` but not the text."""
    return docs.withColumn("text_key", F.xxhash64("text"))


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    """Rows of one ``doc_id`` and text; null-safe, so that every join of the texts asks for the same exchange and one is reused."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def repeated_spans(docs: DataFrame, length: int = 400, words: int | None = None, passage: int | None = None) -> DataFrame:
    """``doc_id, text_key, spans, passage_bytes``: the maximal runs of bytes that repeated strings of ``length`` bytes cover; documents without any are left out.

    With ``words``, repeated strings of that many words between white space that are shorter than ``length`` bytes are spans too. With
    ``passage``, ``passage_bytes`` counts the bytes of passages of that many words, white space aside, that occur again anywhere.

    Takes ``docs(doc_id, text, text_key)`` from :func:`keyed`. Strings that overlap or lie in the same document count; a row that
    repeats makes all its windows repeated. Null, empty and shorter texts have no spans. ``length`` is an even number of 64 or more. A
    text longer than 1 MB is worked in stretches that overlap, so that its windows are the same as in one piece.
    """
    if length < COVER or length % 2:
        raise ValueError(f"length must be even and at least {COVER}")
    docs = docs.select(F.col("doc_id").cast("long"), "text", "text_key")
    least = min(length, 2 * passage - 1) if passage else length
    found = docs.where(F.octet_length("text") >= least).mapInArrow(_find_contexts(length, passage), "doc_id long, text_key long, lo long, hi long, off int, anchor long, content long, passage boolean")
    found = written(found.drop("off"))  # they are read twice, to count them and to join the counts
    counted = found.groupBy("anchor", "content").agg(F.count("*").alias("n"))
    per_anchor = Window.partitionBy("anchor")  # over counted contexts, not over occurrences
    counted = counted.select("*", F.sum("n").over(per_anchor).alias("times"), F.count("*").over(per_anchor).alias("kinds")).where("times > 1")
    kept = written(found.join(counted, ["anchor", "content"]).select("doc_id", "text_key", "lo", "hi", "passage", "anchor", "content", (F.col("n") == 1).alias("single"), (F.col("kinds") > 1).alias("mixed"), (F.col("kinds") > HOT_KINDS).alias("hot")))

    stop = F.when(F.col("passage"), F.col("hi")).otherwise(F.col("hi") + length)
    whole = kept.where("not single").select("doc_id", "text_key", "lo", stop.alias("stop"), "passage")
    one = kept.where("mixed and not single").groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "text_key", "lo", "hi", "passage", "hot")).alias("o")).selectExpr("o.*", "anchor", "false as single")
    unsure = kept.where("mixed and single").select("doc_id", "text_key", "lo", "hi", "passage", "hot", "anchor", "single").union(one).withColumn("stop", stop).alias("u")
    part = F.expr("substring(cast(text as binary), cast(lo + 1 as int), cast(stop - lo as int))").alias("content_bytes")
    cut = written(unsure.join(docs, _same_row(unsure, docs)).select(unsure["doc_id"], unsure["text_key"], "lo", "anchor", "passage", "single", "hot", part))
    few = cut.where("not hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor")
    resolved = few.mapInArrow(_resolve(length, passage), "doc_id long, text_key long, lo long, stop long, passage boolean")
    covered = whole.union(resolved)
    if not cut.where("hot").isEmpty():
        windows = cut.where("hot").drop("hot").mapInArrow(_each_window(length, passage), "doc_id long, text_key long, anchor long, passage boolean, single boolean, lo long, stop long, window long")
        often = windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "window")
        covered = covered.union(windows.where("single").join(often, ["anchor", "window"], "left_semi").select("doc_id", "text_key", "lo", "stop", "passage"))
    if words:
        short = docs.where("text is not null").mapInArrow(_short_windows(words, length), "doc_id long, text_key long, lo long, stop long, window long")
        again = short.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
        covered = covered.union(short.join(again, "window", "left_semi").select("doc_id", "text_key", "lo", "stop", F.lit(False)))
    return covered.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("lo", "stop", "passage")).alias("found")).mapInArrow(_merged, "doc_id long, text_key long, spans array<struct<lo: long, stop: long>>, passage_bytes long")


def without_spans(text: str | None, spans: list[dict] | None) -> bytes:
    data, out, at = (text or "").encode(), [], 0
    for x in spans or []:
        out.append(data[at : x["lo"]])
        at = x["stop"]
    return b"".join([*out, data[at:]])


def _digests(batches):
    for batch in slices(batches, "text"):
        kept = [without_spans(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column(SPANS).to_pylist(), strict=True)]
        n = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                n,
                pa.array([a - len(k) for a, k in zip(n.to_pylist(), kept, strict=True)], pa.int64()),
                pa.array([len(s or []) for s in batch.column(SPANS).to_pylist()], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                pc.fill_null(batch.column(PASSAGES), 0),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"],
        )


def _texts(batches):
    for batch in slices(batches, "text"):
        names = [x for x in batch.schema.names if x != SPANS]
        kept, left = [], []
        for t, spans in zip(batch.column("text").to_pylist(), batch.column(SPANS).to_pylist(), strict=True):
            left.append(True)
            if spans:  # ends that cut a character are moved inward
                data = t.encode()
                inner = []
                for x in spans:
                    lo, stop = x["lo"], x["stop"]
                    while lo < stop and data[lo] & 0xC0 == 0x80:
                        lo += 1
                    while stop > lo and stop < len(data) and data[stop] & 0xC0 == 0x80:
                        stop -= 1
                    inner.append({"lo": lo, "stop": stop})
                t = without_spans(t, inner).decode()
                left[-1] = bool(t.strip())
            kept.append(t)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()) if x == "text" else batch.column(x) for x in names], names=names).filter(pa.array(left, pa.bool_()))


def _with_spans(docs: DataFrame, length: int, words: int | None = None, passage: int | None = None) -> DataFrame:
    """``docs`` with columns ``SPANS`` and ``PASSAGES``, under names that no table is likely to have."""
    key = "_span_key"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    spans = repeated_spans(texts, length, words, passage).select(F.col("doc_id").alias("_span_doc"), F.col("text_key").alias(key), F.col("spans").alias(SPANS), F.col("passage_bytes").alias(PASSAGES))
    if docs.columns == ["doc_id", "text"]:  # the same exchange as for the texts of contexts
        return texts.join(spans, texts["doc_id"].eqNullSafe(F.col("_span_doc")) & (texts["text_key"] == F.col(key)), "left").drop("_span_doc", key, "text_key")
    own = docs.withColumn("_own_key", F.xxhash64("text"))
    return own.join(spans, own["doc_id"].cast("long").eqNullSafe(F.col("_span_doc")) & (F.col("_own_key") == F.col(key)), "left").drop("_span_doc", key, "_own_key")


def removal_digests(docs: DataFrame, length: int = 400, passage: int = 51) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` after all repeated bytes are gone, and ``n_passage_bytes``.

    The last counts the bytes of passages of ``passage`` words that occur again; they are reported, not removed, unless ``length`` bytes repeat.
    """
    kept = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long"
    return _with_spans(docs.select(F.col("doc_id").cast("long"), "text"), length, None, passage).mapInArrow(_digests, kept)


def remove_repeats(docs: DataFrame, length: int = 400, words: int | None = None) -> DataFrame:
    """``docs`` with its own columns, repeated bytes cut out of ``text``; a character cut in half stays whole.

    With ``words``, repeated passages of that many words are cut out too where they have fewer than ``length`` bytes.

    Null texts stay null. A row of which nothing but white space is left is dropped.
    """
    return _with_spans(docs, length, words).drop(PASSAGES).mapInArrow(_texts, docs.schema)
