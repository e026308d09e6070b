"""Token ids in compressed binary files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

Per id, three orders predict. Order 0 gives every id of the group a probability: ids lie in classes of about equal frequency, the
probabilities of classes adapt with every id, those inside a class are the group's frequencies. Order 1 and order 2 each predict the id
last seen after the same one id or the same two, with a confidence. The probabilities are mixed linearly,
``p(id) = m2 [id = guess2] + m1 [id = guess1] + m0 p0(id)``; the shares ``m1`` and ``m2`` are learned by how sure both guesses are and
whether they agree. The mixture's cumulated probabilities narrow the range coder's interval once an id. Each block of ``BLOCK`` ids
begins with fresh tables and shares and the group's frequencies, which are the group's prior.

The blocks of a group are coded and decoded side by side in numpy, one id of each a step. A file is a list of groups of whole documents; a group
holds its documents' ids and counts, its prior (ids and counts) and its blocks; a block is ``CMR3``, its count of ids, their crc32, the
length, and the coded words. Documents lie in ascending ``doc_id`` order over files and groups.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from milpa.llm._shared import bytes_of, shared_folder, slices, texts_of

#: What a step costs depends little on its lanes, so a file's blocks are coded in one go: 32 MB of text have some 3,000.
BLOCK, LANES, SLOTS, MAGIC, KEPT_WORDS, KEPT_LENGTH = 4096, 4096, 1024, b"CMR3", 300_000, 64
CLASSES, CLASS_BITS, WEIGHT_BITS, LEAST_CLASS, LEAST_INSIDE, RATE, CLASS_RATE = 16, 14, 12, 4, 16, 5, 7
FULL, CELL_BITS, WORD, LOWEST = 1 << WEIGHT_BITS, 4, 16, 1 << 40
GROUPS = "file int, seq int, doc_ids array<long>, doc_tokens array<long>, prior binary, blocks array<binary>"


class Prior:
    """Order 0 at the start of every block of a group: classes of about equal frequency, and each id's place within its class.

    Ids are known by their rank among the group's ids. A class is ``1 << inside`` wide, of which every id has ``LEAST_INSIDE`` at least.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        n, total = len(ids), np.cumsum(counts)
        self.ids, self.counts = ids, counts
        kind = np.unique((total - counts) * CLASSES // int(total[-1]), return_inverse=True)[1].astype(np.int64)
        sizes = np.bincount(kind, minlength=CLASSES)
        self.inside = max(18, int(2 * LEAST_INSIDE * sizes.max() - 1).bit_length())
        self.total_bits = CLASS_BITS + self.inside
        if self.total_bits > 38:
            raise ValueError(f"{n} different ids in a group are too many")
        own = np.bincount(kind, weights=counts, minlength=CLASSES).astype(np.int64)
        before, rank = (np.cumsum(own) - own)[kind], np.arange(n) - (np.cumsum(sizes) - sizes)[kind]
        room, mass = ((1 << self.inside) - LEAST_INSIDE * sizes)[kind], own[kind]
        start = (total - counts - before) * room // mass + LEAST_INSIDE * rank
        stop = (total - before) * room // mass + LEAST_INSIDE * (rank + 1)
        self.packed, self.kind = np.concatenate([kind << 52 | start << 26 | (stop - start), np.full(2 << self.inside - 18, CLASSES << 52)]), kind.astype(np.int16)
        self.cell_bits = CELL_BITS + self.inside - 18  # a cell is as wide as the least ids, or as few of them as keep the table small
        cells = np.searchsorted(kind << self.inside | start, np.arange(CLASSES << self.inside - self.cell_bits) << self.cell_bits, "right") - 1
        self.cell_start = np.maximum(cells, 0).astype(np.uint16 if n <= 1 << 16 else np.int32)
        self.steps = [1 << i for i in range(self.cell_bits - CELL_BITS, -1, -1)]
        spread = (1 << CLASS_BITS) - LEAST_CLASS * CLASSES
        floor = LEAST_CLASS * np.arange(1, CLASSES + 1)
        self.edges = (np.cumsum(own) * spread // int(own.sum()) + floor).astype(np.int16)
        self.floor, self.spread = floor.astype(np.int16)[:, None], np.int16(spread)

    def to_bytes(self) -> bytes:
        return zlib.compress(np.concatenate([np.diff(self.ids, prepend=0), self.counts]).astype("<u4").tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> Prior:
        both = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
        return cls(np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :])

    def find(self, kind: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """The rank whose stretch of a class holds each place."""
        at = self.cell_start.take((kind << self.inside | inside) >> self.cell_bits).astype(np.int64)
        key = kind << 26 | inside
        for step in self.steps:
            at += step * (self.packed.take(at + step) >> 26 <= key)
        return at


class Coder:
    """A range coder in every lane: 64-bit low, range of at most 62 bits, carries added to words already out, 16-bit words."""

    def __init__(self, words: np.ndarray, bits: int, decoding: bool):
        """``words`` by number and lane: lanes advance alike, so those at hand lie close together."""
        lanes = words.shape[1]
        self.words, self.flat, self.lanes, self.decoding, self.bits = words, words.ravel(), lanes, decoding, bits
        self.at = np.arange(lanes)  # where the next word of each lane is in ``flat``
        self.range = np.full(lanes, 1 << 62)
        self.code = np.zeros(lanes, np.int64)  # low (its bits), or when decoding what has been read less low
        if decoding:
            for _ in range(4):
                self.code = self.code << WORD | self.flat[self.at]
                self.at += lanes

    def target(self, n: int) -> np.ndarray:
        """Where the code of each lane points, of ``1 << bits``."""
        code, step = self.code[:n], self.range[:n] >> self.bits
        out = (code / step - 2**-12).astype(np.int64)  # off by less than that, so the whole quotient or one less
        out += (out + 1) * step <= code
        return np.minimum(out, (1 << self.bits) - 1, out=out)

    def narrow(self, n: int, start: np.ndarray, size: np.ndarray) -> None:
        code, width, at = self.code[:n], self.range[:n], self.at[:n]
        step = width >> self.bits
        np.multiply(step, size, out=width)
        step *= start
        if self.decoding:
            code -= step
        else:
            code += step
            carried = np.flatnonzero(code.view(np.uint64) < step.view(np.uint64))
            carried = at[carried] - self.lanes
            while len(carried):
                self.flat[carried] += np.uint16(1)
                carried = carried[self.flat[carried] == 0] - self.lanes
        low = width < LOWEST  # every lane reads or writes its next word, and those whose range is low go past it
        if self.decoding:
            word = self.flat.take(at)
            word *= low
        else:
            self.flat[at] = code.view(np.uint16)[3::4]
        shift = (low.view(np.uint8) << 4).astype(np.int64)
        width <<= shift
        code <<= shift
        if self.decoding:
            code |= word
        at += low * self.lanes
        out = np.flatnonzero(width < LOWEST)
        while len(out):  # rare ids need a second word
            here, wide = at[out], width[out] << WORD
            if self.decoding:
                code[out] = code[out] << WORD | self.flat[here]
            else:
                self.flat[here] = code.view(np.uint16)[3::4][out]
                code[out] <<= WORD
            width[out] = wide
            at[out] = here + self.lanes
            out = out[wide < LOWEST]

    def finish(self) -> None:
        for shift in (48, 32, 16, 0):
            self.flat[self.at] = (self.code >> shift).astype(np.uint16)
            self.at += self.lanes

    def coded(self) -> list[bytes]:
        words = turned(self.words[: int(self.at.max()) // self.lanes + 1]).astype("<u2", copy=False)
        return [words[i, : n // self.lanes].tobytes() for i, n in enumerate(self.at.tolist())]


def turned(table: np.ndarray) -> np.ndarray:
    """The transposed table, written some rows at a time, so that what is read stays in the cache."""
    out = np.empty(table.shape[::-1], table.dtype)
    for i in range(0, len(out), 32):
        out[i : i + 32] = table[:, i : i + 32].T
    return out


#: Shares of both guesses at the start, by confidence: that of order 2 above 16 bits.
_SHARES = np.repeat(np.array([40, 900, 2400, 3400], np.int32), 8) << 16 | np.tile(np.repeat(np.array([30, 500, 1300, 2200], np.int32), 2), 4)
SURE, GUESS = 1 << 24, (1 << 24) - 1


def _learned(known: np.ndarray, guess: np.ndarray, hit: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """What a context knows after ``ranks``: a right guess is surer, up to 3; a wrong one of 2 or 3 stays with 1, another gives way."""
    right = np.minimum(known + SURE, guess | 3 * SURE)
    return np.where(hit, right, np.where(known >= 2 * SURE, guess | SURE, ranks))


class Mixer:
    """The adaptive state of all lanes, and one id (by rank) of every live lane at a time, coded or decoded."""

    def __init__(self, lanes: int, prior: Prior):
        self.prior = prior
        self.guess1, self.guess2 = np.zeros(lanes * SLOTS, np.int32), np.zeros(lanes * SLOTS, np.int32)  # rank | confidence << 24
        self.shares = np.repeat(_SHARES, lanes)  # by confidences and lane
        self.edges = np.repeat(np.append(np.int16(0), prior.edges)[:, None], lanes, axis=1)  # by class and lane, where the class begins, and the next one
        self.lanes, self.every, self.order = lanes, np.arange(lanes), np.arange(CLASSES, dtype=np.int16)[:, None]
        self.slots, self.goals, self.most = self.every * SLOTS, np.empty((CLASSES, lanes), np.int16), prior.floor + prior.spread
        self.at1, self.at2, self.before = self.slots.copy(), self.slots.copy(), np.zeros(lanes, np.int32)  # where the guesses are; the last id's part in the next ``at2``

    def _class(self, kind: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each lane's class begins, and how wide it is."""
        at = kind * self.lanes
        at += self.every[:n]
        flat = self.edges.ravel()
        first = flat.take(at).astype(np.int64)
        at += self.lanes
        return first, flat.take(at) - first

    def _order0(self, ranks: np.ndarray, m0: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The order-0 share's stretch of each rank within the mixture."""
        packed = self.prior.packed.take(ranks)
        low, wide = self._class(packed >> 52, n)
        low <<= self.prior.inside
        low += wide * (packed >> 26 & (1 << 26) - 1)
        packed &= (1 << 26) - 1
        packed *= wide
        packed += low
        low *= m0
        low >>= WEIGHT_BITS
        packed *= m0
        packed >>= WEIGHT_BITS
        return low, packed

    def _pointed(self, v: np.ndarray, guess1: np.ndarray, guess2: np.ndarray, m0: np.ndarray, m1: np.ndarray, m2: np.ndarray, n: int) -> np.ndarray:
        """The ranks at places ``v`` of the mixture: both guesses' shares are taken off what lies above them, the rest is order 0's."""
        prior = self.prior
        start1, stop1 = self._order0(guess1, m0, n)
        start2, stop2 = self._order0(guess2, m0, n)
        under, over = guess2 < guess1, guess2 > guess1
        start1 += m2 * under
        start2 += m1 * over
        stop1 += m1
        stop1 += m2 * ~over
        stop2 += m2
        stop2 += m1 * ~under
        past1, past2 = v >= stop1, v >= stop2
        here1, here2 = (v >= start1) > past1, (v >= start2) > past2
        u = v - m1 * past1
        u -= m2 * past2
        u <<= WEIGHT_BITS
        u |= FULL - 1
        u = np.minimum((u / m0).astype(np.int64), (1 << prior.total_bits) - 1)
        kind = (self.edges[1:, :n] <= (u >> prior.inside).astype(np.int16)).view(np.uint8).sum(0, dtype=np.uint8).astype(np.int64)
        first, wide = self._class(kind, n)
        u -= first << prior.inside
        found = prior.find(kind, (u / wide).astype(np.int64))
        return np.where(here1, guess1, np.where(here2, guess2, found))

    def step(self, coder: Coder, n: int, ranks: np.ndarray | None) -> np.ndarray:
        """Lanes ``0 .. n - 1``; gives their ranks, which are ``ranks`` when coding."""
        at1, at2 = self.at1[:n], self.at2[:n]
        known1, known2 = self.guess1.take(at1), self.guess2.take(at2)
        guess1, guess2 = known1 & GUESS, known2 & GUESS
        context = known2 >> 21 & 24
        context |= known1 >> 23 & 6
        context += guess1 == guess2
        context = context.astype(np.int64)
        context *= self.lanes
        context += self.every[:n]
        shares = self.shares.take(context)
        share2, share1 = shares >> 16, shares & 0xFFFF
        m2 = np.minimum(share2, FULL - 96)
        m1 = np.minimum(share1, FULL - 64 - m2)
        m0 = (FULL - m2 - m1).astype(np.int64)
        m2 = m2.astype(np.int64) << self.prior.total_bits - WEIGHT_BITS
        m1 = m1.astype(np.int64) << self.prior.total_bits - WEIGHT_BITS
        if ranks is None:
            ranks = self._pointed(coder.target(n), guess1, guess2, m0, m1, m2, n)
        ranks = ranks.astype(np.int32, copy=False)
        hit2, hit1 = guess2 == ranks, guess1 == ranks
        start, size = self._order0(ranks, m0, n)
        size -= start
        size += m2 * hit2
        size += m1 * hit1
        start += m2 * (guess2 < ranks)
        start += m1 * (guess1 < ranks)
        coder.narrow(n, start, size)
        share2 += hit2 * np.int32(FULL - 1) - share2 >> RATE
        share1 += (hit1 > hit2) * np.int32(FULL - 1) - share1 >> RATE
        share2 <<= 16
        share2 |= share1
        self.shares[context] = share2
        self.guess1[at1] = _learned(known1, guess1, hit1, ranks)
        self.guess2[at2] = _learned(known2, guess2, hit2, ranks)
        edges, goals = self.edges[1:, :n], self.goals[:, :n]
        np.subtract(self.order, self.prior.kind.take(ranks), out=goals)
        goals >>= 15  # all bits for the ends of classes before the id's
        goals &= self.prior.spread
        np.subtract(self.most, goals, out=goals)
        goals -= edges
        goals >>= CLASS_RATE
        edges += goals
        np.add(self.slots[:n], (ranks * np.int32(40503) >> 3 & SLOTS - 1).astype(np.int64), out=at1)
        np.add(self.slots[:n], ((ranks * np.int32(0x6E3B) ^ self.before[:n]) >> 5 & SLOTS - 1).astype(np.int64), out=at2)
        np.multiply(ranks, np.int32(0x5EB7), out=self.before[:n])
        return ranks


def pack(ids: np.ndarray) -> tuple[bytes, list[bytes]]:
    """The prior and the blocks of a stream of ids; an empty stream has none."""
    if not len(ids):
        return b"", []
    if int(ids.max()) < 1 << 20:  # ids of any usual tokenizer: no sorting needed
        counts = np.bincount(ids)
        known, ranks = np.flatnonzero(counts), (np.cumsum(counts > 0) - 1).astype(np.int32).take(ids)
        counts = counts[known]
    else:
        known, ranks, counts = np.unique(ids, return_inverse=True, return_counts=True)
    prior, out = Prior(known.astype(np.int64), counts), []
    for a in range(0, len(ids), LANES * BLOCK):
        own = ranks[a : a + LANES * BLOCK]
        n, most = -(-len(own) // BLOCK), min(BLOCK, len(own))
        table = np.zeros((n, BLOCK), np.int32)
        table.ravel()[: len(own)] = own
        table = turned(table[:, :most])
        coder, mixer, last = Coder(np.zeros((most * 5 // 2 + 16, n), np.uint16), prior.total_bits, False), Mixer(n, prior), len(own) - (n - 1) * BLOCK
        for t in range(most):
            live = n if t < last else n - 1
            mixer.step(coder, live, table[t, :live])
        coder.finish()
        for i, coded in enumerate(coder.coded()):
            plain = ids[a + i * BLOCK : a + min((i + 1) * BLOCK, len(own))].astype("<u4")
            out.append(MAGIC + struct.pack("<III", len(plain), zlib.crc32(plain.tobytes()), len(coded)) + coded)
    return prior.to_bytes(), out


def unpack(prior: bytes, blocks: list[bytes]) -> np.ndarray:
    """The ids of blocks of one stream; raises if a block is damaged."""
    if not blocks:
        return np.zeros(0, "<u4")
    model, parts = Prior.from_bytes(prior), []
    known = model.ids.astype("<u4")
    for a in range(0, len(blocks), LANES):
        own = blocks[a : a + LANES]
        heads = [struct.unpack_from("<III", b, 4) for b in own]
        sizes = np.array([h[0] for h in heads])
        if any(b[:4] != MAGIC or len(b) != 16 + h[2] for b, h in zip(own, heads, strict=True)) or (sizes[:-1] < sizes[1:]).any():
            raise ValueError("damaged block")
        words = np.zeros((len(own), max(h[2] for h in heads) // 2 + 8), np.uint16)
        for i, b in enumerate(own):
            words[i, : heads[i][2] // 2] = np.frombuffer(b, "<u2", offset=16)
        coder, mixer, out = Coder(turned(words), model.total_bits, True), Mixer(len(own), model), np.zeros((int(sizes.max()), len(own)), np.int32)
        for t in range(len(out)):
            live = int((sizes > t).sum()) if t >= sizes[-1] else len(sizes)
            try:
                out[t, :live] = mixer.step(coder, live, None)
            except IndexError:  # only a damaged block points or reads beyond
                raise ValueError("damaged block") from None
        out = known.take(turned(out))
        for i, h in enumerate(heads):
            if zlib.crc32(out[i, : h[0]].tobytes()) != h[1]:
                raise ValueError("checksum differs")
        parts.append(out.ravel()[: sizes.sum()] if sizes[0] == sizes[-2:].max() else out[np.arange(out.shape[1])[None, :] < sizes[:, None]])
    return np.concatenate(parts)


#: Kinds of bytes: letters, digits, other signs, apostrophe, space, other white space, control characters, parts of characters beyond ASCII.
_KINDS = (b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~', b"'", b" ", b"\t\n\v\f\r", bytes({*range(9), *range(14, 32), 127}))
_KIND = bytes(next((kind for kind, own in enumerate(_KINDS) if b in own), 7) for b in range(256))
#: Whether a token always ends between bytes of two kinds, at ``8 * kind + next kind``: before white space, and where letters, digits and other signs meet, but
#: for an apostrophe before a letter, which may begin a contraction.
_ENDS = bytes(b != a and (b in (4, 5) and a not in (4, 5, 6) or max(a, b) < 4 and (a, b) not in ((2, 3), (3, 2), (3, 0))) for a in range(8) for b in range(8)) + bytes(192)
#: The pattern that the cuts go by: GPT-2's.
_PATTERN = "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
#: The tokenizer's character for each byte; a line break stays.
_SHOWN = np.arange(256, dtype="<u4")
_SHOWN[[*range(33), *range(127, 161), 173]] = 256 + np.arange(68)
_SHOWN[10] = 10


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, [{}, {}]


def the_tokenizer(path: str):
    return _tokenizer(path)[0]


@cache
def special_texts(path: str) -> list[str]:
    """Texts that have an id of their own wherever they stand."""
    return sorted(t.content for t in the_tokenizer(path).get_added_tokens_decoder().values())


def _encoded(words: list[str], tokenizer) -> dict[str, bytes]:
    """Ids of each word. A word of Latin letters, after a space or not, is one token of the pattern and goes to the library's model; others go through the whole tokenizer."""
    plain = [w for w in words if w[w[:1] == " " :].isalpha() and (w.isascii() or max(w) < "\u0100")]
    shown = _SHOWN.take(np.frombuffer("\n".join(plain).encode(), np.uint8)).tobytes().decode("utf-32-le").split("\n") if plain else []
    tokenize, flat, ends = tokenizer.model.tokenize, [], [0]
    for w in shown:
        flat += [t.id for t in tokenize(w)]
        ends.append(len(flat))
    raw = np.array(flat, np.int32).tobytes()
    out = {w: raw[4 * a : 4 * b] for w, a, b in zip(plain, ends, ends[1:], strict=False)}
    rest = [w for w in words if w not in out] if len(out) < len(words) else []
    out.update(zip(rest, (np.array(e.ids, np.int32).tobytes() for e in tokenizer.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
    return out


def _starts(texts: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin among the bytes of all texts, and the first word of each text, with the count of all; texts marked ``whole`` are not cut.

    Cuts are places where the pattern ends a token whatever follows: at white space after anything else, where letters, digits and other signs
    meet, and after a white space that isn't a blank and stands alone. So no word ends with white space that the pattern would divide otherwise.
    """
    data, offsets = bytes_of(texts)
    kind = np.frombuffer(data.tobytes().translate(_KIND), np.uint8)
    first = np.zeros(len(data) + 1, bool)
    first[1:-1] = np.frombuffer((kind[:-1] << 3 | kind[1:]).tobytes().translate(_ENDS), bool)
    beyond = np.flatnonzero(first[2:-1] & (kind[1:-1] == 7)) + 1  # white space beyond ASCII, followed by more
    last, second, third = data[beyond], data[beyond - 1], data[np.maximum(beyond - 2, 0)]
    white = (second == 0xC2) & ((last == 0x85) | (last == 0xA0)) | (third == 0xE1) & (second == 0x9A) & (last == 0x80) | (third == 0xE2) & (second == 0x81) & (last == 0x9F)
    white |= (third == 0xE3) & (second == 0x80) & (last == 0x80) | (third == 0xE2) & (second == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
    first[beyond[white] + 1] = False
    first[offsets] = True
    lone = np.flatnonzero(kind[:-1] == 5)
    first[lone[first[lone] & (kind[lone + 1] < 4)] + 1] = True
    for i in np.flatnonzero(whole):
        first[offsets[i] + 1 : offsets[i + 1]] = False
    starts = np.flatnonzero(first)
    return starts, np.searchsorted(starts, offsets)


def encode_all(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts as the tokenizer gives them, and offsets by text.

    Texts are cut where the tokenizer's pattern always ends a token, and the library encodes each distinct word once. Texts with a special text are encoded
    as a whole, and so are all texts by a tokenizer of another pattern, or with a normalizer.
    """
    tokenizer, known = _tokenizer(path)
    whole = np.full(len(texts), tokenizer.normalizer is not None or repr(tokenizer.pre_tokenizer) != _PATTERN)
    for special in special_texts(path):
        whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
    starts, cuts = _starts(texts, whole)
    coded = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(bytes_of(texts)[0])).dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    recent, older = known  # words of two generations, so that frequent ones are kept when the younger is full
    if len(recent) > KEPT_WORDS:
        known[:] = recent, older = {}, recent
    ids = list(map(recent.get, names))
    lost = [i for i, x in enumerate(ids) if x is None]
    past = [names[i] for i in lost]
    found = list(map(older.get, past))
    new = _encoded([w for w, x in zip(past, found, strict=True) if x is None], tokenizer)
    for i, w, x in zip(lost, past, found, strict=True):
        ids[i] = x = new[w] if x is None else x
        if len(w) <= KEPT_LENGTH:
            recent[w] = x
    ids, ends = bytes_of(pa.array(ids, pa.large_binary()).take(coded.indices))
    return ids.view(np.int32), ends[cuts] // 4


def encode_texts(texts: pa.Array, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by ``end``, and offsets by text."""
    ids, cuts = encode_all(texts, path)
    return np.insert(ids, cuts[1:], end), cuts + np.arange(len(cuts))


def _write(path: str, end: int):
    def group(seq: int, docs: list, counts: list, ids: list) -> pa.RecordBatch:
        prior, blocks = pack(np.concatenate(ids))
        return pa.RecordBatch.from_pylist(
            [{"file": TaskContext.get().partitionId(), "seq": seq, "doc_ids": docs, "doc_tokens": counts, "prior": prior, "blocks": blocks}],
            pa.schema([("file", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("prior", pa.binary()), ("blocks", pa.list_(pa.binary()))]),
        )

    def run(batches):
        docs, counts, ids, seq = [], [], [], 0
        for batch in slices(batches, "text", 16 << 20):
            flat, cuts = encode_texts(texts_of(batch.column("text")), path, end)
            docs += batch.column("doc_id").to_pylist()
            counts += np.diff(cuts).tolist()
            ids.append(flat)
            if sum(map(len, ids)) >= LANES * BLOCK:
                yield group(seq, docs, counts, ids)
                docs, counts, ids, seq = [], [], [], seq + 1
        if docs:
            yield group(seq, docs, counts, ids)

    return run


def write_ids(docs: DataFrame, folder: str, path: str, end: int = 2, file_bytes: int = 32 << 20) -> None:
    """Encode ``docs(doc_id, text)`` and write the files into ``folder``, documents in ascending order of ``doc_id``, then a hash of the text.

    A null text is empty and has only the end id; rows without ``doc_id`` are left out; repeated rows are written each, different texts
    of one ``doc_id`` may lie in several files. A text of any length is encoded whole and lies in one group, whose blocks are coded
    ``LANES`` at a time. Further columns are ignored; an empty table makes files without groups.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")).where("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-size // file_bytes), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size >> 21))
    ordered = docs.repartitionByRange(files, "doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "text").select("doc_id", "text")
    ordered.mapInArrow(_write(path, end), GROUPS).write.option("compression", "none").parquet(folder)


def _digest(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids, at, out = unpack(row["prior"], row["blocks"]), 0, []
            for n in row["doc_tokens"]:
                out.append((at, zlib.crc32(ids[at : at + n].tobytes())))
                at += n
            if at != len(ids):
                raise ValueError("a group's counts don't match its blocks")
            n = len(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["file"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array([x for x, _ in out], pa.int64()), pa.array(row["doc_tokens"], pa.int64()), pa.array([x for _, x in out], pa.int64())],
                names=["file", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def _texts_ids(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids, cuts = unpack(row["prior"], row["blocks"]), np.concatenate([[0], np.cumsum(row["doc_tokens"])])
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])


def read_ids(groups: DataFrame) -> DataFrame:
    """``doc_id, ids`` from the files' groups."""
    return groups.mapInArrow(_texts_ids, "doc_id long, ids array<int>")


def digests(groups: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``, decoded from the files; ``start`` counts the ids of all documents before."""
    sizes = groups.select("file", "seq", F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shelf = sizes.withColumn("shelf", F.expr("file div 4096"))  # sums over shelves of files, so that no window holds all files
    whole = shelf.groupBy("shelf").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shelf").rowsBetween(Window.unboundedPreceding, -1)  # a row for 4096 files
    inside = Window.partitionBy("shelf").orderBy("file", "seq").rowsBetween(Window.unboundedPreceding, -1)
    shelves = whole.select("shelf", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("b"))
    starts = shelf.withColumn("a", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(shelves, "shelf").select("file", "seq", (F.col("a") + F.col("b")).alias("before"))
    return groups.mapInArrow(_digest, "file int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long").join(starts, ["file", "seq"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def written_digests(docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    """Write ``docs`` into a new folder of the session's shared one, and digest what is read back."""
    folder = f"{shared_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, folder, path, end)
    return digests(docs.sparkSession.read.schema(GROUPS).parquet(folder))
