"""Media columns: payloads as AVI motion-JPEG, read back through the RIFF index, decoded, and cut into shots.

Storing is lossless because a byte becomes one quantised DCT coefficient, the unit of baseline JPEG: size category 8 has exactly 256
values (-255..-128 and 128..255), and its eight extra bits are the byte. With Huffman tables that hold only this category under a
one-bit code, all quantisers 1, three components without subsampling and a restart after every unit, 192 bytes are one 8 x 8 pixel
YCbCr unit of 216 coded bytes. Any baseline decoder shows the frames.

Reading takes any AVI with an ``idx1`` index and baseline frames: general Huffman decoding, with a block-wise short cut for the tables
above. Shots are cut where the luma histograms of neighbouring frames differ by more than the recent mean and spread allow.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milpa.llm._shared import bytes_of, slices, texts_of

UNIT, SIDE, FPS = 192, 4, 10  # payload bytes of a unit, units along a full frame's side, frames a second
CLIPS = "array<struct<clip: int, start_ms: long, stop_ms: long, frames: int>>"
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
_ONE_CODE = bytes([1] + [0] * 15 + [8])


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


_TABLES = _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC4, b"\0" + _ONE_CODE) + _segment(0xC4, b"\x10" + _ONE_CODE)
_SCAN = _segment(0xDD, b"\0\1") + _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))


@cache
def zigzag() -> np.ndarray:
    """Position in the 8 x 8 block (row by row) of each coefficient in coded order: along diagonals, in turn up and down."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


@cache
def cosines() -> np.ndarray:
    """64 x 64 matrix from coefficients in coded order to pixels row by row."""
    k = np.arange(8)
    one = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return np.einsum("xu,yv->uvxy", one, one).reshape(64, 64)[zigzag()].astype(np.float32)


def frame_of(coded: np.ndarray) -> bytes:
    """One JPEG from the coded bytes of its units (units x 216)."""
    n = len(coded)
    height, width = (SIDE, SIDE) if n == SIDE * SIDE else (1, n)
    size = _segment(0xC0, struct.pack(">BHHB", 8, 8 * height, 8 * width, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3)))
    parts = [unit.tobytes().replace(b"\xff", b"\xff\0") + bytes([0xFF, 0xD0 + i % 8]) for i, unit in enumerate(coded)]
    parts[-1] = parts[-1][:-2]
    return b"\xff\xd8" + _TABLES + size + _SCAN + b"".join(parts) + b"\xff\xd9"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi_of(payload: np.ndarray) -> bytes:
    """The AVI file of a payload whose length is a positive multiple of ``UNIT``."""
    bits = np.zeros((len(payload), 9), np.uint8)
    bits[:, 1:] = np.unpackbits(payload[:, None], axis=1)
    coded = np.packbits(bits.reshape(-1, UNIT * 9), axis=1)
    per = SIDE * SIDE
    frames = [frame_of(coded[i : i + per]) for i in range(0, len(coded), per)]
    movi, index = [b"movi"], []
    at = 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 16, at, len(f)))
        at += len(movi[-1])
    side, largest = 8 * SIDE, max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, side, side, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, side, side)
    form = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def riff(data: bytes, start: int, stop: int):
    """Chunks between two places: name, begin and end of the body."""
    while start + 8 <= stop:
        size = struct.unpack_from("<I", data, start + 4)[0]
        yield data[start : start + 4], start + 8, min(stop, start + 8 + size)
        start += 8 + size + size % 2


def frames_of(avi: bytes) -> tuple[int, list[bytes]]:
    """Microseconds a frame, and the frames that the index names in order."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    micro, movi, index = 1_000_000 // FPS, None, None
    for name, a, b in riff(avi, 12, len(avi)):
        if name == b"LIST" and avi[a : a + 4] == b"hdrl":
            micro = next((struct.unpack_from("<I", avi, c)[0] for n, c, _ in riff(avi, a + 4, b) if n == b"avih"), micro)
        elif name == b"LIST" and avi[a : a + 4] == b"movi":
            movi = a
        elif name == b"idx1":
            index = (a, b)
    if movi is None or index is None:
        raise ValueError("no movi list or no index")
    out = []
    for i in range(index[0], index[1] - 15, 16):
        name, _, at, size = struct.unpack_from("<4sIII", avi, i)
        if name[2:] in (b"dc", b"db"):
            at = at if avi[at : at + 4] == name else movi + at  # offsets count from the file's or the list's begin
            out.append(avi[at + 8 : at + 8 + size])
    return micro, out


def _codes(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    code, at, out = 0, 0, {}
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def decode_jpeg(jpeg: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per component the quantised coefficients (blocks x 64, coded order) and the quantiser."""
    at, quant, codes, raw, parts, restart = 2, {}, {}, {}, [], 0
    while True:
        if jpeg[at] != 0xFF:
            raise ValueError("a marker was expected")
        mark, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if body[0] >> 4 else "u1").astype(np.float32)
                body = body[1 + n :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]], raw[body[0]] = _codes(body[1:17], body[17 : 17 + n]), body[1 : 17 + n]
                body = body[17 + n :]
        elif mark in (0xC0, 0xC1):
            height, width = struct.unpack_from(">HH", body, 1)
            parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, len(body), 3)]
        elif 0xC2 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise ValueError("only baseline frames are read")
        elif mark == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            tables = {body[i]: (body[i + 1] >> 4, 0x10 | body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)}
            break
    stretches = [x.replace(b"\xff\0", b"\xff") for x in _RESTART.split(jpeg[at : jpeg.rindex(b"\xff\xd9")])]
    quantisers = [quant[q] for *_, q in parts]
    if all(raw[t] == _ONE_CODE for c in tables for t in tables[c]) and all(h == v == 1 for _, h, v, _ in parts) and restart == 1 and 72 * len(parts) == min(map(len, stretches)) == max(map(len, stretches)):
        bits = np.unpackbits(np.frombuffer(b"".join(stretches), np.uint8)).reshape(-1, 9)
        value = np.packbits(bits[:, 1:], axis=1).ravel().astype(np.int16)
        value = np.where(value >= 128, value, value - 255).reshape(len(stretches), len(parts), 64)
        return [value[:, i] for i in range(len(parts))], quantisers
    h_most, v_most = max(h for _, h, _, _ in parts), max(v for _, _, v, _ in parts)
    units = -(-width // (8 * h_most)) * -(-height // (8 * v_most))
    blocks: list[list[np.ndarray]] = [[] for _ in parts]
    done = 0
    for data in stretches:
        bits, place = int.from_bytes(data, "big"), len(data) * 8

        def take(n: int) -> int:
            nonlocal place
            place -= n
            return bits >> place & (1 << n) - 1 if place >= 0 else 0

        def symbol(table: dict[tuple[int, int], int]) -> int:
            code = 0
            for n in range(1, 17):
                code = code << 1 | take(1)
                if (n, code) in table:
                    return table[n, code]
            raise ValueError("no such code")

        def number(n: int) -> int:
            x = take(n)
            return x if not n or x >> n - 1 else x - (1 << n) + 1

        before = [0] * len(parts)
        for _ in range(min(restart or units, units - done)):
            done += 1
            for i, (c, h, v, _) in enumerate(parts):
                for _ in range(h * v):
                    block = np.zeros(64, np.int16)
                    before[i] += number(symbol(codes[tables[c][0]]))
                    block[0], k = before[i], 1
                    while k < 64:
                        s = symbol(codes[tables[c][1]])
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15:
                            block[k] = number(s & 15)
                        k += 1
                    blocks[i].append(block)
    return [np.array(x) for x in blocks], quantisers


def pixels(blocks: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """Pixels of blocks (blocks x 64), 0 to 255."""
    return np.clip(np.rint((blocks * quantiser) @ cosines() + 128), 0, 255).astype(np.uint8)


def shots_of(histograms: np.ndarray, window: int = 8, spread: float = 1.5, least: float = 0.1) -> list[int]:
    """First frames of shots: where the difference to the frame before exceeds mean plus ``spread`` deviations of the last ``window`` ones."""
    jump = np.abs(np.diff(histograms, axis=0)).sum(1) / 2
    cuts = [0]
    for i, x in enumerate(jump):
        recent = jump[max(0, i - window) : i]
        if x >= least and (not len(recent) or x > recent.mean() + spread * recent.std()):
            cuts.append(i + 1)
    return cuts


def payload_of(values: list[np.ndarray]) -> bytes:
    """The bytes that :func:`avi_of` stored in a frame's coefficients."""
    value = np.stack(values, axis=1)
    return np.where(value >= 128, value, value + 255).astype(np.uint8).tobytes()


def _store(batches):
    for batch in slices(batches, "text"):
        data, ends = bytes_of(texts_of(batch.column("text")))
        media, padded = [], []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            n = max(1, -(-(b - a) // UNIT)) * UNIT
            payload = np.full(n, 32, np.uint8)
            payload[: b - a] = data[a:b]
            media.append(avi_of(payload))
            padded.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(padded, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "payload_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, payload_bytes, media``: each text as an AVI file, padded with spaces; null is an empty text. One row per row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_store, "doc_id long, n_bytes long, payload_bytes long, media binary")


def _read(batches):
    for batch in slices(batches, "media"):
        out: dict[str, list] = {k: [] for k in ("payload_sha256", "tail_crc32", "feature", "clips")}
        for media in batch.column("media").to_pylist():
            micro, frames = frames_of(media)
            stored, histograms = [], []
            for jpeg in frames:
                values, quantisers = decode_jpeg(jpeg)
                stored.append(payload_of(values))
                luma = pixels(values[0], quantisers[0])
                histograms.append(np.bincount(luma.ravel() >> 4, minlength=16) / luma.size)
            payload = b"".join(stored)
            shots = shots_of(np.array(histograms).reshape(-1, 16))
            stops = [*shots[1:], len(frames)]
            mean = np.mean(histograms, axis=0) if histograms else np.zeros(16)
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-16:]))
            out["feature"].append(f"frames={len(frames)};shots={len(shots)};cuts={','.join(map(str, shots[1:]))};luma={','.join(str(round(x * 1000)) for x in mean)}")
            out["clips"].append([{"clip": i, "start_ms": a * micro // 1000, "stop_ms": b * micro // 1000, "frames": b - a} for i, (a, b) in enumerate(zip(shots, stops, strict=True))])
        clip = pa.list_(pa.struct([("clip", pa.int32()), ("start_ms", pa.int64()), ("stop_ms", pa.int64()), ("frames", pa.int32())]))
        names = [x for x in batch.schema.names if x != "media"]
        kinds = (pa.string(), pa.int64(), pa.string(), clip)
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=[*names, *out])


def read(stored: DataFrame) -> DataFrame:
    """From ``doc_id, n_bytes, payload_bytes, media``: sizes and hashes of media and of the payload read back, feature, and timed ``clips``."""
    told = stored.where("media is not null").withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    return told.select("doc_id", "n_bytes", "payload_bytes", "media_bytes", "media_sha256", "media").mapInArrow(_read, f"doc_id long, n_bytes long, payload_bytes long, media_bytes long, media_sha256 string, payload_sha256 string, tail_crc32 long, feature string, clips {CLIPS}")


def clips(read_media: DataFrame) -> DataFrame:
    """One row per shot: ``doc_id, clip, start_ms, stop_ms, frames``."""
    return read_media.select("doc_id", F.inline("clips"))
