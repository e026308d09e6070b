"""Language-model scores of documents by a weighted backoff automaton over words.

Word pairs are counted over all training documents and smoothed with a Dirichlet prior: after word ``v``, word ``w`` has probability
``(c(vw) + mu p(w)) / (c(v) + mu)``, where ``p(w) = (c(w) + 1) / (N + V + 1)`` gives unknown words their share. As an automaton, every
known word is a state; a seen pair is an arc with its log-probability; an unseen word leaves by the state's failure arc, of weight
``mu / (c(v) + mu)``, to the empty history and is read there. Each text is read once from left to right, carrying state and sum.

Nothing of the model is broadcast or collected but the two numbers N and V. Documents are dealt to chunks of a few MB by a hash of their id.
Each chunk sends the distinct keys (hashes of words and of pairs) it holds, with its training counts, in sorted blocks to the part that
owns a range of keys; the part adds up the chunks' counts and answers each block with totals; the chunk then builds the automaton of
just the keys it holds and reads its texts. The number of chunks and parts grows with the input, so memory in a task does not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milpa.llm._shared import U64, hashes_of, mix, slices, texts_of, words_of

END, BEGIN = U64(0x1D8E4E27C47D124F), U64(0xEB44ACCAB455D165)
CHUNK_BYTES = 12 << 20
ANSWER = "chunk int, part int, totals binary"


def is_held_out(doc_id: Column, folds: int = 7, held: int = 2) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == held


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's words, each text followed by the end token; and offsets by text."""
    codes, words, ends = words_of(texts)
    out = np.full(len(codes) + len(texts), END, U64)
    place = np.arange(len(codes)) + np.repeat(np.arange(len(texts)), np.diff(ends))
    if len(codes):
        out[place] = hashes_of(words)[codes]
    return out, ends + np.arange(len(ends))


def word_keys(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens) | U64(1)


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(before) * U64(0x9E3779B97F4A7C15) + tokens) & ~U64(1)


def contexts_of(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    before = np.concatenate([[BEGIN], tokens[:-1]]) if len(tokens) else tokens
    before[ends[:-1]] = BEGIN
    return before


def owner(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part that owns each key: ``parts`` equal ranges, so sorted keys have sorted owners."""
    return ((keys >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def packed(counts: np.ndarray) -> bytes:
    kind = np.uint8 if (most := counts.max(initial=0)) < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64
    return counts.astype(kind).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n if n else 1}").astype(np.int64)


def _blocks(keys: np.ndarray, counts: np.ndarray, parts: int, chunk: int) -> pa.Table:
    cuts = np.searchsorted(owner(keys, parts), np.arange(parts + 1))
    held = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
    return pa.table(
        {
            "chunk": pa.array([chunk] * len(held), pa.int32()),
            "part": pa.array(held, pa.int32()),
            "keys": pa.array([keys[cuts[p] : cuts[p + 1]].tobytes() for p in held], pa.binary()),
            "counts": pa.array([packed(counts[cuts[p] : cuts[p + 1]]) for p in held], pa.binary()),
        }
    )


def _chunk_keys(group: pa.Table):
    tokens, ends = tokens_of(texts_of(group["text"]))
    keys, inverse = np.unique(np.concatenate([word_keys(tokens), pair_keys(contexts_of(tokens, ends), tokens)]), return_inverse=True)
    learn = np.repeat(~group["held_out"].combine_chunks().to_numpy(zero_copy_only=False), np.diff(ends))
    counts = np.bincount(inverse[np.concatenate([learn, learn])], minlength=len(keys))
    return keys, inverse, counts, tokens, ends


def _ask(parts: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        keys, _, counts, _, _ = _chunk_keys(group)
        return _blocks(keys, counts, parts, key[0].as_py())

    return run


def _answer(group: pa.Table) -> pa.Table:
    asked = [np.frombuffer(x, U64) for x in group["keys"].to_pylist()]
    counted = [unpacked(x, len(k)) for x, k in zip(group["counts"].to_pylist(), asked, strict=True)]
    _, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    totals = np.bincount(inverse, weights=np.concatenate(counted)).astype(np.int64)[inverse]
    cuts = np.cumsum([0] + [len(k) for k in asked])
    return pa.table({"chunk": group["chunk"], "part": group["part"], "totals": pa.array([packed(totals[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


class BackoffAutomaton:
    """States are known words (and the begin of a text), arcs the seen pairs; every state fails to the empty history."""

    def __init__(self, keys: np.ndarray, totals: np.ndarray, n: int, v: int, prior: float):
        self.keys, self.totals, self.all, self.prior = keys, totals, n + v + 1, prior
        self.known = self.count(word_keys(np.array([END], U64)))[0]

    def count(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == keys, self.totals[np.minimum(at, len(self.keys) - 1)], 0)

    def read(self, tokens: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log10-probability of each text; ``counts`` are the tokens' training counts. All texts advance together, one token a step."""
        order = np.argsort(-np.diff(ends), kind="stable")
        starts, lengths = ends[:-1][order], np.diff(ends)[order]
        empty = np.log10((counts + 1) / self.all)  # arcs of the empty history
        total = np.zeros(len(starts))
        state, weight = np.full(len(starts), BEGIN, U64), np.full(len(starts), self.known, np.float64)
        for t in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-lengths, -t, "left"))
            at = starts[:live] + t
            word, base = tokens[at], empty[at]
            pair = self.count(pair_keys(state[:live], word))
            seen = pair > 0
            failure = np.log10(self.prior / (weight[:live] + self.prior))
            arc = np.log10((pair + self.prior * 10.0**base) / (weight[:live] + self.prior))
            total[:live] += np.where(seen, arc, failure + base)
            state[:live], weight[:live] = word, counts[at]
        out = np.zeros(len(starts))
        out[order] = total
        return out


def _score(n: int, v: int, prior: float):
    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table({k: pa.array([], t) for k, t in KINDS.items()})
        keys, inverse, _, tokens, ends = _chunk_keys(group)
        cuts = np.searchsorted(owner(keys, answers_parts), np.arange(answers_parts + 1)) if (answers_parts := group["parts"][0].as_py()) else None
        totals = np.zeros(len(keys), np.int64)
        for part, data in zip(answers["part"].to_pylist(), answers["totals"].to_pylist(), strict=True):
            totals[cuts[part] : cuts[part + 1]] = unpacked(data, cuts[part + 1] - cuts[part])
        counts = totals[inverse[: len(tokens)]]
        keep = totals > 0
        automaton = BackoffAutomaton(np.append(keys[keep], U64(0xFFFFFFFFFFFFFFFF)), np.append(totals[keep], 0), n, v, prior)
        base = np.add.reduceat(np.log10((counts + 1) / (n + v + 1)), ends[:-1])
        return pa.table(
            {
                "doc_id": group["doc_id"],
                "held_out": group["held_out"],
                "n_tokens": pa.array(np.diff(ends), pa.int64()),
                "n_known": pa.array(np.add.reduceat((counts > 0).astype(np.int64), ends[:-1]), pa.int64()),
                "train_tokens": pa.array(np.full(len(ends) - 1, n), pa.int64()),
                "base_score": pa.array(base),
                "score": pa.array(automaton.read(tokens, ends, counts)),
            }
        )

    return run


KINDS = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _partition_words(parts: int):
    def run(batches):
        keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)
        for batch in slices(batches, "text", 4 << 20):
            tokens, _ = tokens_of(texts_of(batch.column("text")))
            own, times = np.unique(word_keys(tokens), return_counts=True)
            keys, inverse = np.unique(np.concatenate([keys, own]), return_inverse=True)
            counts = np.bincount(inverse, weights=np.concatenate([counts, times])).astype(np.int64)
            if len(keys) > 1 << 22:
                yield from _blocks(keys, counts, parts, 0).to_batches()
                keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)
        yield from _blocks(keys, counts, parts, 0).to_batches()

    return run


def _distinct(group: pa.Table) -> pa.Table:
    keys = [np.frombuffer(x, U64) for x in group["keys"].to_pylist()]
    total = sum(int(unpacked(x, len(k)).sum()) for x, k in zip(group["counts"].to_pylist(), keys, strict=True))
    return pa.table({"tokens": [total], "words": [len(np.unique(np.concatenate(keys)))]})


def score_documents(docs: DataFrame, prior: float = 100.0, folds: int = 7, held: int = 2, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Score every document with a model of those that aren't held out; one row per input row, columns as in ``SCORES``.

    A null or empty text is just the end token. Rows without ``doc_id`` are left out. Repeated rows count and are scored each. If no
    document trains, every token is unknown. Further columns are ignored; an empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").withColumn("held_out", is_held_out(F.col("doc_id"), folds, held))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-size // chunk_bytes), min(wanted, size >> 20))
    words = docs.where("not held_out").mapInArrow(_partition_words(parts), "chunk int, part int, keys binary, counts binary").groupBy("part").applyInArrow(_distinct, "tokens long, words long")
    n, v = (x or 0 for x in words.agg(F.sum("tokens"), F.sum("words")).first())

    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).withColumn("parts", F.lit(parts)).repartition("chunk")
    asked = dealt.groupBy("chunk").applyInArrow(_ask(parts), "chunk int, part int, keys binary, counts binary")
    answers = asked.groupBy("part").applyInArrow(_answer, ANSWER)
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(n, v, prior), SCORES)
