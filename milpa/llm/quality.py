"""Quality and toxicity by co-training: a text-content view and a page-metadata view teach each other, then score all documents.

The content view sees hashed words and binned text measures, the metadata view language, source and the stated length. In every round
each view is fitted and calibrated on the driver, scores every document on the executors, and hands the other view the pseudo-labels
it is surest of; a view whose calibrated probabilities stay moderate has none to give. In the end a small logistic model on labelled
documents kept back for calibration weighs both calibrated views.

What comes to the driver is bounded by parameters: features of ``most_labelled`` labelled documents, dealt out evenly over language and
class so that rare classes are whole, and of ``per_round`` pseudo-labels a target, view and class in each round, the surest of all
documents. Only the slots of words that tell the classes apart are sent. Everything else covers every document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from milpa.llm._shared import U64, bytes_of, hashes_of, reliable, slices, texts_of, words_of

WORD_SLOTS, BEGIN_BYTES, BINS = 1 << 16, 5, 12
MEASURES = ("words", "upper", "symbols", "digits", "word length", "distinct words", "top word", "repeated lines", "line breaks", "punctuation")
TARGETS, LABELS = ("quality", "toxic"), ("doc_id", "quality", "toxic", "weight", "held")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _kinds() -> np.ndarray:
    """Byte classes: 1 upper, 2 lower, 3 digit, 4 symbol, 5 punctuation, 6 line break, 0 other."""
    kind = np.zeros(256, np.uint8)
    for k, chars in ((1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, "abcdefghijklmnopqrstuvwxyz"), (3, "0123456789"), (4, "#$%&*+<=>@[\\]^_`{|}~!"), (5, "\"'(),-./:;?"), (6, "\n")):
        kind[list(chars.encode())] = k
    return kind


def _per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[ends[1:]] - sums[ends[:-1]]


def measures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures by text (rows as ``MEASURES``), and text and slot of every distinct word, and of every word's begin, of a text."""
    codes, words, ends = words_of(texts)
    bare = pc.ascii_trim(words, characters=PUNCTUATION)
    begin = pc.binary_slice(bare.cast(pa.large_binary()), 0, BEGIN_BYTES)
    slots, begins = ((hashes_of(x) % U64(WORD_SLOTS) + U64(k * WORD_SLOTS)).astype(np.int64) for k, x in enumerate((bare, begin)))
    data, cuts = bytes_of(texts)
    n_words, n_bytes = np.maximum(np.diff(ends), 1), np.maximum(np.diff(cuts), 1)
    kind = _kinds()[data]
    count = {k: _per_text(kind == k, cuts) for k in range(1, 7)}
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    pairs, times = np.unique(row * max(1, len(words)) + codes, return_counts=True)
    owner, word = pairs // max(1, len(words)), pairs % max(1, len(words))
    top, distinct = np.zeros(len(texts), np.int64), np.bincount(owner, minlength=len(texts))
    np.maximum.at(top, owner, times)
    lines = pc.split_pattern(texts, "\n")
    n_lines = np.diff(lines.offsets.to_numpy())
    coded = lines.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    line_row = np.repeat(np.arange(len(texts)), n_lines)
    kinds_of_lines = np.bincount(np.unique(line_row * (len(coded) + 1) + coded) // (len(coded) + 1), minlength=len(texts))
    out = np.stack(
        [
            np.log1p(np.diff(ends)),
            count[1] / np.maximum(count[1] + count[2], 1),
            count[4] / n_bytes,
            count[3] / n_bytes,
            n_bytes / n_words,
            distinct / n_words**0.8,
            top / n_words,
            1 - kinds_of_lines / np.maximum(n_lines, 1),
            count[6] / n_words,
            count[5] / n_words,
        ]
    )
    pairs = np.unique(owner * 2 * WORD_SLOTS + begins[word]) if len(words) else pairs
    return out, np.concatenate([owner, pairs // (2 * WORD_SLOTS)]), np.concatenate([slots[word], pairs % (2 * WORD_SLOTS)]) if len(words) else word


def _length_bin(n: int | None) -> int:
    return -1 if n is None or n < 0 else int(n).bit_length()


def metadata(batch: pa.RecordBatch) -> list[list[str]]:
    columns = [batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")]
    return [[f"lang={a}", f"source={b}", f"length={_length_bin(c)}"] for a, b, c in zip(*columns, strict=True)]


def _sample_features(batches):
    for batch in slices(batches, "text"):
        m, owner, slot = measures(texts_of(batch.column("text")))
        order = np.argsort(owner, kind="stable")
        slot, cuts = slot[order], np.searchsorted(owner[order], np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in LABELS),
                pa.array(m.T.tolist(), pa.list_(pa.float64())),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(slot, pa.int32())),
                pa.array(metadata(batch), pa.list_(pa.string())),
            ],
            names=[*LABELS, "measures", "slots", "meta"],
        )


@dataclass
class Rows:
    """Rows of 0/1 features: for row ``i`` those in ``items[cuts[i]:cuts[i + 1]]``."""

    items: np.ndarray
    cuts: np.ndarray

    @classmethod
    def of(cls, lists: list[np.ndarray]) -> Rows:
        return cls(np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int32), np.cumsum([0] + [len(x) for x in lists]))

    @classmethod
    def from_arrow(cls, lists: pa.ChunkedArray | pa.Array) -> Rows:
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        cuts = lists.offsets.to_numpy().astype(np.int64)
        return cls(lists.flatten().to_numpy().astype(np.int32), cuts - cuts[0])

    def times(self, weights: np.ndarray) -> np.ndarray:
        return _per_text(weights[self.items], self.cuts)

    def take(self, rows: np.ndarray) -> Rows:
        sizes = (self.cuts[1:] - self.cuts[:-1])[rows]
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        return Rows(self.items[np.repeat(self.cuts[rows] - cuts[:-1], sizes) + np.arange(cuts[-1])], cuts)

    def then(self, other: Rows) -> Rows:
        return Rows(np.concatenate([self.items, other.items]), np.concatenate([self.cuts, self.cuts[-1] + other.cuts[1:]]))


def telling(held: np.ndarray, holders: np.ndarray, n: int, least: float = 4.5) -> np.ndarray:
    """Features whose shares in both classes differ by ``least`` standard errors; the many others only add noise to long texts.

    ``held`` counts documents with the feature, ``holders`` those among them of class 1; class 1 has ``n[1]`` documents, class 0 ``n[0]``.
    """
    share = np.stack([held - holders, holders])
    p = np.clip(held / max(1, sum(n)), 1e-9, 1 - 1e-9)
    return np.abs(share[0] / max(1, n[0]) - share[1] / max(1, n[1])) >= least * np.sqrt(p * (1 - p) * (1 / max(1, n[0]) + 1 / max(1, n[1])))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: Rows, target: np.ndarray, size: int, steps: int = 160, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression by Adam on the whole sample; the last weight is the bias."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    row = np.repeat(np.arange(len(target)), np.diff(rows.cuts))
    for t in range(1, steps + 1):
        error = (_sigmoid(rows.times(w) + w[-1]) - target) / max(1, len(target))
        g = np.append(np.bincount(rows.items, weights=error[row], minlength=size), error.sum()) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def calibrate(scores: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = 40) -> np.ndarray:
    """Platt scaling of one or more score columns by Newton's method, with a small ridge; ``weight`` undoes how rows were drawn."""
    x = np.column_stack([scores, np.ones(len(target))])
    w = np.zeros(x.shape[1])
    goal = np.where(target > 0, (target.sum() + 1) / (target.sum() + 2), 1 / (len(target) - target.sum() + 2))
    for _ in range(steps):
        p = _sigmoid(x @ w)
        h = x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (weight * (p - goal)) + 1e-3 * w)
    return w


@dataclass
class View:
    """One view's classifier of one target: a weight a feature and the bias, and how its scores become probabilities."""

    weights: np.ndarray
    scale: np.ndarray

    def logit(self, rows: Rows) -> np.ndarray:
        return (rows.times(self.weights) + self.weights[-1]) * self.scale[0] + self.scale[1]


@dataclass
class Lessons:
    """What one target's views learn from: labelled rows of both views, which of them calibrate, and pseudo-labelled rows by view."""

    rows: tuple[Rows, Rows]
    target: np.ndarray
    weight: np.ndarray
    held: np.ndarray
    sizes: tuple[int, int]
    taught: list[Rows | None] = field(default_factory=lambda: [None, None])
    goals: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0), np.zeros(0)])
    told: list[set[int]] = field(default_factory=lambda: [set(), set()])

    def fitted(self, k: int) -> View:
        learn, held = np.flatnonzero(~self.held), np.flatnonzero(self.held)
        rows, goal = self.rows[k].take(learn), self.target[learn]
        if self.taught[k] is not None:
            rows, goal = rows.then(self.taught[k]), np.concatenate([goal, self.goals[k]])
        w = fit(rows, goal, self.sizes[k])
        back = self.rows[k].take(held)
        return View(w, calibrate(back.times(w) + w[-1], self.target[held], self.weight[held]))

    def teach(self, k: int, keys: np.ndarray, rows: Rows, goal: float) -> int:
        """Give view ``k`` documents that the other view is sure of; those it was told of before stay as they are."""
        new = np.array([i for i, x in enumerate(keys.tolist()) if x not in self.told[k]], np.int64)
        self.told[k].update(keys[new].tolist())
        rows = rows.take(new)
        self.taught[k] = rows if self.taught[k] is None else self.taught[k].then(rows)
        self.goals[k] = np.concatenate([self.goals[k], np.full(len(new), goal)])
        return len(new)

    def blended(self, views: tuple[View, View]) -> np.ndarray:
        held = np.flatnonzero(self.held)
        return calibrate(np.column_stack([v.logit(r.take(held)) for v, r in zip(views, self.rows, strict=True)]), self.target[held], self.weight[held])


@dataclass
class QualityModel:
    """What the executors need: how features are made, both views of both targets, and in the end how they combine."""

    edges: np.ndarray  # by measure, the inner edges of its bins
    place: np.ndarray  # by slot, its number among those that tell the classes apart, or -1
    meta_of: dict[str, int]
    views: dict[str, tuple[View, View]] = field(default_factory=dict)
    blend: dict[str, np.ndarray] = field(default_factory=dict)
    taught: dict[str, list[tuple[int, int]]] = field(default_factory=dict)

    @property
    def sizes(self) -> tuple[int, int]:
        return int(self.place.max(initial=-1)) + 1 + len(MEASURES) * BINS, len(self.meta_of)

    def content_rows(self, m: np.ndarray, owner: np.ndarray, slot: np.ndarray) -> Rows:
        n, first = m.shape[1], self.sizes[0] - len(MEASURES) * BINS
        known = self.place[slot]
        owner, known = owner[known >= 0], known[known >= 0]
        bins = [first + i * BINS + np.searchsorted(self.edges[i], m[i], "left") for i in range(len(m))]
        row = np.concatenate([owner, np.tile(np.arange(n), len(m))])
        order = np.argsort(row, kind="stable")
        return Rows(np.concatenate([known, *bins])[order].astype(np.int32), np.searchsorted(row[order], np.arange(n + 1)))

    def meta_rows(self, meta: list[list[str]]) -> Rows:
        return Rows.of([np.array([self.meta_of[x] for x in row if x in self.meta_of], np.int32) for row in meta])

    def features(self, batch: pa.RecordBatch) -> tuple[Rows, Rows]:
        return self.content_rows(*measures(texts_of(batch.column("text")))), self.meta_rows(metadata(batch))

    def probability(self, name: str, rows: tuple[Rows, Rows]) -> np.ndarray:
        a, b = (v.logit(r) for v, r in zip(self.views[name], rows, strict=True))
        return _sigmoid(np.column_stack([a, b, np.ones(len(a))]) @ self.blend[name])

    def score(self, batches):
        for batch in slices(batches, "text"):
            rows = self.features(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(self.probability(x, rows)) for x in TARGETS)], names=["doc_id", "quality_score", "toxic_score"])

    def accepting(self, quality_at: float, toxic_at: float):
        def run(batches):
            for batch in slices(batches, "text"):
                rows = self.features(batch)
                good = (self.probability("quality", rows) >= quality_at) & (self.probability("toxic", rows) < toxic_at)
                yield batch.filter(pa.array(good))

        return run

    def surest(self, sure: float, most: int, labelled: np.ndarray, told: dict[str, list[np.ndarray]]):
        """By target, view and class, the ``most`` surest different texts of a partition, with their features.

        Those ``labelled``, by ``doc_id``, and those that the other view was ``told`` of, by ``text_key``, are past teaching.
        """

        def best(held: list[tuple]) -> list[tuple]:
            by_key = {}
            for x in sorted(held, key=lambda x: (-x[0], x[1], x[2])):
                by_key.setdefault(x[1], x)
            return list(by_key.values())[:most]

        def run(batches):
            held: dict[int, list[tuple]] = {}
            for batch in slices(batches, "text"):
                rows, keys, doc_ids = self.features(batch), batch.column("text_key").to_numpy(), batch.column("doc_id").to_numpy()
                open_ = ~np.isin(doc_ids, labelled)
                for t, name in enumerate(TARGETS):
                    for k in (0, 1):
                        new = open_ & ~np.isin(keys, told[name][1 - k])
                        p = _sigmoid(self.views[name][k].logit(rows[k]))
                        for yes in (0, 1):
                            q = p if yes else 1 - p
                            found = np.flatnonzero(new & (q >= sure))
                            if len(found) > most:  # copies weigh once
                                found = found[np.unique(keys[found], return_index=True)[1]]
                                found = found[np.argsort(-q[found], kind="stable")[:most]]
                            own = held.setdefault(4 * t + 2 * k + yes, [])
                            own += [(float(q[i]), int(keys[i]), int(doc_ids[i]), *(r.items[r.cuts[i] : r.cuts[i + 1]].tolist() for r in rows)) for i in found]
                            if len(own) > 4 * most:
                                own[:] = best(own)
            out = [(which, *x) for which, own in held.items() for x in best(own)]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], kind) for j, kind in enumerate((pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))], names=["which", "q", "text_key", "doc_id", "content", "meta"])

        return run


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text", "lang", "source", F.col("n_chars").cast("long")).where("doc_id is not null")


def labelled_sample(docs: DataFrame, labels: DataFrame, most_labelled: int) -> DataFrame:
    """``doc_id, quality, toxic, weight`` of at most ``most_labelled`` documents: strata of language and classes take turns, by hash.

    ``weight`` is how many labelled documents of its stratum a row stands for. Where a document has several labels, the worse counts.
    """
    labels = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    langs = docs.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    strata = labels.join(langs, "doc_id").select("doc_id", "quality", "toxic", F.to_json(F.struct("lang", "quality", "toxic")).alias("stratum"))
    drawn = strata.withColumn("turn", F.row_number().over(Window.partitionBy("stratum").orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("turn") <= most_labelled)
    drawn = drawn.orderBy("turn", F.xxhash64("doc_id"), "doc_id").limit(most_labelled).select("doc_id", "quality", "toxic", "stratum")
    taken = drawn.groupBy("stratum").agg(F.count("*").alias("taken"))
    shares = strata.groupBy("stratum").count().join(taken, "stratum").select("stratum", (F.col("count") / F.col("taken")).alias("weight"))
    return drawn.join(shares, "stratum").drop("stratum")


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 8000, rounds: int = 2, per_round: int = 400, sure: float = 0.97) -> QualityModel | None:
    """Co-train both views; None without labels. Every round scores all documents that aren't in the labelled sample."""
    docs = _columns(docs)
    some = reliable(labelled_sample(docs, labels, most_labelled))
    one = docs.join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality", "toxic", "weight").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("d"))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0
    made = reliable(one.select("doc_id", "quality", "toxic", "weight", held.alias("held"), "d.*").mapInArrow(_sample_features, "doc_id long, quality int, toxic int, weight double, held boolean, measures array<double>, slots array<int>, meta array<string>"))
    n, good, bad = made.where("not held").agg(F.count("*"), F.sum("quality"), F.sum("toxic")).first()
    if not n:
        return None
    # at most one row a slot
    counts = made.where("not held").select("quality", "toxic", F.explode("slots").alias("slot")).groupBy("slot").agg(F.count("*").alias("n"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic")).toArrow()
    slot, times = counts["slot"].to_numpy(), counts["n"].to_numpy()
    chosen = (times >= max(3, n // 400)) & (telling(times, counts["quality"].to_numpy(), (n - good, good)) | telling(times, counts["toxic"].to_numpy(), (n - bad, bad)))
    place = np.full(2 * WORD_SLOTS, -1, np.int32)
    place[np.sort(slot[chosen])] = np.arange(chosen.sum())

    def chosen_slots(batches):
        for batch in batches:
            rows = Rows.from_arrow(batch.column("slots"))
            known = place[rows.items]
            cuts = np.concatenate([[0], np.cumsum(known >= 0)])[rows.cuts]
            yield batch.set_column(batch.schema.get_field_index("slots"), "slots", pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(rows.items[known >= 0], pa.int32())))

    found = made.mapInArrow(chosen_slots, made.schema).toArrow().sort_by("doc_id")
    slots, doc_ids = Rows.from_arrow(found["slots"]), found["doc_id"].to_numpy()
    m = found["measures"].combine_chunks().flatten().to_numpy().reshape(-1, len(MEASURES)).T
    meta = found["meta"].to_pylist()
    model = QualityModel(np.array([np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1]) for x in m]), place, {x: i for i, x in enumerate(sorted({x for row in meta for x in row}))})
    rows = model.content_rows(m, np.repeat(np.arange(len(doc_ids)), np.diff(slots.cuts)), slots.items), model.meta_rows(meta)
    weight = found["weight"].to_numpy()
    held = found["held"].to_numpy()
    lessons = {x: Lessons(rows, found[x].to_numpy().astype(float), weight * (len(weight) / weight.sum()), held, model.sizes) for x in TARGETS}
    del found, slots, meta
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    in_bin = Window.partitionBy("which", F.pmod("text_key", F.lit(64))).orderBy("minus_q", "text_key")
    by_surest = Window.partitionBy("which").orderBy("minus_q", "text_key")  # over what 64 bins have left
    for _ in range(rounds):
        model.views = {x: (y.fitted(0), y.fitted(1)) for x, y in lessons.items()}
        told = {x: [np.array(sorted(z), np.int64) for z in y.told] for x, y in lessons.items()}
        seen = keyed.mapInArrow(model.surest(sure, per_round, doc_ids, told), "which int, q double, text_key long, doc_id long, content array<int>, meta array<int>")
        different = seen.groupBy("which", "text_key").agg(F.min(F.struct((-F.col("q")).alias("minus_q"), "doc_id", "content", "meta")).alias("s")).select("which", "text_key", "s.*")
        different = different.withColumn("nth", F.row_number().over(in_bin)).where(F.col("nth") <= per_round)
        picks = different.withColumn("nth", F.row_number().over(by_surest)).where(F.col("nth") <= per_round).toArrow().sort_by([("which", "ascending"), ("nth", "ascending")])
        which, keys, pick_rows = picks["which"].to_numpy(), picks["text_key"].to_numpy(), (Rows.from_arrow(picks["content"]), Rows.from_arrow(picks["meta"]))
        new = 0
        for t, name in enumerate(TARGETS):
            count = []
            for k in (0, 1):  # view k teaches the other
                own = [np.flatnonzero(which == 4 * t + 2 * k + yes) for yes in (0, 1)]
                count.append(sum(lessons[name].teach(1 - k, keys[x], pick_rows[1 - k].take(x), float(yes)) for yes, x in enumerate(own)))
            model.taught.setdefault(name, []).append((count[0], count[1]))
            new += sum(count)
        if not new:
            break
    model.views = {x: (y.fitted(0), y.fitted(1)) for x, y in lessons.items()}
    model.blend = {x: y.blended(model.views[x]) for x, y in lessons.items()}
    return model


def score_quality(docs: DataFrame, labels: DataFrame, most_labelled: int = 8000, quality_at: float = 0.4, toxic_at: float = 0.4) -> DataFrame:
    """Per row of ``docs(doc_id, text, lang, source, n_chars, ...)``: ``doc_id, quality_score, toxic_score, kept``.

    ``kept`` is true where quality reaches ``quality_at`` and toxicity stays below ``toxic_at``; a score equal to a threshold reaches it.
    Null texts count as empty, null metadata as a value of its own; values not seen in training say nothing. Rows without ``doc_id`` are
    left out; rows that repeat are scored each and teach once. A text of any length is scored whole, alone in its batch. Without any
    usable label every document is kept and its scores are null. Further columns are ignored; an empty table gives an empty table.
    """
    model = train(docs, labels, most_labelled)
    docs = _columns(docs)
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("quality_score"), F.lit(None).cast("double").alias("toxic_score"), F.lit(True).alias("kept"))
    scored = docs.mapInArrow(model.score, "doc_id long, quality_score double, toxic_score double")
    return scored.withColumn("kept", (F.col("quality_score") >= quality_at) & (F.col("toxic_score") < toxic_at))


def accepted(docs: DataFrame, labels: DataFrame, most_labelled: int = 8000, quality_at: float = 0.4, toxic_at: float = 0.4) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`score_quality` would keep; decided where they are, without a shuffle.

    Rows without ``doc_id`` are judged like any other here.
    """
    model = train(docs, labels, most_labelled)
    return docs if model is None else docs.mapInArrow(model.accepting(quality_at, toxic_at), docs.schema)
