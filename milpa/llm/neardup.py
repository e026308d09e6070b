"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find grouping.

Signatures follow SuperMinHash (Ertl, 2017): an element's value at place ``p`` is ``rank + uniform``, where ranks and places come from
one random permutation per element, so an element's values are correlated and the estimate's variance is lower than MinHash's. Level
``j`` of all elements of a document is worked at once; when every place holds a value below ``j + 1``, later levels can't lower any and
the work stops, after two or three levels for most texts.

Banding only proposes. With the production parameters (32 bands of 4) a pair at similarity 0.8 is missed with probability
(1 - 0.8^4)^32 = 5e-8. Every link is confirmed on the full sets of shingles.

No bucket is expanded into its pairs. First each member of a bucket is compared with the bucket's most central document, its middle ``m``,
only, and the confirmed links are grouped. Where documents around one middle are then still in different components, those outside the
largest component are paired with others, but only if the pair could reach the threshold: of what ``x`` and ``y`` share, at most
``min(|x & m|, |y & m|)`` is in the middle, and outside it at most the smaller number of their shingles that occur in any other
candidate. That bound is exact, so no link is lost to it, and it leaves few pairs in groups of copies that were changed independently.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milpa.llm._shared import U64, components, hashes_of, mix, slices, texts_of, words_of, written

PLACES, BANDS = 128, 32


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``width`` words; fewer words are one shingle, none none."""
    codes, words, ends = words_of(texts)
    with np.errstate(over="ignore"):
        hashed = hashes_of(words)[codes] if len(words) else np.zeros(0, U64)
        factors = mix(np.arange(1, width + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
        rolled = np.zeros(max(0, len(hashed) - width + 1), U64)
        for j in range(width):
            rolled += mix(hashed + U64(j))[j : j + len(rolled)] * factors[j]
        rolled = mix(rolled)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if b - a >= width:
                found = np.sort(rolled[a : b - width + 1])
                yield found[np.concatenate([[True], found[1:] != found[:-1]])]
            elif b > a:
                short = sum((mix(hashed[a + j] + U64(j)) * factors[j] for j in range(b - a)), U64(b - a))
                yield mix(np.array([short], U64))
            else:
                yield np.zeros(0, U64)


def super_minhash(elements: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Signature of a set of 64-bit elements: for each place the least ``rank << 25 | uniform`` over the elements."""
    n, least = len(elements), np.full(places, np.iinfo(np.uint32).max, np.uint32)
    swapped: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        for j in range(places):
            drawn = mix(elements + U64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            with_place = j + (((drawn & U64(0xFFFFFFFF)) * U64(places - j)) >> U64(32)).astype(np.int64)
            if n * places <= 1 << 16:  # few elements: many levels, so the permutations themselves are kept
                if j == 0:
                    order, rows = np.tile(np.arange(places, dtype=np.int64), (n, 1)), np.arange(n)
                place = order[rows, with_place]
                order[rows, with_place] = order[:, j]
            else:  # many elements: few levels, so the swaps made so far are traced back
                place = with_place
                for t in range(j - 1, -1, -1):
                    place = np.where(place == swapped[t], t, np.where(place == t, swapped[t], place))
                swapped.append(with_place)
            np.minimum.at(least, place, (np.uint32(j) << np.uint32(25)) | (drawn >> U64(39)).astype(np.uint32))
            if least.max() < (j + 1) << 25:
                break
    return least


def _signatures(width: int):
    def run(batches):
        salt = mix(np.arange(BANDS, dtype=U64) + U64(17))
        for batch in slices(batches, "text"):
            sizes, keys, bands = [], [], []
            for found in shingle_sets(texts_of(batch.column("text")), width):
                sizes.append(len(found))
                if len(found):
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                    values, band = super_minhash(found).reshape(BANDS, -1).astype(U64), salt
                    with np.errstate(over="ignore"):
                        for c in range(values.shape[1]):
                            band = mix(band * U64(31) + values[:, c])
                    bands.append(band.view(np.int64))
                else:
                    keys.append(None)
                    bands.append(np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in bands])]), pa.int32()), pa.array(np.concatenate([*bands, np.zeros(0, np.int64)]))),
                ],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )

    return run


def _full_sets(width: int):
    def run(batches):
        for batch in slices(batches, "text"):
            sets = list(shingle_sets(texts_of(batch.column("text")), width))
            flat = np.concatenate([*sets, np.zeros(0, U64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]), pa.int32()), pa.array(flat))],
                names=["set_key", "shingles"],
            )

    return run


def _met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """For pairs (a, b) also the sizes of what both full sets hold and of what either holds."""
    a, b = sets.selectExpr("id as a", "shingles as x"), sets.selectExpr("id as b", "shingles as y")
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("both"), (F.size("x") + F.size("y") - both).alias("any"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of ``percent`` hundredths or more of their word shingles.

    Takes ``docs(doc_id, text, ...)`` and returns one row per input row: ``doc_id, n_shingles, component_id, kept``; the component is
    named by its smallest ``doc_id`` and only that document is ``kept``. Null, empty and white-space texts have an empty set and are
    linked with nothing. Fewer words than ``width`` are one shingle. Equal sets are linked whatever their size. A ``doc_id`` that
    occurs in several rows is one document: each row has the size of its own set, all its sets are compared, and those that aren't empty
    are in one component. Rows without a ``doc_id`` are left out. An empty table gives an empty table; further columns are ignored.
    A long text is hashed whole, alone in its batch.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    signed = written(docs.mapInArrow(_signatures(width), "doc_id long, n_shingles long, set_key binary, bands array<long>"))
    filled = signed.where("set_key is not null")
    # a set is a node of its own, as documents that share a doc_id may have several
    distinct = filled.groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.max("n_shingles").alias("n"), F.min_by("bands", "doc_id").alias("bands"))
    distinct = written(distinct.withColumn("id", F.monotonically_increasing_id()))
    places = distinct.select("id", "n", F.explode("bands").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    live = written(places.join(shared, "bucket"))
    # a bucket's middle: the member whose buckets hold most members, as the minima of a group's common text are the commonest
    central = live.groupBy("id").agg(F.sum("members").alias("weight"))
    middle = live.join(central, "id").groupBy("bucket").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("m"))
    starred = written(live.join(middle, "bucket"))
    tried = starred.where("id != m").select(F.least("id", "m").alias("a"), F.greatest("id", "m").alias("b")).distinct()

    nodes = distinct.select("id", "set_key", "doc").join(live.select("id").distinct(), "id", "left_semi")
    full = docs.join(nodes.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_full_sets(width), "set_key binary, shingles array<long>")
    sets = written(full.dropDuplicates(["set_key"]).join(nodes.select("id", "set_key"), "set_key").select("id", "shingles"))
    met = written(_met(tried, sets))
    linked = f"100 * both >= {percent} * any"
    links = met.where(linked).select("a", "b")
    first = written(components(links))

    # what is left to try: documents around one middle that are in different components
    around = starred.select("m", "id", "n").distinct().join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = around.groupBy("m").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("m")
    around = written(around.join(mixed, "m", "left_semi").select("m", "id", "n", "component"))
    candidates = sets.join(around.select("id").distinct(), "id", "left_semi").select("id", F.explode("shingles").alias("shingle"))
    common = candidates.groupBy("shingle").agg(F.min("id").alias("one"), F.max("id").alias("other")).where("one < other").select("shingle")
    elsewhere = candidates.join(common, "shingle", "left_semi").groupBy("id").agg(F.count("*").alias("s"))
    with_middle = met.selectExpr("a as id", "b as m", "both").union(met.selectExpr("b as id", "a as m", "both"))
    around = around.join(elsewhere, "id").join(with_middle, ["id", "m"], "left").selectExpr("m", "id", "n", "component", "coalesce(both, n) as i", "s - coalesce(both, n) as o")
    around = written(around.where(f"{100 + percent} * (i + o) >= {percent} * (n + n * {percent} / 100)"))
    largest = around.groupBy("m", "component").count().groupBy("m").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    x, y = (around.selectExpr("m", *(f"{c} as {c}{k}" for c in ("id", "n", "component", "i", "o"))) for k in "xy")
    x = x.join(largest, "m").where("componentx != main").drop("main")
    able = f"componentx != componenty and {100 + percent} * (least(ix, iy) + least(ox, oy)) >= {percent} * (nx + ny)"
    more = x.join(y, "m").where(able).select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")).distinct().join(met, ["a", "b"], "left_anti")
    late = _met(more, sets).where(linked).select("a", "b")

    several = filled.groupBy("doc_id").agg(F.min("set_key").alias("one"), F.max("set_key").alias("other")).where("one < other").select("doc_id", "one")
    several, linking = written(several), late
    if not several.isEmpty():  # the sets of one document
        own = filled.join(several, "doc_id").where("set_key != one").select("one", "set_key").distinct()
        own = own.join(distinct.selectExpr("set_key as one", "id as a"), "one").join(distinct.selectExpr("set_key", "id as b"), "set_key").select("a", "b")
        linking = linking.union(own)

    named = distinct.select("set_key", "id", "doc").join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    # later links join whole components, so only those are grouped again
    for end in "ab":
        linking = linking.join(first.selectExpr(f"node as {end}", f"component as {end}c"), end, "left").withColumn(end, F.coalesce(f"{end}c", end)).drop(f"{end}c")
    linking = written(linking.where("a != b").distinct())
    if not linking.isEmpty():
        above = components(linking).selectExpr("node as component", "component as above")
        named = named.join(above, "component", "left").withColumn("component", F.coalesce("above", "component")).drop("above")
    least = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = named.join(least, "component").select("set_key", "component_id")
    out = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
