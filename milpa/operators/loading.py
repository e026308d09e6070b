"""Tables on disk that change all at once or not at all, and keyed updates that leave untouched files alone."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from milpa.storage import written


class Store:
    """A folder of tables with numbered manifests. What the last manifest names is there, nothing else.

    A load writes its rows into folders of their own, reads them back against the count and hash of what it was given, and then makes the next
    manifest by a rename that fails if that number is taken. Until then nobody sees a row of it, and a load that lost the
    race or broke off has changed nothing. Manifests name the loads that went in, so the same load again does nothing.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.jvm = spark, folder, spark._jvm
        self._path = lambda name: self.jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """``version``, ``tables`` (name to folders) and ``loads`` (id to rows and hash by table) as they are now."""
        if not self._files.exists(self._path("manifests")):
            return {"version": 0, "tables": {}, "loads": {}}
        names = [f.getPath().getName() for f in self._files.listStatus(self._path("manifests"))]
        last = max((n for n in names if n.startswith("m-") and n.endswith(".json")), default=None)
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.folder}/manifests/{last}", wholetext=True).collect())) if last else {"version": 0, "tables": {}, "loads": {}}

    def table(self, name: str) -> DataFrame | None:
        folders = self.manifest()["tables"].get(name)
        return self.spark.read.parquet(*(f"{self.folder}/{f}" for f in folders)) if folders else None

    def commit(self, load: str, changes: Mapping[str, tuple[str, DataFrame]], fail: Callable[[str], None] = lambda step: None) -> bool:
        """All ``changes`` (table name to ``("append" | "replace", rows)``) or none; False if ``load`` went in before. ``fail`` is for tests: it is
        called at each step and may raise."""
        now = self.manifest()
        if load in now["loads"]:
            return False
        tables, sums = dict(now["tables"]), {}
        for name, (how, rows) in changes.items():
            if how not in ("append", "replace"):
                raise ValueError(f"{how!r} is neither append nor replace")
            staged = f"data/{name}/{uuid.uuid4().hex}"
            rows = written(rows)  # given once: what is checked is what is stored
            rows.write.parquet(f"{self.folder}/{staged}")
            fail("staged")
            sums[name] = fingerprint(rows)
            if fingerprint(self.spark.read.parquet(f"{self.folder}/{staged}")) != sums[name]:
                raise ValueError(f"{name}: what was stored isn't what was given")
            tables[name] = ([*tables.get(name, []), staged]) if how == "append" else [staged]
        self._swap({"version": now["version"] + 1, "tables": tables, "loads": now["loads"] | {load: sums}}, fail)
        return True

    def _swap(self, manifest: dict, fail: Callable[[str], None]) -> None:
        self._files.mkdirs(self._path("manifests"))
        draft = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fail("drafted")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.isUriPathAbsolute() and draft.toUri().getScheme() else self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        never_over = self.spark.sparkContext._gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(draft, self._path(f"manifests/m-{manifest['version']:012d}.json"), never_over)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise RuntimeError("another load came first; nothing was changed") from e
            raise
        fail("swapped")


def fingerprint(df: DataFrame) -> list:
    """Rows, and the sum of their hashes, which no order or partitioning changes."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns))).cast("decimal(38,0)")).alias("h")).first()
    return [row["n"], str(row["h"] or 0)]


def guarded_load(store: Store, chunks: DataFrame, doc_key: int, expected: int, load: str, fail: Callable[[str], None] = lambda step: None) -> bool:
    """L11 on disk: the chunks of one document into ``chunks``, and its ``total_chunks`` and ``incluido_rag`` in ``documents``, both or neither.

    An error, and no change, if the count isn't ``expected``, the document isn't there exactly once, or has chunks already. The same ``load`` again
    changes nothing and is no error: False comes back.
    """
    if load in store.manifest()["loads"]:
        return False
    docs, held = store.table("documents"), store.table("chunks")
    n, d = chunks.count(), docs.where(F.col("id_documento") == doc_key).count() if docs is not None else 0
    there = held.where(F.col("id_documento") == doc_key).count() if held is not None else 0
    if n != expected or d != 1 or there:
        raise ValueError(f"not loaded: {n} chunks (expected {expected}), document found {d} times, {there} chunks there already")
    mine = F.col("id_documento") == doc_key
    kind = dict(docs.dtypes)
    updated = docs.withColumns({"total_chunks": F.when(mine, F.lit(expected).cast(kind["total_chunks"])).otherwise(F.col("total_chunks")), "incluido_rag": F.when(mine, F.lit(True)).otherwise(F.col("incluido_rag"))})
    rows = chunks.drop("id_documento").withColumn("id_documento", F.lit(doc_key).cast(kind["id_documento"]))
    if held is not None:
        rows = rows.select(*(F.col(c).cast(t).alias(c) for c, t in held.dtypes))
    return store.commit(load, {"chunks": ("append", rows), "documents": ("replace", updated)}, fail)


# ---- keyed tables -------------------------------------------------------------------------------------------------------------
def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.expr(f"cast(pmod(xxhash64({', '.join(f'`{k}`' for k in keys)}), {buckets}) as int)")


def create_keyed(df: DataFrame, folder: str, keys: Sequence[str], buckets: int = 64) -> None:
    """``df`` as a table of ``buckets`` folders by a hash of its keys, for :func:`merge_keyed`. Repeated keys are refused, nulls count as equal."""
    _refuse_repeats(df, keys)
    df.withColumn("_bucket", _bucket(keys, buckets)).repartition("_bucket").sortWithinPartitions("_bucket").write.partitionBy("_bucket").parquet(folder)


def read_keyed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop("_bucket")


def _refuse_repeats(df: DataFrame, keys: Sequence[str]) -> None:
    twice = df.groupBy(*keys).count().where("count > 1").select(*keys).limit(3).collect()
    if twice:
        raise ValueError(f"repeated keys, as {[tuple(r) for r in twice]}")


def merge_keyed(spark: SparkSession, folder: str, updates: DataFrame, keys: Sequence[str], buckets: int = 64, insert: bool = False, overwrite_nulls: bool = False) -> DataFrame:
    """E3, L12 on disk: rows of the table whose keys are in ``updates`` take its other columns, where they aren't null (or all, with ``overwrite_nulls``).

    Only folders in which a value changes are written again; all other files stay byte for byte. Keys that the table doesn't have come back,
    and with ``insert`` go in. Keys that repeat in ``updates`` are refused before anything is written; nulls among keys are equal. ``buckets``
    must be that of :func:`create_keyed`. The folders to come are written aside first, so a run that breaks off can be run again.
    """
    updates = written(updates)
    _refuse_repeats(updates, keys)
    table = spark.read.parquet(folder)
    columns, given = [c for c in table.columns if c != "_bucket"], [c for c in updates.columns if c not in keys]
    if unknown := set(given) - set(columns):
        raise ValueError(f"the table has no {sorted(unknown)}")
    new = updates.select(*(F.col(c).alias(f"_new_{c}") for c in updates.columns)).withColumns({"_there": F.lit(True), "_to": _bucket([f"_new_{k}" for k in keys], buckets)})
    match = reduce(Column.__and__, [F.col("_bucket") == F.col("_to"), *(F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys)])
    value = {c: F.col(f"_new_{c}") if overwrite_nulls else F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in given}
    differs = reduce(Column.__or__, [~F.col(c).eqNullSafe(v.cast(table.schema[c].dataType)) for c, v in value.items()], F.lit(False))
    asked = [r[0] for r in new.select("_to").distinct().collect()]  # at most ``buckets`` numbers
    near = table.where(F.col("_bucket").isin(asked))
    changed = {r[0] for r in near.join(new, match).where(differs).select("_bucket").distinct().collect()}
    missing = new.join(near, match, "left_anti")
    absent = written(missing.select(*(F.col(f"_new_{c}").alias(c) for c in updates.columns)))
    if insert:
        changed |= {r[0] for r in missing.select("_to").distinct().collect()}
    if changed:
        mine = table.where(F.col("_bucket").isin(sorted(changed)))
        out = mine.join(new, match, "left").select(*((F.when(F.col("_there"), value[c].cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c)) if c in value else F.col(c) for c in columns), "_bucket")
        if insert:
            out = out.unionByName(absent.select(*(F.col(c).cast(table.schema[c].dataType).alias(c) for c in absent.columns), _bucket(keys, buckets).alias("_bucket")), allowMissingColumns=True)
        aside = written(out)
        aside.repartition("_bucket").sortWithinPartitions("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(folder)
    return absent


def store_vectors_in(spark: SparkSession, folder: str, vectors: DataFrame, model: str, key: str = "id_fragmento", buckets: int = 64) -> DataFrame:
    """E3 on disk: new vectors, their model and the time into a keyed table of chunks; vectors of unknown chunks come back."""
    new = vectors.where("embedding is not null").select(key, "embedding", F.lit(model).alias("modelo_embedding"), F.current_timestamp().alias("fecha_embedding"))
    return merge_keyed(spark, folder, new, [key], buckets).select(key, "embedding")
