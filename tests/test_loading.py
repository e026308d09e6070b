"""Loads that happen whole or not at all, keyed updates on disk, and a database."""

import hashlib
from pathlib import Path

import pytest

from milpa.operators import loading, posts, review, documents, warehouse
from milpa.sources import readers, writers


def files(folder):
    return {str(p.relative_to(folder)): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(folder).rglob("*.parquet")}


@pytest.fixture()
def store(spark, tmp_path):
    s = loading.Store(spark, str(tmp_path / "warehouse"))
    docs = spark.createDataFrame([(1, "a", 0, False), (2, "b", 5, True)], "id_documento int, nombre string, total_chunks int, incluido_rag boolean")
    assert s.commit("first", {"documents": ("replace", docs)})
    return s


def broken(at):
    def fail(step):
        if step == at:
            raise OSError(f"broken after {step}")

    return fail


def state(store):
    chunks = store.table("chunks")
    return sorted(map(tuple, store.table("documents").collect())), sorted(map(tuple, chunks.collect())) if chunks is not None else []


def test_load_is_whole_and_happens_once(spark, store):
    chunks = spark.createDataFrame([(1, "x"), (2, "y")], "chunk_id int, texto string")
    before = state(store)
    for at in ("staged", "drafted"):
        with pytest.raises(OSError):
            loading.guarded_load(store, chunks, 1, 2, "load", broken(at))
        assert state(store) == before and store.manifest()["version"] == 1
    with pytest.raises(OSError):  # the swap is done: the load counts, whatever happened to its driver
        loading.guarded_load(store, chunks, 1, 2, "load", broken("swapped"))
    after = [(1, "a", 2, True), (2, "b", 5, True)], [(1, "x", 1), (2, "y", 1)]
    assert state(store) == after
    assert loading.guarded_load(store, chunks, 1, 2, "load") is False and state(store) == after
    assert store.manifest()["loads"]["load"]["chunks"][0] == 2


@pytest.mark.parametrize(("key", "expected"), [(1, 3), (9, 2)])
def test_load_is_refused(spark, store, key, expected):
    before = state(store)
    with pytest.raises(ValueError):
        loading.guarded_load(store, spark.createDataFrame([(1, "x"), (2, "y")], "chunk_id int, texto string"), key, expected, "load")
    assert state(store) == before


def test_chunks_are_not_loaded_twice_under_another_name(spark, store):
    chunks = spark.createDataFrame([(1, "x")], "chunk_id int, texto string")
    assert loading.guarded_load(store, chunks, 1, 1, "load")
    with pytest.raises(ValueError):
        loading.guarded_load(store, chunks, 1, 1, "again")


def test_of_two_loads_at_once_one_wins(spark, store, tmp_path):
    rival = loading.Store(spark, store.folder)
    one = spark.createDataFrame([(3, "c", 0, False)], "id_documento int, nombre string, total_chunks int, incluido_rag boolean")

    def meanwhile(step):
        if step == "drafted":
            rival.commit("rival", {"documents": ("append", one)})

    with pytest.raises(RuntimeError, match="came first"):
        store.commit("mine", {"documents": ("replace", one)}, meanwhile)
    assert [r[0] for r in store.table("documents").sort("id_documento").collect()] == [1, 2, 3] and "mine" not in store.manifest()["loads"]


def test_merge_leaves_other_files_alone(spark, tmp_path):
    folder, rows = str(tmp_path / "chunks"), [(i, f"t{i}", None) for i in range(200)] + [(None, "no key", None)]
    loading.create_keyed(spark.createDataFrame(rows, "id long, texto string, url string"), folder, ["id"], 16)
    before = files(folder)
    missing = loading.merge_keyed(spark, folder, spark.createDataFrame([(7, "u7", None), (None, "un", "new"), (999, "x", "y")], "id long, url string, texto string"), ["id"], 16)
    assert [tuple(r) for r in missing.collect()] == [(999, "x", "y")]
    after = files(folder)
    folders = lambda f: {p.split("/")[0] for p in f}
    assert len(folders({p: 0 for p in before if after.get(p) != before[p]})) <= 2 and folders(before) == folders(after)
    got = {r["id"]: (r["texto"], r["url"]) for r in loading.read_keyed(spark, folder).collect()}
    assert len(got) == 201 and got[7] == ("t7", "u7") and got[None] == ("new", "un") and got[8] == ("t8", None)
    same = files(folder)
    loading.merge_keyed(spark, folder, spark.createDataFrame([(7, "u7")], "id long, url string"), ["id"], 16)  # nothing changes
    assert files(folder) == same
    loading.merge_keyed(spark, folder, spark.createDataFrame([(999, "x")], "id long, texto string"), ["id"], 16, insert=True)
    assert loading.read_keyed(spark, folder).where("id = 999 and texto = 'x' and url is null").count() == 1


def test_merge_refuses_repeated_keys(spark, tmp_path):
    folder = str(tmp_path / "t")
    loading.create_keyed(spark.range(10).selectExpr("id", "'a' as v"), folder, ["id"], 4)
    before = files(folder)
    with pytest.raises(ValueError, match="repeated"):
        loading.merge_keyed(spark, folder, spark.createDataFrame([(1, "x"), (1, "y")], "id long, v string"), ["id"], 4)
    with pytest.raises(ValueError, match="no "):
        loading.merge_keyed(spark, folder, spark.createDataFrame([(1, "x")], "id long, other string"), ["id"], 4)
    assert files(folder) == before


def test_vectors_in_a_keyed_table(spark, tmp_path):
    folder = str(tmp_path / "v")
    loading.create_keyed(spark.createDataFrame([(i, None, None, None) for i in range(20)], "id_fragmento long, embedding array<float>, modelo_embedding string, fecha_embedding timestamp"), folder, ["id_fragmento"], 8)
    unknown = loading.store_vectors_in(spark, folder, spark.createDataFrame([(3, [1.0]), (77, [2.0])], "id_fragmento long, embedding array<float>"), "m", buckets=8)
    assert [r["id_fragmento"] for r in unknown.collect()] == [77]
    got = loading.read_keyed(spark, folder).where("embedding is not null").collect()
    assert [(r["id_fragmento"], r["embedding"], r["modelo_embedding"], r["fecha_embedding"] is not None) for r in got] == [(3, [1.0], "m", True)]


def test_database_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(1000).selectExpr("cast(id * 7 as int) as k", "concat('t', id) as v")
    writers.relational(rows, url, "facts", "overwrite")
    back = readers.relational(spark, url, "facts", key="k", parts=5)
    assert back.rdd.getNumPartitions() == 5 and sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    writers.relational_swapped(rows.where("k < 70"), url, "facts")
    assert readers.relational(spark, url, "facts").count() == 10
    with pytest.raises(Exception):  # noqa: B017  a column that the table doesn't have: nothing changes
        writers.relational_swapped(rows.withColumnRenamed("v", "w"), url, "facts")
    assert readers.relational(spark, url, "facts", key="k").count() == 10
    writers.relational_swapped(rows.where("false"), url, "facts")
    assert readers.relational(spark, url, "facts", key="k").count() == 0


def test_many_small_csv_files(spark, tmp_path):
    for i in range(300):
        body = f'entidad,anio,nota\n"Méx, {i}",{2000 + i % 20},"a ""b""\nsecond line"\nshort\n,,\nx,bad,,extra\n'
        (tmp_path / f"f {i}.csv").write_bytes(body.encode("latin-1" if i % 2 else "utf-8-sig"))
    df = readers.csv(spark, str(tmp_path), "anio int, entidad string, nota string, none string")
    assert df.columns == ["anio", "entidad", "nota", "none", "archivo_origen"] and df.count() == 1200
    got = {tuple(r) for r in df.where("archivo_origen in ('f 8.csv', 'f 9.csv')").collect()}
    assert got == {row for i in (8, 9) for row in ((2000 + i, f"Méx, {i}", 'a "b"\nsecond line', None, f"f {i}.csv"), (None, "short", None, None, f"f {i}.csv"), (None, None, None, None, f"f {i}.csv"), (None, "x", None, None, f"f {i}.csv"))}
    (tmp_path / "wide.csv").write_text("entidad,otra\na,b\n")
    assert readers.csv(spark, str(tmp_path)).columns == ["entidad", "anio", "nota", "otra", "archivo_origen"]


# ---- nulls --------------------------------------------------------------------------------------------------------------------
CHUNKS = "documento string, chunk_id long, pagina int, texto string"


def test_chunks_without_text_or_document_stay(spark):
    long = "y" * 200
    df = spark.createDataFrame([("d", 1, 1, None), ("d", 2, 1, None), (None, 3, 1, long), (None, 4, 1, long), ("d", None, 1, long), ("d", 6, 1, long)], CHUNKS)
    got = {r["chunk_id"]: r["is_duplicate"] for r in review.duplicates(df).collect()}
    assert got == {1: False, 2: False, 3: False, 4: True, None: False, 6: False}
    assert review.corpus_totals(df).first()["chunks"] == 6
    per = {(r["documento"], r["total"]): (r["chunks"], r["problems"]) for r in review.strong_problems(df).collect()}
    assert per == {("d", False): (4, 0), (None, False): (2, 1), (None, True): (6, 1)}


def test_scrub_statistics_of_null_documents(spark):
    df = spark.createDataFrame([(None, 1, 1, "DIARIO OFICIAL\nuno"), ("d", 1, 1, "DIARIO OFICIAL"), ("d", 2, 1, None), ("d", None, 1, "x")], CHUNKS)
    got = {(r["documento"], r["total"]): (r["chunks_in"], r["chunks_out"], r["modified"], r["emptied"]) for r in documents.scrub_stats(df, documents.scrub(df)).collect()}
    assert got == {(None, False): (1, 1, 1, 0), ("d", False): (3, 1, 0, 2), (None, True): (4, 2, 1, 2)}


def test_numbering_of_null_documents_and_pages(spark):
    df = spark.createDataFrame([(None, None, 9, 0, "x" * 100), (None, 0, 8, 0, "y" * 100), ("d", None, 8, 0, "z" * 100)], "documento string, pos int, pagina int, chunk_pos int, texto string")
    assert {(r["documento"], r["chunk_id"], r["texto"][0]) for r in documents.number_chunks(df).collect()} == {(None, 1, "x"), (None, 2, "y"), ("d", 1, "z")}


def test_first_rows_of_null_ordinals(spark):
    df = spark.createDataFrame([("k", None, "a"), ("l", None, "b"), ("l", 3, "c"), ("m", 1, "d"), ("m", 1, "e")], "k string, o int, v string")
    got = [{r["k"]: r["v"] for r in posts.dedupe_first(df.repartition(n), ["k"], "o").collect()} for n in (1, 3)]
    assert got[0] == got[1] and (got[0]["k"], got[0]["l"]) == ("a", "c")


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_keys_do_not_rest_on_exchange_reuse(spark, adaptive):
    try:
        spark.conf.set("spark.sql.exchange.reuse", "false")
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        names = spark.range(60_000).selectExpr("concat('n', id) as nombre").repartition(9)
        out, _ = warehouse.get_or_create(spark.createDataFrame([(4, "old")], "id long, nombre string"), names, ["nombre"], "id")
        row = out.selectExpr("count(*) as n", "count(distinct id) as d", "min(id) as lo", "max(id) as hi").first()
        assert tuple(row) == (60_001, 60_001, 4, 60_004)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_reasons_of_the_caller_stay(spark):
    _, bad = warehouse.enforce(spark.createDataFrame([("x", "mine")], "n string, reasons string"), "n int")
    assert tuple(bad.first()) == ("x", "mine", ["n: type"])


def test_dates_as_they_are_written(spark):
    from pyspark.sql import functions as F

    from milpa.functions import text

    given = {"2021-03-05": "2021-03-05", "2021-3-5": "2021-03-05", "2021/03/05": "2021-03-05", " 2021-03-05 10:20 ": "2021-03-05", "2021-03-05T10:20:30.5": "2021-03-05", "2021-13-05": None, "2021-03": None, "5 mar": None, "2021-3/5": None, "2021-03-05 noon": None}
    df = spark.createDataFrame([(k,) for k in [*given, None]], "t string")
    assert {r["t"]: r["d"] for r in df.select("t", text.date(F.col("t")).cast("string").alias("d")).collect()} == given | {None: None}
