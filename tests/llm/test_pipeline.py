"""The stages one after another on small tables."""

import pytest
from tests.llm.test_operators import PASSAGE, prose

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    rows, labels = [], []
    for i in range(400):
        t = prose(80, 5000 + i)
        if i % 8 == 1:
            t = t.replace(" ", "### ")
        if i in (10, 20):
            t = prose(80, 1)
        if i in (30, 40):
            t = t + " " + PASSAGE
        if i == 50:
            t = t + " " + "Test  ITEM " + prose(30, 77) + " tail"
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
        labels.append((i, int(i % 8 != 1), 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, "test item " + prose(30, 77))], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_every_decision_takes_effect(spark, folder):
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert not [i for i in got if i % 8 == 1]  # poor ones
    assert 10 in got and 20 not in got  # one of the copies
    assert PASSAGE[:200] not in got[30]["text"] and PASSAGE[:200] not in got[40]["text"] and got[30]["n_chars"] == len(got[30]["text"])
    assert 50 not in got  # holds a test item
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in got.values())
    assert len([i for i in range(400) if i % 8 != 1 and i not in (20, 50) and i not in got]) <= 6  # clean documents stay


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.where("false"), folder).count() == 0


def test_repeats_of_over_fifty_short_words_go(spark):
    words = [f"{i:x}".replace("0", "q") for i in range(16, 400)]
    passage, parts = " ".join(words[:51]), " ".join(words[100:150])
    texts = [f"eins é {passage} two", f"  {passage}\nthree", f"four {parts} five", f"six {parts} seven", " ".join(["a"] * 60) + " end", None, "", passage[:-1]]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    left = {0: "eins é  two", 1: "  \nthree", 2: texts[2], 3: texts[3], 4: " end", 7: texts[7]}
    assert len(passage) < 256 and {i: got[i] for i in left} == {i: (t, len(t)) for i, t in left.items()}


def test_repeated_and_missing_ids_lose_no_text(spark):
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(1, a, "en"), (1, b, "en"), (1, b, "de"), (2, b, "en"), (2, c, None), (3, None, None), (None, c, "en"), (None, c, "en"), (None, None, None)]
    docs = spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(map(str, [(r["doc_id"], r["text"], r["lang"]) for r in got])) == sorted(map(str, [(1, a, "en"), (1, b, "de"), (3, None, None), (None, c, "en"), (None, None, None)]))


def test_texts_come_to_python_in_small_batches(spark, folder):
    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    long = spark.range(5000).selectExpr("repeat('abcdefgh', 500) as text").coalesce(1)  # 20 MB in one partition
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs, folder)
        got = [r["n"] for r in long.mapInArrow(sizes, "n long").collect()]
        assert sum(got) >= 20_000_000 and max(got) < 5_000_000
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
