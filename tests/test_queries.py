"""Every query with SQL gives what DuckDB gives on the same tables."""

import zlib
from decimal import Decimal
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from milpa.plans import queries as plans

SF = Path("/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    def cell(v):
        if pd.isna(v):
            return ""
        return f"{float(v):.6f}" if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else str(v)

    names = sorted(df.columns)
    return names, sorted(tuple(cell(v) for v in r) for r in df[names].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, duck, name):
    assert rows(plans.QUERIES[name](spark, str(SF)).toPandas()) == rows(duck.sql(plans.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_without_sql(spark, name):
    df = plans.QUERIES[name](spark, str(SF))
    assert df.columns and df.count() > 0


def test_entry_works_without_the_optional_subpackage():
    """In a fresh interpreter in which the subpackage cannot be found."""
    import subprocess
    import sys

    code = "import sys; sys.modules['milpa.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k == 'pipeline' or k.startswith('op') for k in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, check=True)
    assert done.stdout.split()[-3:] == [str(len(plans.QUERIES)), str(len(plans.SQL)), "False"]


def test_no_cartesian_product_in_star_joins(spark):
    plan = plans.q14_star(spark, str(SF))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_reach_the_scan(spark):
    plan = plans.q4_count(spark, str(SF))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan


@pytest.mark.parametrize("name", ["p3_parse_name_all", "t13_expand_acronyms_all_languages"])
def test_every_document_has_a_row(spark, name):
    assert plans.QUERIES[name](spark, str(SF)).count() == plans.read(spark, str(SF), "documents").count()


def test_names_of_all_documents(spark):
    known, topics = ("violencia familiar", "violencia sexual", "otra"), ("familiar 2027", "sexual 2027", "otra 2027")
    for r in plans.p3_parse_name_all(spark, str(SF)).collect():
        year, kind = 2021 + r["doc_id"] % 7, r["doc_id"] % 3
        assert (r["y"], r["topic"]) == ((year, known[kind]) if year < 2027 else (None, topics[kind]))


@pytest.mark.parametrize("name", ["r6_residual_all_patterns", "r7_preserved_all_patterns"])
def test_every_pattern_is_sought(spark, name):
    assert {r[0] for r in plans.QUERIES[name](spark, str(SF)).select("pattern").distinct().collect()} == set(plans.WANTED)


def test_more_than_a_hundred_event_types_are_allowed(spark, tmp_path):
    rows = [(i, float(i), f"type{i % 250}") for i in range(1, 500)] + [(1001, 1.0, "error"), (1002, 1.0, None)]
    spark.createDataFrame(rows, "event_id long, value double, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: (r["a"], r["b"]) for r in plans.QUERIES["l8_enforce"](spark, str(tmp_path)).collect()}
    assert got == {i: ("value: type", None) for i in range(5, 500, 5)} | {1001: (None, "event_type: value")}


def packed(page, limit, overlap=1):
    """Chunks of a page, stated over places: each chunk is a run of paragraphs from ``first`` on, as long as it fits."""
    paragraphs, out, first, at = [p.strip() for p in page.split("\n") if p.strip()], [], 0, 0
    cost = lambda a, b: sum(len(p) + 1 for p in paragraphs[a:b])
    while at < len(paragraphs):
        if cost(first, at) + len(paragraphs[at]) + 1 <= limit:
            at += 1
            continue
        if first < at:
            out.append("\n".join(paragraphs[first:at]))
            first = max(first, at - overlap)
        if len(paragraphs[at]) > limit:
            out += [x for i in range(0, len(paragraphs[at]), limit) if (x := paragraphs[at][i : i + limit].strip())]
            first = at = at + 1
        else:
            at += 1
    return out + (["\n".join(paragraphs[first:])] if first < len(paragraphs) else [])


def test_all_pages_are_packed(spark, duck):
    cleaned = {(r["documento"], r["pagina"]): r["t"] for r in plans.pages(spark, str(SF)).select("documento", "pagina", plans.text.clean_page(F.col("texto")).alias("t")).collect()}
    got = {(r["documento"], r["pagina"], r["chunk_pos"]): r["texto"] for r in plans.d3_pack_pages(spark, str(SF)).collect()}
    assert got == {(d, p, i): c for (d, p), t in cleaned.items() for i, c in enumerate(packed(t, 1400))}
    assert len(cleaned) == duck.sql("SELECT count(*) FROM documents").fetchall()[0][0] and any(i for _, _, i in got)


def test_samples_of_all_documents(spark):
    chunks = plans.chunks(spark, str(SF)).withColumn("h", F.xxhash64("documento", "chunk_id", F.lit(42))).collect()
    by = {}
    for r in chunks:
        by.setdefault(r["documento"], []).append((r["h"], r["chunk_id"], r["texto"]))
    wanted = sorted((d, c, t) for d, rows in by.items() for _, c, t in sorted(rows)[:3])
    assert sorted((r["documento"], r["chunk_id"], r["texto"]) for r in plans.r5_sample(spark, str(SF)).collect()) == wanted
    again = plans.review.sample(plans.chunks(spark, str(SF)).repartition(7))
    assert sorted((r["documento"], r["chunk_id"], r["texto"]) for r in again.collect()) == wanted


def test_vectors_of_all_documents(spark):
    texts = dict(plans.read(spark, str(SF), "documents").select("doc_id", "text").collect())
    got = {r["id_fragmento"]: r["embedding"] for r in plans.e2_encode(spark, str(SF)).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        v = np.zeros(64)
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % 64] += 1 if h >> 31 else -1
        assert np.allclose(got[i], v / max(np.linalg.norm(v), 1e-12), atol=1e-5)
