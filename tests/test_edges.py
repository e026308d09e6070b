"""Edges of single operators on rows made by hand."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from milpa.functions import lexicons, text
from milpa.operators import documents, indicators, posts, questions, review, search, warehouse
from milpa.sources import readers, writers


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw, wanted", [("1,234.5", 1234.5), (" 7 ", 7.0), ("12d", None), ("1_000", None), ("inf", None), ("", None), (None, None), ("-.5e1", -5.0)])
def test_number(spark, raw, wanted):
    assert one(spark, text.number, raw) == wanted


@pytest.mark.parametrize("raw, wanted", [(" NaN ", None), ("None", None), ("", None), (None, None), (" x ", "x")])
def test_null_like(spark, raw, wanted):
    assert one(spark, text.null_like, raw) == wanted


def test_strip_accents_beyond_latin(spark):
    assert one(spark, lambda c: text.strip_accents(c, full=True), "Ἀθῆναι ÑÚ") == "αθηναι nu"
    assert one(spark, text.strip_accents, "ÁÉÍ ñ ß") == "aei n ß"


def test_clean_page_deletes_breaks_before_punctuation(spark):
    assert one(spark, text.clean_page, "a \t b\r\n . c\n\n\n\nd\x07 ") == "a b. c\n\nd"


def test_canonical_name_is_one_pass(spark):
    assert one(spark, text.canonical_name, "MÃ©xico") == "México"
    assert one(spark, text.canonical_name, "México") == "Estado de México"
    assert one(spark, text.canonical_name, "Jalisco") == "Jalisco"


def test_last_match_wins_in_fields(spark):
    f = one(spark, posts.fields, "@a\n2021 x\n@b 2024 \n2022 y")
    assert (f["user"], f["date"]) == ("@b 2024", "2022 y")
    assert one(spark, posts.fields, None)["user"] is None


def test_longest_place_and_default(spark):
    assert one(spark, posts.locate, "en nuevo leon")["key"] == "nuevo leon"
    assert one(spark, posts.locate, "nada")["state"] == "Nacional"
    assert one(spark, posts.locate, None)["level"] == "no_detectado"


def test_classify_order_and_confidence_cap(spark):
    assert one(spark, posts.classify, "la policia dijo 30 casos") == "estadistica"
    assert one(spark, posts.classify, "yo nunca lo sufri") == "denuncia"
    row = spark.createDataFrame([("estadistica", "inegi endireh encuesta reporte")], "k string, t string").select(posts.confidence(F.col("k"), F.col("t")).alias("r")).first()
    assert str(row["r"]) == "0.99"


def test_noise_reasons(spark):
    assert one(spark, posts.noise, "corto")["reason"] == "texto_vacio_o_muy_corto"
    assert one(spark, posts.noise, "x" * 30 + " casino")["reason"] == "spam_o_irrelevante"
    assert one(spark, posts.noise, "x" * 30)["is_noise"] == "no"


def test_nested_zip_multiple_and_rest(spark):
    rows = [["2003"], ["2006"], ["Nuevo", "León", "1,000", "2"], ["Puebla", "1", "2", "3", "4"], ["Colima", "1", "2", "3"], ["sin valores"], ["5"]]
    df = spark.createDataFrame([("t", rows)], "tema string, rows array<array<string>>")
    got = {(r["entidad"], r["anio"], r["categoria"], r["valor"]) for r in indicators.nested_to_long(df).collect()}
    assert got == {
        ("Nuevo León", 2003, None, 1000.0), ("Nuevo León", 2006, None, 2.0),
        ("Puebla", 2003, "categoria_1", 1.0), ("Puebla", 2003, "categoria_2", 2.0), ("Puebla", 2006, "categoria_1", 3.0), ("Puebla", 2006, "categoria_2", 4.0),
        ("Colima", None, "valor_1", 1.0), ("Colima", None, "valor_2", 2.0), ("Colima", None, "valor_3", 3.0),
    }


def test_nested_without_years(spark):
    df = spark.createDataFrame([([["A", "1", "2"]],)], "rows array<array<string>>")
    assert [(r["anio"], r["categoria"]) for r in indicators.nested_to_long(df).orderBy("categoria").collect()] == [(None, "valor_1"), (None, "valor_2")]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="valor"):
        indicators.require_columns(spark.range(1), ["valor"])


def test_dedupe_keeps_nulls_equal(spark):
    df = spark.createDataFrame([(None, 2, "b"), (None, 1, "a"), ("k", 3, "c")], "k string, o int, v string")
    assert sorted(r["v"] for r in posts.dedupe_first(df, ["k"], "o").collect()) == ["a", "c"]


def test_unpivot_without_years(spark):
    assert indicators.unpivot_years(spark.range(3), ["id"]).count() == 0


lines = st.lists(st.text(alphabet="abc .", min_size=0, max_size=120), max_size=40)


@settings(max_examples=150, deadline=None)
@given(lines, st.integers(5, 60))
def test_packing(page, limit):
    chunks = documents.pack("\n".join(page), limit)
    paragraphs = [p.strip() for p in page if p.strip()]
    for p in paragraphs:
        if len(p) <= limit:
            assert any(p in c.split("\n") for c in chunks)
    assert all(c.strip() for c in chunks)
    bound = max([limit, *(len(p) for p in paragraphs if len(p) <= limit)]) * 2 + 2
    assert all(len(c) <= bound for c in chunks)


def test_packing_overlap_and_slices():
    assert documents.pack("a" * 6 + "\n" + "b" * 6 + "\n" + "c" * 6, 14) == ["aaaaaa\nbbbbbb", "bbbbbb\ncccccc"]
    assert documents.pack("aa\n" + "b" * 25 + "\ncc", 10) == ["aa", "b" * 10, "b" * 10, "b" * 5, "cc"]
    assert documents.pack(None) == [] and documents.pack(" \n ") == []


def test_pages_before_first_marker_are_dropped(spark):
    df = spark.createDataFrame([("d", "intro\n--- PÁGINA 3 ---\nuno\n--- PÁGINA 3 ---\n\n"), ("e", None)], "documento string, texto string")
    assert [(r["pos"], r["pagina"], r["texto"]) for r in documents.split_pages(df).orderBy("pos").collect()] == [(0, 3, "uno"), (1, 3, "")]


def test_numbering_follows_the_filter(spark):
    df = spark.createDataFrame([("d", 1, 9, 0, "x" * 100), ("d", 0, 8, 1, "y" * 99), ("d", 0, 8, 0, "z" * 100)], "documento string, pos int, pagina int, chunk_pos int, texto string")
    assert [(r["chunk_id"], r["texto"][0]) for r in documents.number_chunks(df).orderBy("chunk_id").collect()] == [(1, "z"), (2, "x")]


def test_scrub_drops_emptied(spark):
    df = spark.createDataFrame([("d", 1, "DIARIO OFICIAL\nuno"), ("d", 2, " DIARIO OFICIAL "), ("x", 3, "dos")], "documento string, chunk_id int, texto string")
    assert [r["texto"] for r in documents.scrub(df, excluded=["x"]).collect()] == ["uno"]


def test_empty_chunks(spark):
    none = spark.createDataFrame([], "documento string, chunk_id int, pagina int, texto string")
    assert review.duplicates(none).count() == 0 and review.residual(none).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([(1, "[1, 0]"), (2, "[1"), (3, None), (4, "[1, null]")], "id_fragmento int, embedding string")
    good, bad = search.valid_vectors(df, 2)
    assert [r[0] for r in good.collect()] == [1] and bad.count() == 3


def test_minmax_all_equal(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5)], "query_id int, id int, semantic double")
    assert {r["semantic"] for r in search.minmax(df).collect()} == {0.0}


def test_top_k_ties_by_key(spark):
    df = spark.createDataFrame([(1, k, 1.0) for k in (3, 1, 2)], "query_id int, id_fragmento int, score double")
    assert [r["id_fragmento"] for r in search.top_k(df, 2).orderBy("rank").collect()] == [1, 2]


def test_queries_without_known_terms(spark):
    docs = spark.createDataFrame([(1, "uno dos"), (2, "tres")], "id_fragmento int, texto string")
    asked = spark.createDataFrame([(9, "zzz")], "query_id int, text string")
    assert search.lexical_scores(search.tfidf_fit(docs), asked).count() == 0


def test_dense_blocks(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id_fragmento long, embedding array<float>")
    q = v.withColumnRenamed("id_fragmento", "query_id")
    assert search.dense_scores(v, q, block=2).count() == 25


def test_get_or_create_is_null_safe_and_repeatable(spark):
    dim = spark.createDataFrame([(4, "x", None)], "k int, a string, b string")
    new = spark.createDataFrame([("x", None), ("y", None), ("Y", None)], "a string, b string")
    out, fresh = warehouse.get_or_create(dim, new, ["a", "b"], "k")
    assert fresh.count() == 1 and sorted(r["k"] for r in out.collect()) == [4, 5]
    assert warehouse.get_or_create(out, new, ["a", "b"], "k")[1].count() == 0


def test_guarded_load_refuses(spark):
    chunks = spark.createDataFrame([(1, "a")], "chunk_id int, texto string")
    facts = spark.createDataFrame([], "id_documento int, chunk_id int, texto string")
    docs = spark.createDataFrame([(1, 0, False)], "id_documento int, total_chunks int, incluido_rag boolean")
    with pytest.raises(ValueError):
        warehouse.guarded_load(chunks, facts, docs, 1, 78)
    assert warehouse.guarded_load(chunks, facts, docs, 1, 1)[0].count() == 1


def test_enforce(spark):
    good, bad = warehouse.enforce(spark.createDataFrame([("1", "si"), ("x", "si"), ("2", "tal")], "n string, f string"), "n int, f string", {"f": ["si", "no"]})
    assert good.count() == 1 and sorted(r["reasons"][0] for r in bad.collect()) == ["f: value", "n: type"]


@pytest.mark.parametrize("raw, wanted", [("```sql\nok SELECT 1; x```", "SELECT 1;"), ("no_se_puede_consultar", "NO_SE_PUEDE_CONSULTAR"), (" nada ", "nada"), (None, None)])
def test_extract_statement(spark, raw, wanted):
    assert one(spark, questions.extract_statement, raw) == wanted


@pytest.mark.parametrize("raw, reason", [("select 1;", None), ("select 1; select 2", "several statements"), ("with x", "not a select"), ("select created_at", "banned word"), (None, "not a select")])
def test_screen(spark, raw, reason):
    assert questions.screen_statements(spark.createDataFrame([(raw,)], "s string"), "s").first()["reason"] == reason


def test_html_tables():
    assert readers.tables_of("<table><tr><th>a<th></th></tr><tr><td>1</td><td></td></tr><tr></tr></table><table></table>") == [(1, 0, ["a"]), (1, 1, ["1"])]
    assert readers.tables_of(None) == []


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/violencia familiar 2023.txt").write_text("@u\n" + "x" * 60 + "\n\ncorto", "utf-8")
    assert [r["anio"] for r in posts.clean_posts(readers.texts(spark, str(tmp_path / "a"))).collect()] == [2023]
    (tmp_path / "b").mkdir()
    (tmp_path / "b/u.csv").write_bytes("entidad,anio\nMéxico,2016\n".encode())
    (tmp_path / "b/l.csv").write_bytes("entidad,anio\nPotosí,2021\n".encode("latin-1"))
    assert {r["entidad"] for r in readers.csv(spark, str(tmp_path / "b")).collect()} == {"México", "Potosí"}
    (tmp_path / "c.json").write_text('[{"tema":"t","tabla":{"columnas":["a"],"filas":[["1"]]}}]')
    assert readers.nested_json(spark, str(tmp_path / "c.json")).first()["tabla"]["filas"] == [["1"]]
    writers.csv(spark.range(2), str(tmp_path / "o"))
    writers.per_document(spark.createDataFrame([("d", 1)], "documento string, n int"), str(tmp_path / "p"))
    assert (tmp_path / "p/documento=d").is_dir() and next((tmp_path / "o").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")


def test_accents_on_letters_and_alone(spark):
    df = spark.createDataFrame([("CAFÉ",), ("cafe\u0301s",), ("Ệ Việt",), (None,), ("İ",)], "t string")
    assert [r[0] for r in df.select(text.strip_accents(F.col("t"))).collect()] == ["cafe", "cafes", "e viet", None, "i"]
    assert df.where("t like 'cafe%'").select(text.clean_post(F.col("t"))).first()[0] == "cafes"


def test_garbled_names_are_repaired_by_rule(spark):
    names = ["México", "Köln", "Łódź", "Nuevo León", "São Paulo"]
    df = spark.createDataFrame([(n.encode().decode("latin-1"), n) for n in names] + [("Coahuila de Zaragoza", "Coahuila"), ("Querétaro ", "Querétaro"), ("Â", "Â"), (None, None)], "given string, want string")
    assert [r[0] == r[1] for r in df.select(text.canonical_name(F.col("given")), "want").collect()] == [True] * 9


def test_places_without_a_state_have_no_key(spark):
    dim = spark.createDataFrame([("x", None, 1), (None, None, 7)], "municipio_alcaldia string, estado string, k int")
    fact = spark.createDataFrame([(1, "x", None), (2, None, None)], "i int, municipio_alcaldia string, estado string")
    assert [r["k"] for r in warehouse.lookup_null_safe(fact, dim, ["municipio_alcaldia", "estado"], "k").collect()] == [None, None]


def test_new_keys_run_on_over_many_ranges(spark):
    dim = spark.createDataFrame([(5, "b0010")], "id int, nombre string")
    names = spark.range(1000).selectExpr("format_string('b%04d', id) as nombre").repartition(7)
    out, new = warehouse.get_or_create(dim, names, ["nombre"], "id")
    got = {r["nombre"]: r["id"] for r in out.collect()}
    assert len(got) == 1000 and sorted(got.values()) == [5, *range(6, 1005)] and [got[k] for k in sorted(got) if k != "b0010"] == list(range(6, 1005))
    assert warehouse.existing_key(dim, "b0010", "id") == 5
    with pytest.raises(ValueError):
        warehouse.existing_key(dim, "absent", "id")


def test_repeated_attribute_names_do_not_multiply_documents(spark):
    docs = spark.createDataFrame([(1, "café", "old")], "i int, nombre string, url string")
    attrs = spark.createDataFrame([("café", "a"), ("cafe\u0301", "b"), ("none", "c")], "nombre string, url string")
    updated, unknown = warehouse.update_attributes(docs, attrs)
    assert [tuple(r) for r in updated.collect()] == [(1, "café", "b")] and [r["url"] for r in unknown.collect()] == ["c"]


def test_rules_of_one_document_hold_by_default(spark):
    df = spark.createDataFrame([(lexicons.LAW, 0, "Última Reforma DOF 15-01-2026\nArtículo 1\n20 de 88"), ("x", 0, "20 de 88")], "documento string, chunk_id int, texto string")
    assert {r["documento"]: r["texto"] for r in documents.scrub(df).collect()} == {lexicons.LAW: "Artículo 1", "x": "20 de 88"}


def test_seed_rows_of_all_dimensions(spark):
    assert {k: v.count() for k, v in warehouse.seed(spark).items()} == {"fuentes": 4, "ambitos_violencia": 4, "tipos_violencia": 7, "tipos_contenido": 7}


def test_csv_files_of_both_encodings_and_an_empty_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.csv").write_bytes("entidad,anio\nMéxico,2021\n".encode())
    (tmp_path / "a" / "two.csv").write_bytes("entidad,anio\nYucatán,2016\n".encode("latin-1"))
    got = {(r["entidad"], r["anio"], r["archivo_origen"]) for r in readers.csv(spark, str(tmp_path / "a"), "entidad string, anio string").collect()}
    assert got == {("México", "2021", "one.csv"), ("Yucatán", "2016", "two.csv")}
    (tmp_path / "b").mkdir()
    assert readers.csv(spark, str(tmp_path / "b"), "entidad string, anio string").count() == 0


def test_text_json_and_chunk_files(spark, tmp_path):
    for name in ("t", "n", "c"):
        (tmp_path / name).mkdir()
    (tmp_path / "t" / "violencia sexual 2021.txt").write_text("uno\n\ndos")
    (tmp_path / "n" / "x.json").write_text('[{"tema": "a", "subtema": "b", "indicador": "c", "tabla": {"columnas": ["x"], "filas": [["1", "2"]]}}]')
    (tmp_path / "c" / "y.json").write_text('[{"documento": "d", "pagina": 1, "chunk_id": 0, "texto": "t"}]')
    assert [tuple(r) for r in readers.texts(spark, str(tmp_path / "t")).collect()] == [("violencia sexual 2021.txt", "uno\n\ndos")]
    assert readers.nested_json(spark, str(tmp_path / "n")).first()["tabla"]["filas"] == [["1", "2"]]
    assert tuple(readers.chunk_files(spark, str(tmp_path / "c")).first()) == ("d", 1, 0, "t")


def test_words_of_all_lists_in_one_pass(spark):
    lists = [["nuevo leon", "leon", "on"], ["x", "leon"], [], ["ñu", "日本"]]
    texts = ["nuevo leon", "leones", "x on", "日本ñu", "", None, "o n"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(posts.first_words(F.col("t"), lists)).collect()]
    assert got == [[next((i for i, w in enumerate(words) if w in (t or "")), None) for words in lists] for t in texts]


def test_tiers_without_words_or_patterns(spark):
    tiers = {"a": ["uno"], "b": [r"\bdos\b"], "c": [], "d": ["tres", r"\d+"]}
    df = spark.createDataFrame([("uno dos",), ("dos tres",), ("dostres",), ("7",), ("nada",), (None,)], "t string")
    assert [r[0] for r in df.select(posts.classify(F.col("t"), tiers, "z")).collect()] == ["a", "b", "d", "d", "z", "z"]


def test_pages_of_long_documents_by_lines(spark):
    """Lines dealt out over ranges give the pages that the whole texts give, markers in the midst of lines, repeats and nulls included."""
    import random

    rng = random.Random(2)
    rows = []
    kinds = ["--- PÁGINA {} ---", "a --- PÁGINA {} --- b--- PÁGINA 7 ---", "text", "two\nlines", "", None, "--- PÁGINA 99999999999 ---", "more text"]
    for d, n in (("big", 700), ("small", 5), (None, 40), ("none", 1)):
        for i in range(n):
            kind = rng.choice(kinds)
            rows.append((d, i, kind and kind.format(i)))
    df = spark.createDataFrame(rows, "documento string, linea int, texto string")
    whole: dict = {}
    for d, _, t in rows:
        whole.setdefault(d, []).append(t or "")
    one = spark.createDataFrame([(d, "\n".join(ts)) for d, ts in whole.items()], "documento string, texto string")
    told = lambda x: sorted((str(r["documento"]), r["pos"], str(r["pagina"]), r["texto"]) for r in x.collect())
    assert told(documents.split_lines(df.withColumn("part", F.lit(1)).repartition(5))) == told(documents.split_pages(one))
    assert documents.split_lines(df.where("false")).count() == 0
    marked = documents.mark_pages(spark.createDataFrame([("d", 2, "b"), ("d", 1, None), ("d", None, "x")], "documento string, pagina int, texto string"))
    assert told(documents.split_lines(marked)) == [("d", 0, "1", ""), ("d", 1, "2", "b")]
