"""Queries over the given tables, one or more for every operator of the library, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from milpa.functions import lexicons, text
from milpa.operators import analytics, documents, indicators, posts, questions, review, search, warehouse
from milpa.sources import readers, writers
from milpa.storage import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df) if name in ("documents", "conversations", "pages", "embeddings") else df  # what is done to texts and vectors is worth a core each


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# ---- text scalars -------------------------------------------------------------------------------------------------------------
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')".format


def clean_sql(c: str) -> str:
    out = rf"replace(regexp_replace(regexp_replace(strip_accents(lower({c})), 'http\S+', ' ', 'g'), '@\w+', ' ', 'g'), '#', '')"
    for phrase in lexicons.UI_PHRASES:
        out = f"replace({out}, '{phrase}', ' ')"
    return rf"trim(regexp_replace(regexp_replace({out}, '[^a-zA-Z0-9áéíóúñ\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("SELECT doc_id, strip_accents(lower(text)) AS bare FROM documents")
def t1_strip_accents(spark, d):
    return read(spark, d, "documents").select("doc_id", text.strip_accents(F.col("text")).alias("bare"))


@query(f"SELECT doc_id, {clean_sql('text')} AS clean FROM documents")
def t2_clean_post(spark, d):
    return read(spark, d, "documents").select("doc_id", text.clean_post(F.col("text")).alias("clean"))


@query(r"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) AS composed FROM documents")
def t3_compose(spark, d):
    return read(spark, d, "documents").select("doc_id", text.compose(F.col("text")).alias("composed"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(strip_accents(lower(trim(p_name))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def t4_slug(spark, d):
    return read(spark, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE event_type END AS cleaned FROM events")
def t5_null_like(spark, d):
    raw = F.when(F.col("event_id") % 4 == 0, " NaN ").when(F.col("event_id") % 4 == 1, "none").otherwise(F.concat(F.lit("\t"), F.col("event_type"), F.lit(" ")))
    return read(spark, d, "events").select("event_id", text.null_like(raw).alias("cleaned"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS DOUBLE) END AS value FROM orders")
def t6_number(spark, d):
    whole = F.floor("o_totalprice")
    shown = F.concat((whole / 1000).cast("long").cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0"))
    return read(spark, d, "orders").select("o_orderkey", text.number(F.when(F.col("o_orderkey") % 5 == 0, "12d").otherwise(shown)).alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE year(o_orderdate) END AS y, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders")
def t7_t8_year_date(spark, d):
    y = F.when(F.col("o_orderkey") % 3 == 0, "s/d").otherwise(F.concat(F.year("o_orderdate").cast("string"), F.lit(".0")))
    day = F.when(F.col("o_orderkey") % 7 == 0, "31-12-2020").otherwise(F.concat(F.to_date("o_orderdate").cast("string"), F.lit(" ")))
    return read(spark, d, "orders").select("o_orderkey", text.year(y).cast("long").alias("y"), text.date(day).cast("string").alias("day"))


@query("SELECT n_nationkey, CASE n_name WHEN 'NATION_6' THEN 'Francia' WHEN 'Francia' THEN 'x' ELSE n_name END AS name FROM nation")
def t9_canonical_name(spark, d):
    return read(spark, d, "nation").select("n_nationkey", text.canonical_name(F.concat(F.lit(" "), "n_name"), {"NATION_6": "Francia", "Francia": "x"}).alias("name"))


@query(rf"SELECT doc_id, {STRIP(r'''regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\s+([.,;:!?])', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')''')} AS page FROM documents")
def t10_clean_page(spark, d):
    return read(spark, d, "documents").select("doc_id", text.clean_page(F.col("text")).alias("page"))


@query(r"SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS key FROM documents")
def t12_duplicate_key(spark, d):
    return read(spark, d, "documents").select("doc_id", text.duplicate_key(F.col("text")).alias("key"))


_ENDS = r"(^|$|[^\p{L}\p{N}_])"


EXPANDED = rf"SELECT doc_id, text || CASE WHEN regexp_matches(text, '(?i){_ENDS}that{_ENDS}') THEN ' (one)' ELSE '' END || CASE WHEN regexp_matches(text, '(?i){_ENDS}mit{_ENDS}') THEN ' (two)' ELSE '' END AS expanded FROM documents"


@query(EXPANDED)
def t13_expand_acronyms(spark, d):
    return read(spark, d, "documents").select("doc_id", text.expand_acronyms(F.col("text"), {"that": "one", "mit": "two"}).alias("expanded"))


@query(EXPANDED)
def t13_expand_acronyms_all_languages(spark, d):
    return t13_expand_acronyms(spark, d)


# ---- posts --------------------------------------------------------------------------------------------------------------------
def dumps(spark: SparkSession, d: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["text"]), "\n\n").alias("text"))


DUMPS = r"(SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id)"


@query(rf"SELECT conv_id, unnest(b) AS block, generate_subscripts(b, 1) - 1 AS pos FROM (SELECT conv_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: {STRIP('x')}), lambda x: length(x) > 50) AS b FROM {DUMPS})")
def p1_segment(spark, d):
    return posts.segment(dumps(spark, d)).select("conv_id", "block", F.col("pos").cast("long").alias("pos"))


@query(f"SELECT doc_id, {STRIP('''list_filter(l, lambda x: starts_with(x, '@'))[-1]''')} AS handle, {STRIP('''list_filter(l, lambda x: NOT starts_with(x, '@') AND contains(x, 'ea'))[-1]''')} AS dated FROM (SELECT doc_id, string_split('@' || source || chr(10) || text, chr(10)) AS l FROM documents)")
def p2_fields(spark, d):
    f = posts.fields(F.concat(F.lit("@"), "source", F.lit("\n"), "text"), "ea")
    return read(spark, d, "documents").select("doc_id", f["user"].alias("handle"), f["date"].alias("dated"))


PARSED = "SELECT doc_id, CASE WHEN doc_id % 7 < 6 THEN 2021 + doc_id % 7 END AS y, CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 7 = 6 THEN 'familiar 2027' ELSE 'violencia familiar' END WHEN 1 THEN CASE WHEN doc_id % 7 = 6 THEN 'sexual 2027' ELSE 'violencia sexual' END ELSE 'otra' || CASE WHEN doc_id % 7 = 6 THEN ' 2027' ELSE '' END END AS topic FROM documents"


@query(PARSED)
def p3_parse_name(spark, d):
    return parsed_names(read(spark, d, "documents"))


@query(PARSED)
def p3_parse_name_all(spark, d):
    return p3_parse_name(spark, d)


def parsed_names(docs: DataFrame) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "familiar").when(F.col("doc_id") % 3 == 1, "Sexual").otherwise("otra")
    n = posts.parse_name(F.concat(F.lit("violencia "), kind, F.lit(" "), (2021 + F.col("doc_id") % 7).cast("string"), F.lit(".txt")))
    return docs.select("doc_id", n["year"].cast("long").alias("y"), n["topic"].alias("topic"))


@query("SELECT doc_id, CASE WHEN doc_id % 9 BETWEEN 2 AND 7 THEN 2019 + doc_id % 9 ELSE 2024 END AS y FROM documents")
def p4_mentioned_year(spark, d):
    return read(spark, d, "documents").select("doc_id", posts.mentioned_year(F.concat(F.lit("en "), (2019 + F.col("doc_id") % 9).cast("string"), F.lit(" y 2024, no 20255"))).cast("long").alias("y"))


CLEAN = f"(SELECT doc_id, lang, source, {clean_sql('text')} AS c FROM documents)"
NOISE = f"CASE WHEN length(c) < 25 THEN 'texto_vacio_o_muy_corto' WHEN regexp_matches(c, '{posts.any_of(lexicons.SPAM_WORDS)}') THEN 'spam_o_irrelevante' WHEN c IN ({quoted(lexicons.MEDIA_WORDS)}) THEN 'solo_multimedia' END"
TIERS = {"estadistica": lexicons.CONTENT_TIERS["estadistica"] + ("therh", r"\bund\b"), **{k: v for k, v in lexicons.CONTENT_TIERS.items() if k != "estadistica"}, "opinion": lexicons.CONTENT_TIERS["opinion"] + (r"\bque\b",)}


def kind_sql(tiers) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(c, '{'|'.join(v)}') THEN '{k}'" for k, v in tiers.items()) + " ELSE 'otro' END"


KIND = kind_sql(TIERS)
CONFIDENT = (
    "CAST(least(CASE kind "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lexicons.CONFIDENCE.items())
    + " ELSE 20 END + 5 * (CASE kind "
    + " ".join(f"WHEN '{k}' THEN {' + '.join(f'''contains(c, '{w}')::INT''' for w in v)}" for k, v in lexicons.STRONG_WORDS.items())
    + " ELSE 0 END), 99) AS DOUBLE) / 100"
)


def rated(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "lang", "source", text.clean_post(F.col("text")).alias("c"))
    docs = docs.withColumns({"kind": posts.classify(F.col("c"), TIERS), "noise": posts.noise(F.col("c"))})
    return docs.withColumn("score", posts.confidence(F.col("kind"), F.col("c")))


RATED = f"(SELECT *, {CONFIDENT} AS score FROM (SELECT *, {KIND} AS kind, {NOISE} AS reason FROM {CLEAN}))"


@query("SELECT doc_id, CASE WHEN regexp_matches(text, 'Elle|ander') THEN 'si' ELSE 'incierto' END AS flag FROM documents")
def p5_flag(spark, d):
    return read(spark, d, "documents").select("doc_id", posts.flag(F.col("text"), ("Elle", "ander")).alias("flag"))


@query(f"SELECT doc_id, CASE WHEN reason IS NULL THEN 'no' ELSE 'si' END AS is_noise, reason FROM {RATED}")
def p6_noise(spark, d):
    return rated(spark, d).select("doc_id", "noise.*")


@query(f"SELECT doc_id, kind FROM {RATED}")
def p7_classify(spark, d):
    return rated(spark, d).select("doc_id", "kind")


PLACES = {**lexicons.PLACES, "thion": ("North", None, "estado"), "eri": ("East", "Eri", "municipio"), "erith": ("East", "Erith", "municipio")}


def place_rows(places) -> str:
    return ", ".join(f"('{k}', {quoted([v[1]]) if v[1] else 'NULL'}, {quoted([v[0]])}, '{v[2]}')" for k, v in places.items())


_PLACE_ROWS = place_rows(PLACES)


@query(f"SELECT doc_id, p.key, p.town, coalesce(p.state, 'Nacional') AS state, coalesce(p.level, 'no_detectado') AS level FROM (SELECT doc_id, list_filter([{quoted(sorted(PLACES, key=len, reverse=True))}], lambda k: contains(c || ' ' || source, k))[1] AS k FROM {CLEAN}) LEFT JOIN (VALUES {_PLACE_ROWS}) p(key, town, state, level) ON p.key = k")
def p8_locate(spark, d):
    docs = read(spark, d, "documents").select("doc_id", posts.locate(text.clean_post(F.col("text")), F.col("source"), PLACES).alias("p"))
    return docs.select("doc_id", "p.*")


@query(f"SELECT doc_id, score FROM {RATED}")
def p9_confidence(spark, d):
    return rated(spark, d).select("doc_id", F.col("score").cast("double").alias("score"))


_LINES = "string_split(texto_original, chr(10))"
_CUT = f"(SELECT conv_id, unnest(b) AS texto_original, CAST(generate_subscripts(b, 1) - 1 AS INTEGER) AS pos FROM (SELECT conv_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: {STRIP('x')}), lambda x: length(x) > 50) AS b FROM {DUMPS}))"
_TAKEN = f"(SELECT *, {clean_sql('texto_original')} AS c, {STRIP(f"list_filter({_LINES}, lambda x: starts_with(x, '@'))[-1]")} AS usuario, {STRIP(f"list_filter({_LINES}, lambda x: NOT starts_with(x, '@') AND contains(x, '202'))[-1]")} AS fecha FROM {_CUT})"
_TOLD = f"(SELECT *, {kind_sql(lexicons.CONTENT_TIERS)} AS kind, {NOISE} AS motivo_basura, list_filter([{quoted(sorted(lexicons.PLACES, key=len, reverse=True))}], lambda k: contains(strip_accents(lower(concat_ws(' ', c, usuario))), k))[1] AS k FROM {_TAKEN})"
POSTS = f"""SELECT 'violencia familiar ' || (2021 + conv_id % 6) || '.txt' AS archivo_origen, pos, CAST(2021 + conv_id % 6 AS INTEGER) AS anio, 'violencia familiar' AS tipo_violencia_archivo, usuario, fecha, CAST(2021 + conv_id % 6 AS INTEGER) AS anio_publicacion,
CAST(nullif(regexp_extract(c, '\\b({'|'.join(map(str, lexicons.YEARS))})\\b', 1), '') AS INTEGER) AS anio_mencionado, texto_original, c AS texto_limpio, kind AS tipo_contenido, CAST({CONFIDENT} AS DECIMAL(4,2)) AS nivel_confianza,
k AS lugar_detectado, p.town AS municipio_alcaldia, coalesce(p.state, 'Nacional') AS estado, coalesce(p.level, 'no_detectado') AS nivel_ubicacion,
CASE WHEN regexp_matches(c, '{posts.any_of(lexicons.WOMEN_WORDS)}') THEN 'si' ELSE 'incierto' END AS violencia_mujer, CASE WHEN motivo_basura IS NULL THEN 'no' ELSE 'si' END AS es_basura, motivo_basura
FROM {_TOLD} LEFT JOIN (VALUES {place_rows(lexicons.PLACES)}) p(key, town, state, level) ON p.key = k"""


@query(POSTS)
def p10_clean_posts(spark, d):
    named = dumps(spark, d).withColumn("file", F.concat(F.lit("violencia familiar "), (2021 + F.col("conv_id") % 6).cast("string"), F.lit(".txt")))
    return posts.clean_posts(named)


@query("SELECT CAST(event_id AS VARCHAR) AS id_publicacion, year(ts) AS anio, month(ts) AS mes, props AS texto, CAST(user_id AS VARCHAR) AS usuario, event_type = 'click' AS es_repost, 'q' AS query_origen, 'X' AS plataforma FROM events")
def p11_flatten_posts(spark, d):
    raw = read(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("props").alias("text"), F.col("user_id").cast("string").alias("user"), F.lit(None).cast("string").alias("url"), F.lit("es").alias("lang"),
        F.array(F.lit("a")).alias("hashtags"), F.lit(None).cast("array<string>").alias("mentions"), F.when(F.col("event_type") == "click", F.col("event_id")).alias("repost_of"),
    )
    flat = posts.flatten_posts(raw, "q")
    return flat.select("id_publicacion", F.col("anio").cast("long").alias("anio"), F.col("mes").cast("long").alias("mes"), "texto", "usuario", "es_repost", "query_origen", "plataforma")


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def p12_dedupe_first(spark, d):
    return posts.dedupe_first(read(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query(f"""WITH r AS (SELECT *, CASE WHEN reason IS NULL THEN 'no' ELSE 'si' END AS noise FROM {RATED})
SELECT 'total' AS metric, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM r
UNION ALL SELECT 'lang', lang, CAST(count(*) AS DOUBLE) FROM r GROUP BY lang
UNION ALL SELECT 'kind', kind, CAST(count(*) AS DOUBLE) FROM r GROUP BY kind
UNION ALL SELECT 'noise', noise, CAST(count(*) AS DOUBLE) FROM r GROUP BY noise
UNION ALL SELECT 'mean score', '', round(CAST(sum(CAST(score AS DECIMAL(18,4))) AS DOUBLE) / count(score), 6) FROM r
UNION ALL SELECT 'mean score by kind', kind, round(CAST(sum(CAST(score AS DECIMAL(18,4))) AS DOUBLE) / count(score), 2) FROM r GROUP BY kind""")
def a1_summarize_posts(spark, d):
    flat = rated(spark, d).select("lang", "kind", F.col("noise.is_noise").alias("noise"), "score")
    return posts.summarize_posts(flat, ["lang", "kind", "noise"], "score", "kind").withColumn("value", F.round("value", 6))


# ---- indicators ---------------------------------------------------------------------------------------------------------------
def first_source(spark: SparkSession, d: str) -> DataFrame:
    """Mean order price by nation and year."""
    rows = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return rows.groupBy(F.col("n_name").alias("entidad"), F.year("o_orderdate").cast("long").alias("anio"), "n_regionkey").agg(F.round(total / F.count("*"), 2).alias("valor"))


def second_source(spark: SparkSession, d: str) -> DataFrame:
    """Mean quantity by supplier's nation and year."""
    rows = read(spark, d, "lineitem").join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("entidad"), F.year("l_shipdate").cast("long").alias("anio")).agg(F.round(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.count("*"), 4).alias("valor"))


F1 = "(SELECT n_name AS entidad, year(o_orderdate) AS anio, n_regionkey, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2) AS valor FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"
F2 = "(SELECT n_name AS entidad, year(l_shipdate) AS anio, round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS valor FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"


@query(f"SELECT entidad, anio, valor, coalesce(r_name, CAST(n_regionkey AS VARCHAR)) AS nombre FROM {F1} LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') ON n_regionkey = r_regionkey")
def i1_attach_metadata(spark, d):
    meta = read(spark, d, "region").where("r_name != 'ASIA'").select(F.col("r_regionkey").cast("string").alias("archivo_origen"), F.col("r_name").alias("nombre"))
    facts = first_source(spark, d).withColumn("archivo_origen", F.col("n_regionkey").cast("string"))
    return indicators.attach_metadata(facts, meta, "left", default="nombre").select("entidad", "anio", "valor", "nombre")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 4 <> 0")
def i2_i3_required(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("s"))
    return indicators.drop_null_keys(indicators.require_columns(df, ["o_orderkey", "s"]), ["s"])


@query("SELECT o_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2")
def i4_dedupe_first(spark, d):
    return indicators.dedupe_first(read(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice"), ["o_custkey", "o_orderstatus"], "o_orderkey")


@query("SELECT DISTINCT c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer")
def i5_distinct_rows(spark, d):
    return indicators.distinct_rows(read(spark, d, "customer").select("c_nationkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment")))


@query(f"WITH f AS (SELECT * FROM {F1}) SELECT e.entidad, y.anio, f.valor FROM (SELECT DISTINCT entidad FROM f) e CROSS JOIN (SELECT DISTINCT anio FROM f) y LEFT JOIN f ON f.entidad = e.entidad AND f.anio = y.anio")
def i6_unpivot_years(spark, d):
    wide = first_source(spark, d).groupBy("entidad").pivot("anio").agg(F.first("valor"))
    return indicators.unpivot_years(wide, ["entidad", "absent"]).withColumn("anio", F.col("anio").cast("long"))


@query(f"SELECT entidad, anio, valor, NULL::INT AS n_regionkey FROM {F2} UNION ALL SELECT entidad, anio, valor, n_regionkey FROM {F1}")
def i7_union_files(spark, d):
    return indicators.union_files([first_source(spark, d), second_source(spark, d)]).select("entidad", "anio", "valor", "n_regionkey")


@query(f"WITH f AS (SELECT entidad, n_regionkey, anio, valor FROM {F1}), y AS (SELECT DISTINCT anio FROM f), e AS (SELECT DISTINCT n_regionkey, entidad FROM f) SELECT e.n_regionkey, e.entidad, y.anio, NULL::VARCHAR AS categoria, CAST(coalesce(f.valor, 0) AS DOUBLE) AS valor FROM e CROSS JOIN y LEFT JOIN f USING (n_regionkey, entidad, anio)")
def i8_i10_nested_to_long(spark, d):
    facts = first_source(spark, d)
    years = facts.select(F.col("anio")).distinct().agg(F.array_sort(F.collect_set("anio")).alias("years"))
    rows = facts.groupBy("n_regionkey", "entidad").agg(F.map_from_entries(F.collect_list(F.struct("anio", F.format_string("%,.2f", "valor").alias("v")))).alias("c")).join(F.broadcast(years))
    tokens = F.concat(F.split("entidad", " "), F.transform("years", lambda y: F.coalesce(F.try_element_at("c", y), F.lit("0.00"))))
    tables = rows.groupBy("n_regionkey", "years").agg(F.collect_list(tokens).alias("body"))
    tables = tables.select("n_regionkey", F.concat(F.transform("years", lambda y: F.array(y.cast("string"))), "body").alias("rows"))
    return indicators.nested_to_long(tables).select("n_regionkey", "entidad", F.col("anio").cast("long").alias("anio"), "categoria", F.col("valor").cast("double").alias("valor"))


@query("SELECT s_suppkey, 'Entidad;Valor' AS head, 2 AS n, 'X ' || s_nationkey AS first FROM supplier")
def i11_text_table(spark, d):
    t = indicators.parse_text_table(F.concat(F.lit("Entidad \n\n Valor\nX   "), F.col("s_nationkey").cast("string"), F.lit("\nY 12 7\n")))
    return read(spark, d, "supplier").select("s_suppkey", F.array_join(t["columns"], ";").alias("head"), F.size(t["rows"]).cast("long").alias("n"), F.array_join(t["rows"][0], " ").alias("first"))


@query("SELECT s_suppkey, 'Gran Valle' AS name, y AS anio, CAST(s_nationkey + i AS DOUBLE) AS valor FROM supplier, (VALUES (2003, 0), (2006, 1), (2016, 3)) v(y, i)")
def i12_fixed_tail(spark, d):
    n = F.col("s_nationkey")
    line = F.concat_ws(" ", F.lit("a\nb\nc\nd\ne\nshort 1\nGran Valle"), n.cast("string"), (n + 1).cast("string"), F.lit("n/d"), (n + 3).cast("string"))
    return read(spark, d, "supplier").select("s_suppkey", F.inline(indicators.parse_fixed_tail(line, (2003, 2006, 2011, 2016)))).withColumn("anio", F.col("anio").cast("long"))


@query("SELECT o_orderpriority AS tema, count(*) AS tables, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS empty, count(DISTINCT (o_orderpriority, o_orderstatus, o_custkey % 5)) AS indicators FROM orders GROUP BY 1")
def i13_audit_tables(spark, d):
    t = read(spark, d, "orders").select(F.col("o_orderpriority").alias("tema"), F.col("o_orderstatus").alias("subtema"), (F.col("o_custkey") % 5).alias("indicador"), F.when(F.col("o_orderkey") % 10 != 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("filas"))
    return indicators.audit_tables(t)


@query(f"WITH f AS (SELECT *, 'mean ' || (n_regionkey % 2) AS nombre_indicador FROM {F1}) SELECT 'indicator' AS metric, nombre_indicador AS key, count(*) AS value FROM f GROUP BY 2 UNION ALL SELECT 'year', CAST(anio AS VARCHAR), count(*) FROM f GROUP BY 2 UNION ALL (SELECT 'entity', entidad, count(*) AS n FROM f GROUP BY 2 ORDER BY n DESC, entidad LIMIT 10)")
def a2_summarize_indicators(spark, d):
    return indicators.summarize_indicators(first_source(spark, d).withColumn("nombre_indicador", F.concat(F.lit("mean "), (F.col("n_regionkey") % 2).cast("string"))))


# ---- documents and review -----------------------------------------------------------------------------------------------------
def pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source as the pages of one document."""
    return read(spark, d, "documents").select(F.col("source").alias("documento"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("pagina"), F.when(F.col("doc_id") % 11 == 0, " \n").otherwise(F.col("text")).alias("texto"))


PAGES = "(SELECT source AS documento, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pagina, CASE WHEN doc_id % 11 = 0 THEN ' ' || chr(10) ELSE text END AS texto FROM documents)"


@query(f"SELECT *, CASE WHEN percent >= 90 THEN 'OK' WHEN percent >= 50 THEN 'REVISAR' ELSE 'POSIBLE PDF ESCANEADO' END AS status FROM (SELECT documento, count(*) AS pages, count(*) FILTER (WHERE {STRIP('texto')} <> '') AS with_text, round(100.0 * count(*) FILTER (WHERE {STRIP('texto')} <> '') / count(*), 2)::DOUBLE AS percent FROM {PAGES} GROUP BY 1)")
def d1_page_coverage(spark, d):
    return documents.page_coverage(pages(spark, d))


@query(f"SELECT documento, pagina - 1 AS pos, pagina, {STRIP('texto')} AS texto FROM {PAGES}")
def d2_split_pages(spark, d):
    out = documents.split_lines(documents.mark_pages(pages(spark, d)))
    return out.select("documento", F.col("pos").cast("long").alias("pos"), F.col("pagina").cast("long").alias("pagina"), "texto")


@query()
def d3_pack_pages(spark, d):
    return documents.pack_pages(pages(spark, d).withColumn("pos", F.col("pagina") - 1))


@query("WITH l AS (SELECT source AS documento, doc_id AS pos, doc_id AS pagina, unnest(string_split(text, chr(10))) AS texto, generate_subscripts(string_split(text, chr(10)), 1) AS chunk_pos FROM documents) SELECT documento, pagina, row_number() OVER (PARTITION BY documento ORDER BY pos, chunk_pos) AS chunk_id, texto FROM l WHERE length(trim(texto)) >= 100")
def d4_number_chunks(spark, d):
    lines = read(spark, d, "documents").select(F.col("source").alias("documento"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("pagina"), F.posexplode(F.split("text", "\n")).alias("chunk_pos", "texto"))
    return documents.number_chunks(lines).withColumn("chunk_id", F.col("chunk_id").cast("long"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("source").alias("documento"), F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 7).alias("pagina"), F.col("text").alias("texto"))


CHUNKS = "(SELECT source AS documento, doc_id AS chunk_id, doc_id % 7 AS pagina, text AS texto FROM documents)"
HEADERS = ("Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "The.")
RULES = (("src1", r"(?i)\bthe\b", ""), ("src2", r"\d+", "#"))
_UNLINED = f"array_to_string(list_filter(string_split(texto, chr(10)), lambda x: {STRIP('x')} NOT IN ({quoted(HEADERS)})), chr(10))"
_RULED = rf"CASE documento WHEN 'src1' THEN regexp_replace({_UNLINED}, '(?i)\bthe\b', '', 'g') WHEN 'src2' THEN regexp_replace({_UNLINED}, '\d+', '#', 'g') ELSE {_UNLINED} END"
SCRUBBED = f"(SELECT * FROM (SELECT documento, chunk_id, pagina, {STRIP(f'''regexp_replace(regexp_replace({_RULED}, '[ {chr(92)}t]+', ' ', 'g'), '{chr(92)}n{{3,}}', chr(10) || chr(10), 'g')''')} AS texto FROM {CHUNKS} WHERE documento NOT IN ('src3')) WHERE texto <> '')"


def scrubbed(spark: SparkSession, d: str) -> DataFrame:
    return documents.scrub(chunks(spark, d), HEADERS, RULES, ("src3",))


@query(f"SELECT * FROM {SCRUBBED}")
def d5_d8_scrub(spark, d):
    return scrubbed(spark, d)


@query(f"SELECT b.documento, count(*) AS chunks_in, count(a.texto) AS chunks_out, count(*) FILTER (WHERE {STRIP('a.texto')} <> {STRIP('b.texto')}) AS modified, count(*) FILTER (WHERE a.texto IS NULL) AS emptied, sum(length(b.texto))::BIGINT AS chars_before, sum(coalesce(length(a.texto), 0))::BIGINT AS chars_after, (sum(length(b.texto)) - sum(coalesce(length(a.texto), 0)))::BIGINT AS chars_removed, grouping(b.documento) = 1 AS total FROM {CHUNKS} b LEFT JOIN {SCRUBBED} a USING (documento, chunk_id) GROUP BY ROLLUP (b.documento)")
def d9_scrub_stats(spark, d):
    return documents.scrub_stats(chunks(spark, d), scrubbed(spark, d))


@query(f"SELECT documento, row_number() OVER (PARTITION BY documento ORDER BY turn, texto) - 1 AS chunk_id, turn AS pagina, {STRIP('texto')} AS texto, role AS tema FROM (SELECT CAST(conv_id AS VARCHAR) AS documento, turn, role, text AS texto FROM conversations WHERE role = 'assistant' AND {STRIP('text')} <> '')")
def d10_curated_chunks(spark, d):
    none = F.lit(None).cast("string")
    r = F.struct(F.col("turn").alias("pagina"), F.col("text").alias("texto_rag"), (F.col("role") == "assistant").alias("incluir_rag"), F.col("role").alias("tema"), none.alias("tipo_contenido"), none.alias("tipo_registro"), none.alias("periodo"), none.alias("ambito_geografico"))
    records = read(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("documento")).agg(F.array_sort(F.collect_list(r)).alias("registros"))
    return documents.curated_chunks(records).select("documento", F.col("chunk_id").cast("long").alias("chunk_id"), "pagina", "texto", "tema")


@query(f"SELECT documento, count(DISTINCT pagina) AS pages, count(*) FILTER (WHERE length(trim(texto)) >= 100) AS chunks, count(*) FILTER (WHERE length(trim(texto)) < 100) AS dropped FROM {CHUNKS} GROUP BY 1")
def d11_chunk_stats(spark, d):
    return documents.chunk_stats(chunks(spark, d))


@query(f"SELECT documento, count(*) AS chunks, count(DISTINCT pagina) AS pages, min(n) AS least, max(n) AS most, round(sum(n)::DOUBLE / count(*), 6) AS mean, round(quantile_cont(n, 0.5), 6)::DOUBLE AS median FROM (SELECT *, length({STRIP('texto')}) AS n FROM {CHUNKS}) GROUP BY 1")
def r1_length_profile(spark, d):
    p = review.length_profile(chunks(spark, d))
    return p.withColumns({c: F.col(c).cast("long") for c in ("least", "most")})


FLAGS = rf"(SELECT *, length({STRIP('texto')}) < 150 AS is_short, length({STRIP('texto')}) > 1500 AS is_long, regexp_matches({STRIP('texto')}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') AS has_control, regexp_matches({STRIP('texto')}[1:1], '[\p{{Ll}},.;:)]') AS suspicious_start, chunk_id > min(chunk_id) OVER (PARTITION BY documento, trim(regexp_replace(lower(texto), '\s+', ' ', 'g'))) AS is_duplicate FROM {CHUNKS})"


@query(f"SELECT documento, chunk_id, is_short, is_long, has_control, suspicious_start FROM {FLAGS}")
def r2_flags(spark, d):
    return review.flags(chunks(spark, d)).drop("pagina", "texto")


@query(f"SELECT documento, chunk_id, is_duplicate FROM {FLAGS}")
def r3_duplicates(spark, d):
    return review.duplicates(chunks(spark, d)).select("documento", "chunk_id", "is_duplicate")


@query(f"SELECT documento, count(*) AS chunks, count(*) FILTER (WHERE bad) AS problems, round(100.0 * count(*) FILTER (WHERE bad) / count(*), 2)::DOUBLE AS percent, grouping(documento) = 1 AS total FROM (SELECT *, is_short OR is_long OR has_control OR is_duplicate AS bad FROM {FLAGS}) GROUP BY ROLLUP (documento)")
def r4_strong_problems(spark, d):
    return review.strong_problems(chunks(spark, d))


@query()
def r5_sample(spark, d):
    return review.sample(chunks(spark, d))


WANTED = {"the of": r"the\s+of", "digits": r"\b\d{1,2}\b", "license": r"License"}


@query("SELECT documento, chunk_id, pattern FROM (" + " UNION ALL ".join(f"SELECT documento, chunk_id, '{k}' AS pattern FROM {CHUNKS} WHERE regexp_matches(texto, '(?i){p}')" for k, p in WANTED.items()) + ")")
def r6_residual(spark, d):
    return review.residual(chunks(spark, d), WANTED)


@query("SELECT documento, pattern, times, times > 0 AS ok FROM (" + " UNION ALL ".join(f"SELECT documento, '{k}' AS pattern, len(regexp_extract_all(t, '(?i){p}')) AS times FROM (SELECT documento, string_agg(texto, chr(10) ORDER BY chunk_id) AS t FROM {CHUNKS} WHERE documento = 'src4' GROUP BY 1)" for k, p in WANTED.items()) + ")")
def r7_preserved(spark, d):
    return review.preserved(chunks(spark, d), "src4", WANTED).withColumn("times", F.col("times").cast("long"))


@query(SQL["r6_residual"])
def r6_residual_all_patterns(spark, d):
    return r6_residual(spark, d)


@query(SQL["r7_preserved"])
def r7_preserved_all_patterns(spark, d):
    return r7_preserved(spark, d)


@query(f"SELECT b.documento, b.chunk_id, length({STRIP('b.texto')}) AS before, length({STRIP('a.texto')}) AS after FROM {CHUNKS} b JOIN {SCRUBBED} a USING (documento, chunk_id) WHERE {STRIP('b.texto')} <> {STRIP('a.texto')}")
def r8_diff(spark, d):
    out = review.diff(chunks(spark, d), scrubbed(spark, d))
    return out.withColumns({c: F.col(c).cast("long") for c in ("before", "after")})


@query(f"SELECT count(DISTINCT documento) AS documents, count(*) AS chunks, sum(length(texto))::BIGINT AS chars, count(*) FILTER (WHERE is_short) AS is_short, count(*) FILTER (WHERE is_long) AS is_long, count(*) FILTER (WHERE has_control) AS has_control, count(*) FILTER (WHERE suspicious_start) AS suspicious_start, count(*) FILTER (WHERE is_duplicate) AS is_duplicate FROM {FLAGS}")
def r9_corpus_totals(spark, d):
    return review.corpus_totals(chunks(spark, d))


@query(f"SELECT n AS documento, (SELECT count(*) FROM {SCRUBBED} s WHERE s.documento = n) AS chunks, NOT EXISTS (SELECT 1 FROM {SCRUBBED} s WHERE s.documento = n) AS ok FROM (VALUES ('src3'), ('src4')) v(n)")
def r10_absent(spark, d):
    return review.absent(scrubbed(spark, d), ["src3", "src4"])


# ---- search -------------------------------------------------------------------------------------------------------------------
PLAIN = r"regexp_replace(replace(strip_accents(lower({})), 'ß', 'ss'), '[^a-z0-9\s]', ' ', 'g')".format


def plain(c: str) -> Column:
    return F.regexp_replace(F.replace(text.strip_accents(F.col(c)), F.lit("ß"), F.lit("ss")), r"[^a-z0-9\s]", " ")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id_fragmento"), "embedding")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


DENSE = "(SELECT q.vec_id AS query_id, e.vec_id AS id_fragmento, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS semantic FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)"


def _terms_sql(key: str, source: str) -> str:
    w = rf"(SELECT {key}, regexp_extract_all({PLAIN('text')}, '\b\w\w+\b') AS w FROM {source})"
    return f"(SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(w) AS term FROM {w} UNION ALL SELECT {key}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {w}) GROUP BY 1, 2)"


_VOCABULARY = f"v AS (SELECT term, ln((1 + n) / (1.0 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), (SELECT count(*)::DOUBLE AS n FROM documents) WHERE df <= 0.95 * n)"
_WEIGHTS = f"WITH tf AS (SELECT * FROM {_terms_sql('doc_id', 'documents')}), {_VOCABULARY}, raw AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN v USING (term)), wt AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"


_INDEXES: dict[tuple[str, str], search.Index] = {}


def model(spark: SparkSession, d: str) -> search.Index:
    """The index of all documents, written once in an application; later queries read it."""
    known = spark.sparkContext.applicationId, d
    if known not in _INDEXES:
        _INDEXES[known] = indexed(spark, d)
    return _INDEXES[known]


def indexed(spark: SparkSession, d: str) -> search.Index:
    return search.tfidf_fit(read(spark, d, "documents").select(F.col("doc_id").alias("id_fragmento"), plain("text").alias("texto")))


@query("SELECT vec_id AS id_fragmento FROM embeddings WHERE vec_id % 3 = 0")
def e1_pending(spark, d):
    v = vectors(spark, d).withColumn("embedding", F.when(F.col("id_fragmento") % 3 != 0, F.col("embedding")))
    return search.pending(v).select("id_fragmento")


@query()
def e2_encode(spark, d):
    return search.encode(read(spark, d, "documents").select(F.col("doc_id").alias("id_fragmento"), F.col("text").alias("texto")), lambda: search.hashing_encoder(64))


@query("SELECT vec_id AS id_fragmento, CASE WHEN vec_id % 2 = 0 THEN embedding[1] END AS first, CASE WHEN vec_id % 2 = 0 THEN 'm' END AS modelo_embedding FROM embeddings")
def e3_store_vectors(spark, d):
    empty = vectors(spark, d).select("id_fragmento", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("modelo_embedding"), F.lit(None).cast("timestamp").alias("fecha_embedding"))
    out = search.store_vectors(empty, vectors(spark, d).where("id_fragmento % 2 = 0"), "m")
    return out.select("id_fragmento", F.col("embedding")[0].alias("first"), "modelo_embedding")


@query("SELECT s_suppkey AS id_fragmento, n_name AS documento, r_name AS fuente FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0")
def e4_searchable(spark, d):
    c = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id_fragmento"), F.col("s_nationkey").alias("id_documento"), F.col("s_name").alias("texto"), F.lit(1).alias("pagina"), F.array(F.lit(1.0)).alias("embedding"))
    docs = read(spark, d, "nation").select(F.col("n_nationkey").alias("id_documento"), F.col("n_name").alias("nombre"), F.col("n_regionkey").alias("id_fuente"), (F.col("n_nationkey") % 2 == 0).alias("incluido_rag"))
    return search.searchable(c, docs, read(spark, d, "region").select(F.col("r_regionkey").alias("id_fuente"), F.col("r_name").alias("nombre"))).select("id_fragmento", "documento", "fuente")


@query("SELECT vec_id AS id_fragmento, vec_id % 4 > 1 AS ok FROM embeddings")
def e5_valid_vectors(spark, d):
    v = vectors(spark, d).withColumn("embedding", F.when(F.col("id_fragmento") % 4 == 0, "[1, 2").when(F.col("id_fragmento") % 4 == 1, "[1, 2]").otherwise(F.to_json("embedding")))
    good, bad = search.valid_vectors(v, 64)
    return good.select("id_fragmento", F.lit(True).alias("ok")).union(bad.select("id_fragmento", F.lit(False)))


@query(f"SELECT query_id, id_fragmento, round(semantic, 6) AS semantic FROM {DENSE}")
def e6_dense_scores(spark, d):
    return search.dense_scores(vectors(spark, d), asked(spark, d)).withColumn("semantic", F.round("semantic", 6))


@query(f"{_WEIGHTS} SELECT term, round(idf, 6) AS idf FROM v")
def e7_tfidf_fit(spark, d):
    return indexed(spark, d).terms(spark).select("term", F.round("idf", 6).alias("idf"))


LEXICAL = f"qt AS (SELECT * FROM {_terms_sql('item_id', 'benchmark')}), q AS (SELECT item_id, term, tf * idf AS w FROM qt JOIN v USING (term)), qn AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS qw FROM q)"


@query(f"{_WEIGHTS}, {LEXICAL} SELECT item_id AS query_id, doc_id AS id_fragmento, round(sum(weight * qw), 6) AS lexical FROM wt JOIN qn USING (term) GROUP BY 1, 2")
def e8_lexical_scores(spark, d):
    queries_ = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), plain("text").alias("text"))
    return search.lexical_scores(model(spark, d), queries_).withColumn("lexical", F.round("lexical", 6))


@query(f"{_WEIGHTS}, {LEXICAL} SELECT query_id, id_fragmento, lexical, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, id_fragmento) AS rank FROM (SELECT item_id AS query_id, doc_id AS id_fragmento, round(sum(weight * qw), 6) AS lexical FROM wt JOIN qn USING (term) GROUP BY 1, 2)) WHERE rank <= 10 AND lexical > 0")
def e8_lexical_top_k(spark, d):
    queries_ = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), plain("text").alias("text"))
    return search.lexical_top_k(model(spark, d), queries_).withColumn("rank", F.col("rank").cast("long"))


_SCALED = f"(SELECT *, CASE WHEN hi > lo THEN (semantic - lo) / (hi - lo) ELSE 0 END AS scaled FROM (SELECT *, min(semantic) OVER (PARTITION BY query_id) AS lo, max(semantic) OVER (PARTITION BY query_id) AS hi FROM {DENSE}))"


@query(f"SELECT query_id, id_fragmento, round(scaled, 6) AS semantic FROM {_SCALED}")
def e9_minmax(spark, d):
    return search.scaled_scores(vectors(spark, d), asked(spark, d)).withColumn("semantic", F.round("semantic", 6))


def asked_both(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as queries, with the text of the document of the same number."""
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("query_id"), plain("text").alias("text"))
    return asked(spark, d).join(texts, "query_id", "left")


_FUSED = f"""{_WEIGHTS}, qt AS (SELECT doc_id AS query_id, term, tf FROM tf WHERE doc_id % 20 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)), q AS (SELECT query_id, term, tf * idf AS w FROM qt JOIN v USING (term)), qn AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS qw FROM q),
lx AS (SELECT query_id, doc_id AS id_fragmento, sum(weight * qw) AS lexical FROM wt JOIN qn USING (term) GROUP BY 1, 2),
b AS (SELECT query_id, id_fragmento, semantic, coalesce(lexical, 0) AS lexical FROM {DENSE} LEFT JOIN lx USING (query_id, id_fragmento)),
m AS (SELECT *, min(semantic) OVER p AS ls, max(semantic) OVER p AS hs, min(lexical) OVER p AS ll, max(lexical) OVER p AS hl FROM b WINDOW p AS (PARTITION BY query_id)),
s AS (SELECT query_id, id_fragmento, round(0.7 * CASE WHEN hs > ls THEN (semantic - ls) / (hs - ls) ELSE 0 END + 0.3 * CASE WHEN hl > ll THEN (lexical - ll) / (hl - ll) ELSE 0 END, 6) AS score FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id_fragmento) AS rank FROM s)"""


@query(f"{_FUSED} SELECT query_id, id_fragmento, score, rank FROM r WHERE rank <= 10")
def e10_e11_hybrid_top_k(spark, d):
    return search.hybrid_top_k(vectors(spark, d), model(spark, d), asked_both(spark, d), dim=64).select("query_id", "id_fragmento", "score", F.col("rank").cast("long").alias("rank"))


@query(f"{_FUSED} SELECT e.query_id, e.id_fragmento, rank, score FROM (SELECT vec_id AS query_id, vec_id + 1 AS id_fragmento FROM embeddings WHERE vec_id % 20 = 0) e LEFT JOIN r USING (query_id, id_fragmento)")
def e12_rank_of(spark, d):
    expected = asked(spark, d).select("query_id", (F.col("query_id") + 1).alias("id_fragmento"))
    return search.rank_of(vectors(spark, d), model(spark, d), asked_both(spark, d), expected, dim=64).select("query_id", "id_fragmento", F.col("rank").cast("long").alias("rank"), "score")


# ---- warehouse ----------------------------------------------------------------------------------------------------------------
@query("SELECT count(*) AS n, min(doc_id) AS least FROM documents")
def l1_seeded_counts(spark, d):
    dims = warehouse.seed(spark)
    kinds = rated(spark, d).select("doc_id", F.col("kind").alias("tipo_contenido"))
    return warehouse.lookup(kinds, dims["tipos_contenido"], "tipo_contenido", "id_tipo_contenido").where("id_tipo_contenido is not null").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))


@query("WITH d AS (SELECT 1 AS id, 'click' AS nombre), n AS (SELECT DISTINCT event_type AS nombre FROM events WHERE event_type <> 'click') SELECT id, nombre FROM d UNION ALL SELECT 1 + row_number() OVER (ORDER BY nombre), nombre FROM n")
def l2_l5_get_or_create(spark, d):
    dim = spark.createDataFrame([(1, "CLICK")], "id long, nombre string")
    out, _ = warehouse.get_or_create(dim, read(spark, d, "events").select(F.col("event_type").alias("nombre")), ["nombre"], "id")
    return out.withColumn("nombre", F.lower("nombre"))


@query("SELECT c_custkey, CASE WHEN r_name <> 'ASIA' THEN r_regionkey END AS r_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def l3_lookup(spark, d):
    named = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.lower("r_name").alias("zone")), "n_regionkey")
    return warehouse.lookup(named, read(spark, d, "region").where("r_name != 'ASIA'"), "zone", "r_regionkey", "r_name").select("c_custkey", "r_regionkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 1 WHEN o_orderstatus = 'F' THEN 2 END AS k FROM orders")
def l4_lookup_null_safe(spark, d):
    dim = spark.createDataFrame([("F", None, 1), ("F", "odd", 2), ("F", None, 3)], "s string, parity string, k int")
    fact = read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"), F.when(F.col("o_orderkey") % 2 != 0, "odd").alias("parity"))
    return warehouse.lookup_null_safe(fact, dim, ["s", "parity"], "k").select("o_orderkey", "k")


_PLACE = ", ".join(warehouse.PLACE)
_DIM = "(SELECT generate_subscripts([{0}], 1) AS k, unnest([{0}]) AS n)".format
_KEYED = f"SELECT row_number() OVER (ORDER BY {', '.join(f'{c} NULLS FIRST' for c in warehouse.PLACE)}) AS k, {_PLACE} FROM (SELECT DISTINCT {_PLACE} FROM posts)"


@query(f"""WITH posts AS ({POSTS}), places AS ({_KEYED})
SELECT 1 AS id_fuente, CAST(a.k AS INTEGER) AS id_ambito, NULL::INTEGER AS id_tipo_violencia, CAST(t.k AS INTEGER) AS id_tipo_contenido, CAST(u.k AS INTEGER) AS id_ubicacion, archivo_origen, anio_publicacion, anio_mencionado, usuario, texto_original, texto_limpio,
violencia_mujer AS violencia_contra_mujer, es_basura, motivo_basura, nivel_confianza, '{{"tipo_violencia_archivo":"' || tipo_violencia_archivo || '"' || coalesce(',"fecha":' || CAST(to_json(fecha) AS VARCHAR), '') || '}}' AS datos_extra
FROM posts LEFT JOIN {_DIM(quoted(lexicons.SCOPES))} a ON a.n = tipo_violencia_archivo LEFT JOIN {_DIM(quoted(lexicons.CONTENT_TYPES))} t ON t.n = tipo_contenido
LEFT JOIN places u ON {' AND '.join(f'u.{c} IS NOT DISTINCT FROM posts.{c}' for c in warehouse.PLACE)}""")
def l6_post_facts(spark, d):
    cleaned = p10_clean_posts(spark, d)
    seeds = warehouse.seed(spark)
    places, _ = warehouse.get_or_create(spark.createDataFrame([], "id_ubicacion int, lugar_detectado string, municipio_alcaldia string, estado string, nivel_ubicacion string"), cleaned, warehouse.PLACE, "id_ubicacion")
    return warehouse.post_facts(cleaned, seeds | {"ubicaciones": places}, 1)


@query(f"SELECT 3 AS id_fuente, entidad, anio, CAST(valor / 1000 AS DECIMAL(8,2)) AS valor, 'porcentaje' AS unidad FROM {F1} WHERE n_regionkey <> 2")
def l7_indicator_facts(spark, d):
    facts = first_source(spark, d).withColumn("valor", F.when(F.col("n_regionkey") != 2, F.col("valor") / 1000))
    return warehouse.indicator_facts(facts, "nested", 3).select("id_fuente", "entidad", F.col("anio").cast("long").alias("anio"), "valor", "unidad")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'value: type' ELSE NULL END AS a, CASE WHEN event_type = 'error' THEN 'event_type: value' END AS b FROM events WHERE event_id % 5 = 0 OR event_type = 'error'")
def l8_enforce(spark, d):
    raw = read(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.col("value").cast("string")).alias("value"), "event_type")
    types = read(spark, d, "events").where("event_type != 'error'").select("event_type")
    _, bad = warehouse.enforce(raw, "event_id long, value double, event_type string", {"event_type": types})
    has = lambda x: F.when(F.array_contains("reasons", x), F.lit(x))
    return bad.select(F.col("event_id").cast("long").alias("event_id"), has("value: type").alias("a"), has("event_type: value").alias("b"))


@query("SELECT source AS nombre, count(*) AS total_chunks, count(DISTINCT doc_id % 7) AS total_paginas, 9 AS id_fuente FROM documents WHERE source <> 'src5' GROUP BY 1")
def l9_documents(spark, d):
    sources = read(spark, d, "documents").where("source != 'src5'").select(F.col("source").alias("documento")).distinct().withColumn("id_fuente", F.lit(9))
    return warehouse.documents(chunks(spark, d), sources)[0]


@query("SELECT CAST(substr(source, 4) AS INT) AS id_documento, doc_id AS chunk_id, doc_id % 7 AS pagina FROM documents WHERE source <> 'src5'")
def l10_chunk_facts(spark, d):
    docs = read(spark, d, "documents").where("source != 'src5'").select(F.col("source").alias("nombre")).distinct().withColumn("id_documento", F.substring("nombre", 4, 9).cast("int"))
    return warehouse.chunk_facts(chunks(spark, d), docs).drop("texto")


@query("SELECT count(*) AS rows, count(DISTINCT source) AS documents FROM documents")
def l11_guarded_load(spark, d):
    keyed = chunks(spark, d).withColumn("id_documento", F.substring("documento", 4, 9).cast("int")).select("id_documento", "chunk_id", "texto")
    new = keyed.where("id_documento = 1").drop("id_documento")
    docs = keyed.select("id_documento").distinct().withColumns({"total_chunks": F.lit(0), "incluido_rag": F.lit(False)})
    facts, _ = warehouse.guarded_load(new, keyed.where("id_documento != 1"), docs, 1, new.count())
    return facts.agg(F.count("*").alias("rows"), F.count_distinct("id_documento").alias("documents"))


@query("SELECT n_nationkey, n_name AS nombre, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS url FROM nation")
def l12_update_attributes(spark, d):
    docs = read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nombre"), F.lit("old").alias("url"))
    attrs = docs.where("n_nationkey % 2 = 0").select("nombre", F.lit("new").alias("url"))
    return warehouse.update_attributes(docs, attrs)[0]


# ---- analytics ----------------------------------------------------------------------------------------------------------------
@query(f"SELECT entidad, anio, valor FROM {F1} WHERE entidad = 'NATION_6' ORDER BY 1, 2, 3 LIMIT 100")
def q1_select(spark, d):
    return analytics.select(first_source(spark, d), {"entidad": "NATION_6"}, ["entidad", "anio", "valor"])


@query(f"SELECT entidad, anio, valor FROM {F1} ORDER BY valor DESC, entidad, anio LIMIT 1")
def q2_extreme(spark, d):
    return analytics.extreme(first_source(spark, d).select("entidad", "anio", "valor"), ties=["entidad", "anio"])


@query(f"SELECT anio, max(valor) AS valor FROM {F1} GROUP BY 1")
def q2_extreme_by(spark, d):
    return analytics.extreme_by(first_source(spark, d), "anio").select("anio", "valor")


@query(f"SELECT entidad, anio, valor FROM {F1} ORDER BY valor, entidad, anio LIMIT 5")
def q3_bottom_five(spark, d):
    return analytics.extreme(first_source(spark, d).select("entidad", "anio", "valor"), n=5, ascending=True, ties=["entidad", "anio"])


@query("SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F'")
def q4_count(spark, d):
    return analytics.count(read(spark, d, "orders"), {"o_orderstatus": "F"})


@query(f"SELECT round(avg(valor), 4) AS promedio FROM {F1} WHERE anio IN (1996, 1997)")
def q5_average(spark, d):
    return analytics.average(first_source(spark, d), {"anio": [1996, 1997]}).withColumn("promedio", F.round("promedio", 4))


@query("SELECT min(l_extendedprice) AS minimo, max(l_extendedprice) AS maximo FROM lineitem WHERE l_returnflag = 'R'")
def q6_bounds(spark, d):
    return analytics.bounds(read(spark, d, "lineitem"), {"l_returnflag": "R"}, "l_extendedprice")


def orders_at(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    fact = read(spark, d, "orders").select(F.col("o_custkey").alias("place"), F.year("o_orderdate").cast("long").alias("anio"), "o_totalprice")
    dim = read(spark, d, "customer").select(F.col("c_custkey").alias("place"), F.col("c_mktsegment").alias("estado"))
    return fact, dim


@query("SELECT count(*) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def q7_count_at_place(spark, d):
    return analytics.count_by(*orders_at(spark, d), on=["place"], filters={"estado": "BUILDING"})


@query("SELECT year(o_orderdate) AS anio, count(*) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def q8_count_by_year_at_place(spark, d):
    return analytics.count_by(*orders_at(spark, d), on=["place"], keys=["anio"], filters={"estado": "BUILDING"})


@query(f"SELECT anio, count(*) AS total FROM {F2} GROUP BY 1")
def q9_count_by_year(spark, d):
    return analytics.count_by(second_source(spark, d), keys=["anio"])


@query(f"SELECT * FROM (SELECT 'A' AS fuente, entidad, anio, valor FROM {F1} WHERE entidad = 'NATION_17' UNION ALL SELECT 'B', entidad, anio, valor FROM {F2} WHERE entidad = 'NATION_17') ORDER BY 1, 2, 3, 4 LIMIT 100")
def q10_labelled_union(spark, d):
    return analytics.labelled_union({"A": first_source(spark, d), "B": second_source(spark, d)}, ["entidad", "anio", "valor"], {"entidad": "NATION_17"})


@query(f"SELECT entidad, anio, valor FROM {F1} WHERE entidad IN ('NATION_18', 'NATION_8')")
def q11_compare(spark, d):
    return analytics.compare(first_source(spark, d), ["NATION_18", "NATION_8"]).select("entidad", "anio", "valor")


@query("SELECT n_name, n_nationkey FROM nation")
def q12_listing(spark, d):
    return analytics.listing(read(spark, d, "nation"), ["n_name", "n_nationkey"])


@query(f"SELECT entidad, anio, valor FROM {F1} WHERE anio = 1996 ORDER BY valor, entidad LIMIT 1")
def q13_lowest_in_year(spark, d):
    return analytics.extreme(first_source(spark, d).select("entidad", "anio", "valor"), {"anio": 1996}, ascending=True, ties=["entidad"])


@query("SELECT n_name, r_name, count(*) AS total FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def q14_star(spark, d):
    nation, region = read(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), read(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return analytics.star(read(spark, d, "customer"), [(nation, "c_nationkey"), (region, "n_regionkey")]).groupBy("n_name", "r_name").agg(F.count("*").alias("total"))


# ---- questions, sources, sinks ------------------------------------------------------------------------------------------------
LISTS = {"new_query": ("que", "die"), "follow_up": ("the", "le "), "entities": ("of", "und", "les", "pour")}


@query(f"SELECT conv_id, turn, role, CASE WHEN len(list_filter([{quoted(LISTS['new_query'])}], lambda w: contains(lower(text), w))) > 0 THEN 'new_query' WHEN len(list_filter([{quoted(LISTS['follow_up'])}], lambda w: contains(lower(text), w))) > 0 THEN 'follow_up' ELSE 'neither' END AS route, array_to_string(list_filter([{quoted(LISTS['entities'])}], lambda w: contains(lower(text), w)), ',') AS entities FROM conversations")
def n1_route_questions(spark, d):
    return questions.route_questions(read(spark, d, "conversations"), "text", LISTS).select("conv_id", "turn", "role", "route", F.array_join("entities", ",").alias("entities"))


STATEMENT = "CASE doc_id % 4 WHEN 0 THEN 'SELECT n FROM t' || doc_id || ';' WHEN 1 THEN 'NO_SE_PUEDE_CONSULTAR' WHEN 2 THEN 'select updated_at from t' ELSE 'DROP t; x' END"


def said(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("```sql\nSure: SELECT n FROM t"), F.col("doc_id").cast("string"), F.lit("; done```"))).when(k == 1, "I say no_se_puede_consultar.").when(k == 2, " ```select updated_at from t``` ").otherwise("DROP t; x")
    return read(spark, d, "documents").select("doc_id", questions.extract_statement(raw).alias("statement"))


@query(f"SELECT doc_id, {STATEMENT} AS statement FROM documents")
def n2_extract_statement(spark, d):
    return said(spark, d)


@query(f"SELECT doc_id, {STATEMENT} AS statement, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'refused' WHEN 2 THEN 'banned word' ELSE 'not a select' END AS reason, doc_id % 4 = 0 AS allowed FROM documents")
def n3_screen_statements(spark, d):
    return questions.screen_statements(said(spark, d), "statement")


@query(r"SELECT CAST(page_id AS VARCHAR) AS file, regexp_extract(url, '^[a-z]+') AS scheme, length(url) AS n FROM pages")
def s4_html_tables(spark, d):
    made = F.concat("html", F.lit("<table><tr><td></td></tr><tr><td> "), F.regexp_extract("url", "^[a-z]+", 0), F.lit("<td></td><td>"), F.length("url").cast("string"), F.lit("</td></tr></table>"))
    cells = readers.html_tables(read(spark, d, "pages").select(F.col("page_id").cast("string").alias("file"), made.alias("html")))
    return cells.select("file", F.col("cells")[0].alias("scheme"), F.col("cells")[1].cast("long").alias("n"))


@query(f"SELECT 'lang' AS metric, '{{' || string_agg('\"' || lang || '\":' || n, ',' ORDER BY lang) || '}}' AS json FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def s8_summary_json(spark, d):
    long = read(spark, d, "documents").groupBy(F.lit("lang").alias("metric"), F.col("lang").alias("key")).agg(F.count("*").alias("value"))
    return writers.summary(long)
