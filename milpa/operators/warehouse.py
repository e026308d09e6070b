"""Warehouse: seed dimensions, get-or-create with new keys, null-safe look-ups, fact builds, typing, guarded loads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from milpa.functions import lexicons, text
from milpa.storage import written

PLACE = ("lugar_detectado", "municipio_alcaldia", "estado", "nivel_ubicacion")


def seed(spark: SparkSession) -> dict[str, DataFrame]:
    """L1: the fixed dimension rows."""
    rows = lambda key, names: spark.createDataFrame([(i, n) for i, n in enumerate(names, 1)], f"{key} int, nombre string")
    sources = spark.createDataFrame([(i, *r) for i, r in enumerate(lexicons.SOURCES, 1)], "id_fuente int, nombre string, tipo_fuente string, url string, descripcion string").withColumn("fecha_consulta", F.current_date())
    return {"fuentes": sources, "ambitos_violencia": rows("id_ambito", lexicons.SCOPES), "tipos_violencia": rows("id_tipo_violencia", lexicons.VIOLENCE_TYPES), "tipos_contenido": rows("id_tipo_contenido", lexicons.CONTENT_TYPES)}


def folded(c: Column) -> Column:
    """How names are compared: any case, accents and blanks at the ends aside."""
    return text.strip_accents(F.trim(c))


def get_or_create(dim: DataFrame, incoming: DataFrame, keys: Sequence[str], key_col: str) -> tuple[DataFrame, DataFrame]:
    """``(dimension, new rows)``: combinations not yet there, nulls equal, get the next keys in order.

    New rows are numbered within ranges of their order, and ranges by their counts, so that no task holds all of them. The ranges are a written
    table: they are drawn once, whatever is planned, reused or tried again afterwards.
    """
    known = dim.select(*(F.col(k).alias(f"_{k}") for k in keys))
    fresh = incoming.select(*keys).distinct()
    match = None
    for k in keys:
        one = folded(fresh[k]).eqNullSafe(folded(known[f"_{k}"])) if dict(fresh.dtypes)[k] == "string" else fresh[k].eqNullSafe(known[f"_{k}"])
        match = one if match is None else match & one
    fresh = fresh.join(known, match, "left_anti")
    if any(t == "string" for _, t in fresh.dtypes):  # spellings that are compared as equal are one
        fresh = fresh.groupBy(*(folded(F.col(k)).alias(f"_{k}") if t == "string" else F.col(k).alias(f"_{k}") for k, t in fresh.dtypes)).agg(F.min(F.struct(*keys)).alias("r")).select("r.*")
    top = dim.agg(F.coalesce(F.max(key_col), F.lit(0)).alias("top"))
    ranged = written(fresh.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = counts.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    new = ranged.withColumn("_n", place).join(F.broadcast(before), "_part").join(F.broadcast(top)).withColumn(key_col, (F.col("_n") + F.col("_before") + F.col("top")).cast(dim.schema[key_col].dataType)).select(*keys, key_col)
    return dim.unionByName(new, allowMissingColumns=True), new


def existing_key(dim: DataFrame, name: str, key_col: str, name_col: str = "nombre") -> int:
    """L2, strict: the key of a row that must be there; an error if it isn't."""
    row = dim.where(F.col(name_col) == name).agg(F.min(key_col).alias("k")).first()
    if row["k"] is None:
        raise ValueError(f"no {name_col} {name!r} in the dimension")
    return row["k"]


def lookup(fact: DataFrame, dim: DataFrame, name_col: str, key_col: str, dim_name: str = "nombre") -> DataFrame:
    """L3: adds the key of the name, case and accents aside; unknown names give null."""
    d = dim.groupBy(folded(F.col(dim_name)).alias("_name")).agg(F.min(key_col).alias(key_col))
    return fact.join(d, folded(fact[name_col]) == d["_name"], "left").drop("_name")


def lookup_null_safe(fact: DataFrame, dim: DataFrame, cols: Sequence[str], key_col: str, needed: Sequence[str] = ("estado",)) -> DataFrame:
    """L4: adds the key of a combination in which nulls are equal; a null in a column of ``needed`` (the state) gives null."""
    d = dim.groupBy(*(F.col(c).alias(f"_{c}") for c in cols)).agg(F.min(key_col).alias(key_col))
    match = None
    for c in cols:
        one = fact[c] == d[f"_{c}"] if c in needed else fact[c].eqNullSafe(d[f"_{c}"])
        match = one if match is None else match & one
    return fact.join(d, match, "left").drop(*(f"_{c}" for c in cols))


def post_facts(posts: DataFrame, dims: Mapping[str, DataFrame], source_key: int) -> DataFrame:
    """Cleaned posts with keys of scope, content type and place; defaults for flags; topic kept aside as JSON."""
    out = lookup(posts, dims["ambitos_violencia"], "tipo_violencia_archivo", "id_ambito")
    out = lookup(out, dims["tipos_contenido"], "tipo_contenido", "id_tipo_contenido")
    out = lookup_null_safe(out, dims["ubicaciones"], PLACE, "id_ubicacion")
    return out.select(
        F.lit(source_key).alias("id_fuente"),
        "id_ambito",
        F.lit(None).cast("int").alias("id_tipo_violencia"),
        "id_tipo_contenido",
        "id_ubicacion",
        "archivo_origen",
        "anio_publicacion",
        "anio_mencionado",
        "usuario",
        "texto_original",
        "texto_limpio",
        F.coalesce("violencia_mujer", F.lit("incierto")).alias("violencia_contra_mujer"),
        F.coalesce("es_basura", F.lit("no")).alias("es_basura"),
        "motivo_basura",
        "nivel_confianza",
        F.to_json(F.struct("tipo_violencia_archivo", "fecha")).alias("datos_extra"),
    )


#: By kind the columns of a fact, the default unit, and whether rows without a value are left out.
INDICATORS = {
    "csv": (("codigo_indicador", "nombre_indicador", "categoria_indicador", "ambito", "agresor", "periodo_medicion", "poblacion_objetivo", "entidad", "anio", "valor", "unidad"), "porcentaje", False),
    "nested": (("tema", "subtema", "nombre_indicador", "entidad", "anio", "categoria", "valor", "unidad"), "porcentaje", True),
    "wide": (("archivo_origen", "numero_tabla", "nombre_indicador", "categoria", "subcategoria", "anio", "valor", "unidad"), "conteo", False),
}


def indicator_facts(df: DataFrame, kind: str, source_key: int) -> DataFrame:
    """A typed fact; columns that the kind doesn't know are packed into ``datos_extra`` as JSON."""
    columns, unit, need = INDICATORS[kind]
    extra = [c for c in df.columns if c not in columns]
    value = F.col("valor").cast("decimal(12,2)" if kind == "wide" else "decimal(8,2)")
    cell = lambda c: (F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c)
    out = df.where("valor is not null") if need else df
    return out.select(
        F.lit(source_key).alias("id_fuente"),
        *(value.alias("valor") if c == "valor" else F.coalesce(cell("unidad"), F.lit(unit)).alias("unidad") if c == "unidad" else F.col("anio").cast("int").alias("anio") if c == "anio" else cell(c) for c in columns),
        (F.to_json(F.struct(*extra)) if extra else F.lit(None).cast("string")).alias("datos_extra"),
    )


def enforce(df: DataFrame, schema: T.StructType | str, allowed: Mapping[str, Sequence[str] | DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows that fit, rejects with reasons)``: casts that fail and values outside the allowed ones are reasons.

    Allowed values are a list, or the first column of a table, which is joined. Reasons are in ``reasons``, or in ``reject_reasons`` where the rows
    have a column of that name.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    checks = [F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), F.lit(f"{f.name}: type")) for f in schema.fields]
    joined = []
    for c, values in (allowed or {}).items():
        if isinstance(values, DataFrame):
            joined.append(f"_allowed_{c}")
            df = df.join(values.select(F.col(values.columns[0]).alias(joined[-1])).distinct(), F.col(c) == F.col(joined[-1]), "left")
            unknown = F.col(joined[-1]).isNull()
        else:
            unknown = ~F.col(c).isin(*values)
        checks.append(F.when(F.col(c).isNotNull() & unknown, F.lit(f"{c}: value")))
    told = "reject_reasons" if "reasons" in df.columns else "reasons"
    marked = df.withColumn(told, F.array_compact(F.array(*checks))).drop(*joined)
    return marked.where(f"size({told}) = 0").select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields)), marked.where(f"size({told}) > 0")


def documents(chunks: DataFrame, source_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(documents with source and count of chunks, names without a source)``; names compared in composed form."""
    per = chunks.groupBy(text.compose(F.col("documento")).alias("nombre")).agg(F.count("*").alias("total_chunks"), F.count_distinct("pagina").alias("total_paginas"))
    out = per.join(source_map.select(text.compose(F.col("documento")).alias("nombre"), "id_fuente"), "nombre", "left")
    return out.where("id_fuente is not null"), out.where("id_fuente is null").select("nombre", "total_chunks")


def chunk_facts(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with their document's key."""
    return chunks.withColumn("nombre", text.compose(F.col("documento"))).join(docs.select("id_documento", text.compose(F.col("nombre")).alias("nombre")), "nombre").select("id_documento", "chunk_id", "pagina", "texto")


def guarded_load(chunks: DataFrame, existing: DataFrame, docs: DataFrame, doc_key: int, expected: int) -> tuple[DataFrame, DataFrame]:
    """``(facts with the chunks added, documents updated)``; an error, and nothing, if counts, document or earlier chunks don't fit."""
    found = (
        chunks.agg(F.count("*").alias("n")).join(F.broadcast(docs.where(F.col("id_documento") == doc_key).agg(F.count("*").alias("d")))).join(F.broadcast(existing.where(F.col("id_documento") == doc_key).agg(F.count("*").alias("e"))))
    ).first()
    if found["n"] != expected or found["d"] != 1 or found["e"]:
        raise ValueError(f"not loaded: {found['n']} chunks (expected {expected}), document found {found['d']} times, {found['e']} chunks there already")
    mine = F.col("id_documento") == doc_key
    return existing.unionByName(chunks.withColumn("id_documento", F.lit(doc_key)), allowMissingColumns=True), docs.withColumns({"total_chunks": F.when(mine, F.lit(expected)).otherwise(F.col("total_chunks")), "incluido_rag": F.when(mine, F.lit(True)).otherwise(F.col("incluido_rag"))})


def update_attributes(docs: DataFrame, attrs: DataFrame, key: str = "nombre") -> tuple[DataFrame, DataFrame]:
    """``(documents with new attribute values by composed name, attributes of unknown documents)``. Of several values for a name the greatest counts."""
    columns = [c for c in attrs.columns if c != key]
    a = attrs.groupBy(text.compose(F.col(key)).alias("_k")).agg(*(F.max(c).alias(f"_{c}") for c in columns))
    out = docs.withColumn("_k", text.compose(F.col(key))).join(a, "_k", "left")
    updated = out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(*docs.columns)
    known = docs.select(text.compose(F.col(key)).alias("_k")).distinct()
    return updated, attrs.withColumn("_k", text.compose(F.col(key))).join(known, "_k", "left_anti").drop("_k")
