"""Queries of this subpackage and their SQL; each runs one operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milpa.llm import chat, decontam, divergence, lm, media, neardup, pages, pieces, quality, ranked, substrings, tokenbin, treebpe
from milpa.llm._shared import table


def tokenizer(name: str, folder: str | None = None) -> str:
    """The path of a public tokenizer's file, in ``folder`` or where the installed package has it."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.written_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), pieces.Unigram.load(tokenizer("piece_bpe_32k.model")))


def op5_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_host_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op7_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digests(table(spark, sf_dir, "documents"), length=400)


def op8_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read(media.store(table(spark, sf_dir, "documents")))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.size("clips").cast("long").alias("n_clips"))


def op9_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op10_schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    probe = spark.range(2).selectExpr("-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role").withColumn("text", F.lit(said))
    return chat.digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe))


def op11_chunk_factorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=30, top=50)


def op12_tree_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("byte_bpe_50k.json")
    coded = treebpe.decode(treebpe.encode(table(spark, sf_dir, "documents"), path), path)
    return coded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op13_accumulator_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {"op11_chunk_factorization": op11_chunk_factorization, "op12_tree_concatenation": op12_tree_concatenation, "op13_accumulator_limited": op13_accumulator_limited, "op2_context_mixing": op2_context_mixing, "pipeline": pipeline, "op6_host_consensus": op6_host_consensus, "op8_avi_mjpeg": op8_avi_mjpeg, "op10_schema_fingerprint": op10_schema_fingerprint, "op4_sentencepiece": op4_sentencepiece, "op5_pigeonhole": op5_pigeonhole, "op1_cotraining": op1_cotraining, "op7_difference_cover": op7_difference_cover, "op9_backoff_automaton": op9_backoff_automaton, "op3_superminhash": op3_superminhash}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NEAR_COPIES = rf"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS x FROM worded),
sets AS (SELECT min(doc_id) AS id, x FROM shingled WHERE len(x) > 0 GROUP BY x),
parts AS (SELECT id, len(x) AS n, unnest(x) AS sh FROM sets),
linked AS (
  SELECT a.id AS a, b.id AS b FROM parts a JOIN parts b ON a.sh = b.sh AND a.id < b.id
  GROUP BY a.id, b.id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach(a, b) AS (SELECT id, id FROM sets UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b),
named AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)
SELECT doc_id, len(shingled.x)::BIGINT AS n_shingles, coalesce(component, doc_id)::BIGINT AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM shingled LEFT JOIN sets USING (x) LEFT JOIN named USING (id)
"""

_REPEATS = r"""
WITH bytes AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS nb FROM documents),
blocks AS (SELECT rid, 400 * b AS base, substr(h, 800 * b + 1, 1598) AS p FROM (SELECT rid, h, unnest(range(0, (nb + 399) // 400)) AS b FROM bytes)),
starts AS MATERIALIZED (
  SELECT rid, base + j AS i, md5_number(substr(p, 2 * j + 1, 800)) AS k
  FROM (SELECT rid, base, p, unnest(range(0, length(p) // 2 - 399)) AS j FROM blocks WHERE length(p) >= 800)),
again AS (SELECT rid, i FROM starts WHERE k IN (SELECT k FROM starts GROUP BY k HAVING count(*) > 1)),
stepped AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 400 THEN 0 ELSE 1 END AS step FROM again),
numbered AS (SELECT rid, i, sum(step) OVER (PARTITION BY rid ORDER BY i) AS run FROM stepped),
runs AS (SELECT rid, min(i) AS lo, max(i) + 400 AS hi FROM numbered GROUP BY rid, run),
gaps AS (
  SELECT rid, 0 AS lo, coalesce(min(runs.lo), any_value(nb)) AS hi FROM bytes LEFT JOIN runs USING (rid) GROUP BY rid
  UNION ALL SELECT rid, hi, coalesce(lead(lo) OVER (PARTITION BY rid ORDER BY lo), nb) FROM runs JOIN bytes USING (rid)),
kept AS (SELECT rid, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS k FROM gaps JOIN bytes USING (rid) GROUP BY rid),
removed AS (SELECT rid, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY rid),
pieces AS (SELECT rid, unnest(regexp_extract_all(t, '[ 	-
]+|[^ 	-
]+')) AS p, generate_subscripts(regexp_extract_all(t, '[ 	-
]+|[^ 	-
]+'), 1) AS pos FROM bytes),
placed AS (SELECT rid, pos, p, sum(strlen(p)) OVER (PARTITION BY rid ORDER BY pos) AS stop FROM pieces),
passages AS (
  SELECT rid, stop - strlen(p) AS lo, lead(stop, 50) OVER w AS hi, md5_number(string_agg(p, ' ') OVER (w ROWS BETWEEN CURRENT ROW AND 50 FOLLOWING)) AS k
  FROM placed WHERE NOT regexp_matches(p, '^[ 	-
]') WINDOW w AS (PARTITION BY rid ORDER BY pos)),
told AS (SELECT rid, lo, hi FROM passages WHERE hi IS NOT NULL AND k IN (SELECT k FROM passages WHERE hi IS NOT NULL GROUP BY k HAVING count(*) > 1)),
covered AS (SELECT rid, sum(hi - greatest(lo, coalesce(before, 0)))::BIGINT AS n FROM (SELECT rid, lo, hi, lag(hi) OVER (PARTITION BY rid ORDER BY lo) AS before FROM told) GROUP BY rid)
SELECT doc_id, nb AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256, coalesce(n, 0) AS n_passage_bytes
FROM bytes LEFT JOIN kept USING (rid) LEFT JOIN removed USING (rid) LEFT JOIN covered USING (rid)
"""

_CHATS = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, i, if(i = 0, 'user', 'assistant'), '\### Assistant: </turn> ok' FROM range(2) r(i)),
coded AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '</turn', '\l/turn'), '### ', '\h## ') AS body,
    replace(replace(replace(replace(role, '\', '\b'), '</turn', '\l/turn'), '### ', '\h## '), ':', '\c') AS head FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ') + length(head) + length(': ') + length(body) + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM coded GROUP BY conv_id
"""

_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang,'') AS lang, coalesce(source,'') AS source,
    regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
counts AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT lang, source, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) USING (lang)),
whole AS (SELECT lang, term, 1 + (1000000000 * (c + 5)::HUGEINT) // (sum(c) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM kept),
shares AS (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 5)::HUGEINT) // (n + 5 * v) AS p FROM grp JOIN (SELECT lang, term FROM kept) USING (lang) LEFT JOIN counts USING (lang, source, term)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares JOIN whole USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (FROM pairs UNION ALL FROM terms)
QUALIFY part = 'pair' OR rank <= 50
"""

_RANKED = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS rid FROM documents),
size AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY ALL),
asked AS (SELECT item_id, text, term, count(*) AS times FROM (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term, generate_subscripts(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), 1) AS at FROM benchmark) GROUP BY ALL),
weighed AS (SELECT term, floor(1000 * ln((2.0 * n + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf SEMI JOIN asked USING (term) GROUP BY term), size),
long AS (SELECT rid, doc_id, 25 + (75 * len(w) * n) // l AS m FROM d, size WHERE len(w) > 0),
scored AS (SELECT item_id, text, rid, any_value(doc_id) AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weighed USING (term) JOIN tf USING (term) JOIN long USING (rid) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

#: The other operators have no SQL; their tests hold them against brute force, exact round trips or held-out accuracy.
ORACLE_SQL: dict[str, str] = {"op3_superminhash": _NEAR_COPIES, "op7_difference_cover": _REPEATS, "op10_schema_fingerprint": _CHATS, "op11_chunk_factorization": _DIVERGENCE, "op13_accumulator_limited": _RANKED}
