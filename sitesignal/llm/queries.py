"""Registered queries of this subpackage, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesignal.llm import (
    exact_dedup,
    html_text,
    language,
    mixing,
    near_dedup,
    pieces,
    quality,
    resampling,
    spelling,
    substring_dedup,
    token_files,
    toxicity,
    url_filter,
)
from sitesignal.session import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = language.fit(docs.filter(~held_out).select("text", "lang"))
    return language.predicted(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allocation(_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = token_files.word_tokenizer(tokenizer_file("word_bpe_49k.json"))
    shards = stage(token_files.encoded_shards(_table(spark, sf_dir, "documents"), make, end_id=1), "token-files")
    return token_files.read_documents(shards)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op9_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op10_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a repeated passage has it under its own id, the first one too."""
    return substring_dedup.both_sides(substring_dedup.passages(_table(spark, sf_dir, "documents"))).withColumnsRenamed({
        "id": "doc_id", "at": "start_word", "other_id": "other_doc_id", "other_at": "other_start_word"})


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    fold = lambda column: F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5
    model = toxicity.fit(docs, labels, fold(F.col("id")) != 0)
    return toxicity.scored(docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "text"), model)


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.counted(_table(spark, sf_dir, "documents"), drop_every=31))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_near_dedup, op2_language_id, op3_source_mixing, op4_url_filter, op5_exact_dedup, op6_token_files, op7_quality_rules, op8_html_text,
    op9_nbest_pieces, op10_fuzzy_passages, op11_toxicity, op12_target_resampling, op13_spelling_variants, pipeline)}

#: CTEs in front of a query: ``hashed(s, crc)``, the unsigned crc32 of the UTF-8 bytes of every ``s`` of ``strings(s)``. A byte's share of
#: the hash depends on the byte and its distance from the end alone, and so does that of the starting value, by length
_CRC32 = r"""
bits(b, v, k) AS (
  SELECT b, b, 0 FROM range(256) AS r(b)
  UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT b, v FROM bits WHERE k = 8),
widest AS (SELECT coalesce(max(octet_length(encode(s))), 0) AS n FROM strings),
shares(b, d, v) AS (
  SELECT b, 0, v FROM crc_table
  UNION ALL SELECT x.b, d + 1, xor(x.v // 256, t.v) FROM shares AS x JOIN crc_table AS t ON t.b = x.v % 256 WHERE d + 1 < (SELECT n FROM widest)),
starts(n, v) AS (
  SELECT 0, 4294967295
  UNION ALL SELECT x.n + 1, xor(x.v // 256, t.v) FROM starts AS x JOIN crc_table AS t ON t.b = x.v % 256 WHERE x.n < (SELECT n FROM widest)),
spelled AS (SELECT s, hex(encode(s)) AS h, octet_length(encode(s)) AS n FROM strings),
bytes AS (SELECT s, n, unnest(range(n)) AS i, h FROM spelled),
hashed AS (
  SELECT s, xor(xor(bit_xor(x.v), any_value(t.v)), 4294967295) AS crc
  FROM bytes JOIN shares AS x ON x.d = n - 1 - i AND x.b = ('0x' || substr(h, 2 * i + 1, 2))::INT JOIN starts AS t USING (n) GROUP BY s)"""

ORACLE = {
    "op3_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS queue,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s AS (SELECT queue, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY queue),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM s),
f AS (SELECT *, 2.0::DOUBLE * source_size AS cap, (2.0::DOUBLE * source_size) / weight AS full_at FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
                 - coalesce(sum(cap) OVER (ORDER BY full_at, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY full_at, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT queue, source_size, CASE WHEN full_at <= level THEN cap ELSE
             weight * (SELECT arg_min(level, full_at) FROM l WHERE full_at > level) END AS target FROM l),
q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY queue ORDER BY key, doc_id, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d JOIN t USING (queue)),
c AS (SELECT q.*, epoch, CASE WHEN target > 0 THEN (epoch * source_size + upto)::DOUBLE / target ELSE 0 END AS finish
      FROM q, (VALUES (0), (1)) AS e(epoch)),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, queue, key, doc_id, size, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             <= (SELECT floor(1.5 * sum(size)) FROM d) AS inside FROM c)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       sum(CASE WHEN inside THEN size ELSE 0 END)::BIGINT AS taken
FROM g GROUP BY doc_id, queue, key, upto""",
    "op5_exact_dedup": r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
WINDOW w AS (PARTITION BY body)""",
    "op12_target_resampling": r"""
WITH RECURSIVE texts AS (
  SELECT 'd' AS side, row_number() OVER () AS rid, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
lists AS (
  SELECT side, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
places AS (SELECT side, rid, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
runs AS (
  SELECT side, rid, unnest([w[i], CASE WHEN i + 1 <= len(w) THEN w[i] || ' ' || w[i + 1] END,
                            CASE WHEN i + 2 <= len(w) THEN w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END]) AS s FROM places),
features AS (SELECT side, rid, s, count(*) AS n FROM runs WHERE s IS NOT NULL GROUP BY ALL),
strings AS (SELECT DISTINCT s FROM features),""" + _CRC32 + r""",
placed AS (SELECT side, rid, n, crc % 10000 AS bucket FROM features JOIN hashed USING (s)),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::BIGINT AS t FROM placed GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE
                                 / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE)))::BIGINT AS gain FROM sums),
weights AS (SELECT rid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM placed JOIN gain USING (bucket) WHERE side = 'd' GROUP BY rid),
scores AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
         (('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM lists LEFT JOIN weights USING (rid) WHERE side = 'd'),
ranks AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (n_words >= 20) OVER () AS able FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= able * 5 // 100 THEN k END AS rank FROM ranks""",
    "op13_spelling_variants": r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
low AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || r AS s, r, count(*) AS n
  FROM (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM runs) WHERE length(r) >= 7 GROUP BY ALL),
strings AS (SELECT DISTINCT s FROM low),""" + _CRC32 + r""",
words AS (
  SELECT w, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN crc % 31 = 0 THEN substr(r, 1, crc % length(r)) || substr(r, crc % length(r) + 2) ELSE r END AS w FROM low JOIN hashed USING (s))
  WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
cuts AS (
  SELECT w, n, k, substr(w, 1, k) || substr(w, k + 2) AS c FROM (SELECT w, n, unnest(range(length(w))) AS k FROM words)),
near AS (
  SELECT DISTINCT a.w, b.w AS o, b.n FROM cuts AS a JOIN cuts AS b ON a.c = b.c AND a.k = b.k AND a.w <> b.w
  UNION SELECT DISTINCT a.w, b.w, b.n FROM cuts AS a JOIN words AS b ON a.c = b.w
  UNION SELECT DISTINCT b.w, a.w, a.n FROM cuts AS a JOIN words AS b ON a.c = b.w),
best AS (SELECT w, count(*) AS n_near, max(n) AS top, min_by(o, (-n, encode(o))) AS o FROM near GROUP BY w),
forms AS (SELECT w, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * words.n THEN o END AS form,
                 CASE WHEN top >= 10 * words.n THEN top END AS form_n FROM words LEFT JOIN best USING (w)),
steps(w, now, depth) AS (
  SELECT w, w, 0 FROM forms
  UNION ALL SELECT steps.w, form, depth + 1 FROM steps JOIN forms ON forms.w = now WHERE form IS NOT NULL)
SELECT f.w AS word, form, max_by(now, depth) AS root, any_value(n) AS n, any_value(n_near) AS n_near, any_value(form_n) AS form_n
FROM forms AS f JOIN steps USING (w) GROUP BY f.w, form""",
}
