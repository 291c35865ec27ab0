"""The training-data queries of __spark_entry__.py and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact_dedup, line_dedup, lm, mixing, near_dup, quality, resample, token_counts, toxicity, warc, whitening


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    page = warc.page_of(F.col("record_id")).alias("page_id")
    return warc.read(manifest, payloads=False).select(page, "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"), "url")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels").select("doc_id", "toxic"), fold("id") != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 7
    scored = lm.score(_read(spark, sf_dir, "documents").select("doc_id", "text"), fold("doc") != 2)
    return scored.withColumn("held_out", F.coalesce(fold("doc_id") == 2, F.lit(False)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, pieces = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixing.taken(sized, pieces).select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.drop_repeated_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


OP5 = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, r.first IS NOT NULL AND k.doc_id > r.first AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


#: The conversation that op6 adds to the table.
ADDED = [(-7, t, r, r"\### Assistant: </turn> ok") for t, r in enumerate(("user", "assistant"))]


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.format_conversations(turns, tokenizer_path()))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = token_counts.token_counts(docs, tokenizer_path(), keep_text=False, budget=1024)
    return counted.select("doc_id", "n_bytes", "n_tokens", F.col("over_budget").alias("over_limit"), "chars_within")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    measured = quality.store(quality.measure(docs, keep_text=False), "quality-counts")
    judged = quality.judge(measured, quality.fit(measured))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", "level", "still")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resample(docs, _read(spark, sf_dir, "benchmark").select("text"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    w = whitening.whiten(vectors, model).select("vec_id", F.lit(model.n).cast("long").alias("n"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.get(F.array(*[F.lit(e) for e in model.explained()[:4]]).cast("array<double>"), F.col("at"))
    return w.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", explained.alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.classes(docs, keep_text=False).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP13 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""


QUERIES = {
    "op1_warc": op1_warc,
    "op2_toxicity": op2_toxicity,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_chat": op6_chat,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_decontamination": op8_decontamination,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
    "op11_resampling": op11_resampling,
    "op12_whitening": op12_whitening,
    "op13_exact_dedup": op13_exact_dedup,
}
ORACLE_SQL = {"op5_line_dedup": OP5, "op13_exact_dedup": OP13}
