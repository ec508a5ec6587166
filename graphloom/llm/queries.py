"""The contract's queries: one per operator, thin over the operators' own interfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import archives, exact_topk, language_masks, line_chunks, mixing, ngram_ratio, period_runs, pieces, quality_rules_ensemble, shards, simhash_anchors, url_rules, witnesses
from graphloom.llm.common import fold, table, text_crc

SHARDS = 24
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, _ = quality_rules_ensemble.score_documents(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) > 0)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = ngram_ratio.judged(docs, ngram_ratio.trusted_ids(table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shards.sharded(docs, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out, _ = url_rules.judged(pages, table(spark, sf_dir, "labels"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_chunks.deduplicated(docs, runs=True)


def op6_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = simhash_anchors.near_components(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out, sources = mixing.mixed(docs)
    facts = spark.createDataFrame([(s, size, float(goal)) for s, (size, goal) in sources.items()], "s string, source_size long, target double")
    named = out.drop("text").join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("s")))
    return named.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op8_pieces(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encoded(docs, pieces.model_bytes(model))
    return out.select("doc_id", F.size("ids").alias("n_ids"), "ids", "decoded", F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


def op9_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_masks.identified(docs, fold("doc_id", 3) != 1)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op11_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archives.archived(table(spark, sf_dir, "pages"), key="page_id", uri="url", payload="html")
    return out.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_key").cast("long").alias("refers_to"))


def op12_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = (text_crc(F.col("doc_id")) % 2 == 0) & F.contains("text", F.lit("\n"))
    fields = ("doc_id", "source", "lang", "n_chars")
    tampered = F.when(changed, witnesses.leaf(*map(F.col, fields), F.translate("text", "\n", "")))
    rows = docs.select("doc_id", "source", witnesses.leaf(*map(F.col, (*fields, "text"))).alias("leaf"), tampered.alias("other"))
    out = witnesses.Manifest(rows, group="source", order="doc_id").witnesses()
    out = out.withColumn("folded_root", witnesses.folded(F.col("proof"), F.coalesce("other", "leaf")))
    return out.select("doc_id", "leaf", "subroot", "root", witnesses.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = period_runs.periodic_runs(docs.withColumn("text", period_runs.looped(F.col("text"), text_crc(F.col("doc_id")))))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, period = -F.col("r.start"), -F.col("r.period")
    return out.select("doc_id", "n_runs", start.alias("start"), F.col("r.length").alias("length"), period.alias("period"), F.floor(1000 * F.col("r.length") / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict:
    return {f.__name__: f for f in (op1_rule_ensemble, op2_ngram_ratio, op3_histogram_shards, op4_url_rules, op5_line_chunks, op6_simhash_anchors, op7_flow_mix, op8_pieces, op9_language_masks, op10_exact_topk, op11_arc_to_warc, op12_witnesses, op13_period_runs)}


#: Exact neighbours and equal payloads are plain SQL; the other operators' methods are not.
OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w::DOUBLE[], c.w::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP11_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND page_id <> top AS again FROM t)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_topk": OP10_SQL, "op11_arc_to_warc": OP11_SQL}
