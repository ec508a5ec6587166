"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of `documents`. `run` writes each stage's rows as Parquet in the shared folder
and reads them again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import line_chunks, mixing, pieces, quality_rules_ensemble, simhash_anchors
from graphloom.llm.common import Saved, fold, named, packed, scratch, table, unpacked
from graphloom.llm.queries import MODEL


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored, _ = quality_rules_ensemble.score_documents(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) > 0, keep_text=True)
    return scored.where("predicted = 1").select(*map(named, docs.columns))


def lines_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur elsewhere earlier are taken out of the texts; every document stays."""
    out = line_chunks.deduplicated(docs, runs=True)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else named(c) for c in docs.columns])


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8)."""
    return simhash_anchors.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken, _ = mixing.mixed(docs)
    taken = taken.where("copies > 0").select(packed(docs.columns), F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*unpacked(docs.columns))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids, the text decoded from them and whether it is the document's."""
    out = pieces.encoded(docs, pieces.model_bytes(MODEL))
    return out.select("doc_id", "source", "lang", F.size("ids").alias("n_ids"), "ids", "decoded", F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


STAGES = [
    ("quality classifier", classified),
    ("line dedup", lines_deduplicated),
    ("SimHash near-dedup", near_deduplicated),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", tokenised),
]

#: The stages' methods (a fitted ensemble, piece encoding) are not SQL: none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    saved = Saved(spark, "pipeline")
    for _, stage in STAGES:
        with scratch(spark):  # what a stage saved on its way goes once its rows are written
            docs = saved.save(stage(spark, docs, sf_dir))
        saved.drop_before()
    return docs
