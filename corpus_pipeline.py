"""A training corpus from the table documents, in five stages. Each takes what the one before
kept, and returns the columns of documents; the last returns ids' digests.

In all stages an empty table gives an empty one, texts are taken whole whatever their length,
and columns of other names pass. Each stage's docstring says what becomes of nulls, empty texts,
ties and repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe import bpe_round_trip
from quire.llm.common import scratch, table
from quire.llm.fm_decon import decontaminate
from quire.llm.icws import deduplicate
from quire.llm.quality import fit, score
from quire.llm.queries import SECRET, held_out, tokenizer
from quire.llm.surrogates import replace_pii


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a quality score of 0.7 or more. Null and empty texts have the score of the
    model's bias alone; a null label, or one of no document, isn't learned from; equal texts have
    equal scores, so that repeated rows and ties stay or go together."""
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model, out="_score").where("_score >= 0.7").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates. Null texts, those
    without words and rows without an id stay; of rows that repeat an id one stays; ties can't
    be, as ids differ."""
    return deduplicate(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark: null and empty texts never are, and
    null or empty items have no windows. A document at the border (one word in twenty hit) goes.
    Repeated rows stay or go together."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data, and n_chars of the new text.
    Null texts stay null, empty ones empty; equal texts become equal ones, so that repeated rows
    stay repeated; ties of surrogates are drawn again."""
    out = replace_pii(docs, SECRET)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids, with digests of the ids and of what they decode to. Null and
    empty texts have no ids; ties of ranks go to the left; repeated rows have equal digests."""
    out = bpe_round_trip(docs.select("doc_id", "lang", "source", "text"), tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "lang", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("tokens", tokens)]

#: Training, weighted sampling and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
