"""A training-data pipeline: language ID, line dedup, near-duplicate removal, decontamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlog.llm import decontam, langid, linededup, ngramjoin, wordbpe
from playlog.llm.common import free_name, saved, work_folder

#: A document goes if no language is found in it or the nearest profile is farther than this.
LEAST_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language. Null and empty texts and texts without a letter go; equal texts fare alike, repeated rows stay."""
    found = langid.predict(docs, langid.learn(docs), names=("__lang", "__score"))
    return found.where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of lines; one of which no more than white space of any kind is left goes. Null texts and
    texts that lose nothing stay as they are; of equal texts the one with the smallest doc_id keeps its lines."""
    counted = free_name(docs.columns, "n_removed")
    done = linededup.dedup(docs, counted)
    return done.where((F.col(counted) == 0) | F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id, and one of rows that are alike in id and text.
    Null and empty texts are in no group; rows with a null doc_id stay."""
    return ngramjoin.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none, rows with a null doc_id stay, and so does a repeated row."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row left, with their number and the digest of the decoded text; a null or empty text has no ids."""
    coded = wordbpe.encode(docs)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_jaccard", near_duplicates), ("decontamination", decontaminate), ("bpe_encoding", encode)]

#: Rank-order profiles, rolling hashes and BPE are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), work_folder(spark)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
