"""Corpus pipeline: language ID, near-duplicate removal, substring dedup, source mixing, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written as Parquet into the shared
folder, by run() or, where Python workers are sent texts last (WRITTEN), by the stage, so that whoever calls it they
get batches of a bounded size, and is read again as the next one's docs. language_id writes which texts go, for the
same reason. All stages but the last return the columns of docs.
Stages define nulls, empty texts, ties, repeated rows and empty tables as their operators do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common, language_id, mixing, ngram_join, sentencepieces, substring_dedup
from quern.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that language ID rejects: no letters (null and empty texts among them), or a score below
    the calibrated limit. Rows with a null lang teach nothing; repeated rows each stay or go alike; without any
    labelled row all go; an empty table stays empty."""
    # what is kept in files are the 128 bits of each text that goes, not the documents that stay
    key = F.struct(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")).alias("key")
    found = language_id.predicted(docs.select(key, "text"), language_id.fit(docs), ["key"])
    rejected = common.staged(found.where("rejected").select("key").distinct(), "language_id")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key)
    return common.without(rows, rejected).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets alike by 0.8 or more: the one with the smallest id
    (rows without an id last; of unlike texts under one id, that of the smaller text hash). Rows are told apart by
    id and text, so a text under a reused id is lost only if it has copies itself; of rows alike in both, one stays.
    Documents without words are linked with nothing and stay."""
    found = common.staged(ngram_join.joined(docs, k=5, num=80, den=100).where("component is not null").select("doc_id", "th", "component"), "near")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    firsts = found.groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    stays = (F.col("th") == F.col("first.th")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    decided = found.join(firsts, "component").groupBy("doc_id", "th").agg(F.bool_or(stays).alias("stays"), F.count("*").alias("times"))
    decided = common.staged(decided.where("not stays or times > 1").select(F.col("doc_id").alias("id"), "th", "stays"), "decided")
    # a row is carried as one column, so no column of docs meets a name of this function
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("of_id"), F.xxhash64("text").alias("of_text"))
    marked = rows.join(decided.hint("merge"), F.col("of_id").eqNullSafe(F.col("id")) & (F.col("of_text") == F.col("th")), "left")
    kept = marked.where("stays is null").select("row")
    if not decided.where("stays").isEmpty():
        once = marked.where("stays").groupBy("of_id", "of_text").agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.unionByName(once.select("row"))
    return kept.select("row.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that an earlier document keeps. No row goes: one whose whole text is a
    repeat stays with an empty text. Null and short texts stay as they are; a null id is before all others; rows
    alike in id and text are one document and keep all of it; ties of ids go by the text's hash."""
    return substring_dedup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them: texts without words (null ones too) are never taken, a null source
    is one of its own, rows without an id are in order of their text, repeated rows each have their own share."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and its token ids, begin and end included; a null or empty text has these two alone, a null id stays
    null, repeated rows each have their own row."""
    return common.staged(sentencepieces.encoded(docs, vocabulary("piece_bpe_32k.model")), "sentencepiece")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("source_mix", mix_sources),
    ("sentencepiece", encode),
]

#: Stages that return a table in the shared folder.
WRITTEN = {"sentencepiece"}

#: No SQL: trained models, tokenizer files and hashes decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        docs = made if name in WRITTEN else common.staged(made, name)
        if before is not None:
            common.drop_staged(before)
        before = docs
    return docs
