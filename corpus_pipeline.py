"""Corpus preparation in five stages: toxicity, quality rules, line dedup, SimHash near-dedup, best-fit packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which reads tables in a folder of the stage's own under the
shared folder. A caller that names the folder (``work``) may delete it once the result is written, as ``run`` does; else
it stays until the driver ends. So any number of pipelines and of single stages can stand side by side in a session.

All stages take nulls in any column, empty and very long texts, ties, repeated rows, further columns whatever their
names, and empty tables; the first four return the columns of ``docs`` in their order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import line_dedup, packing, quality, simhash, toxicity
from geoloom.llm.common import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, *, work: Scratch | None = None) -> DataFrame:
    """Documents whose calibrated score is under one half; labels come from the labels table.

    Null text is scored as the empty text. Repeated rows have equal scores and stay or go together; where no document
    has a label, all scores are equal and all documents stay.
    """
    work = work or Scratch(spark, "toxic")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), work=work)
    return toxicity.score(docs, model, score_col="__score").where("__score < 0.5").select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str, *, work: Scratch | None = None) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    Null and empty texts have no words and go. Null languages and sources are groups of their own. Repeated rows count
    each, and stay or go together.
    """
    return quality.keep_good(docs, work=work or Scratch(spark, "quality"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str, *, work: Scratch | None = None) -> DataFrame:
    """Every document, without lines that nearly equal a kept one; n_chars, if there, follows the text.

    Null text stays null. A document that loses all its lines stays with the empty text. Rows of equal id and text keep
    the same lines.
    """
    aside = {c: f"__p_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}  # columns that the operator replaces
    kept = line_dedup.dedup_lines(docs.withColumnsRenamed(aside), work=work or Scratch(spark, "lines"))
    kept = kept.drop("n_lines", "n_dropped").withColumnsRenamed({v: k for k, v in aside.items()})
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, *, work: Scratch | None = None) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Texts without a word (null ones too) are near copies of each other. Of repeated rows one stays.
    """
    return simhash.keep_one(docs, work=work or Scratch(spark, "near"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, *, work: Scratch | None = None) -> DataFrame:
    """The pieces of all documents, dealt into sequences.

    Null text is packed as the empty one, repeated rows each, and a very long text in pieces.
    """
    return packing.pack_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), work=work or Scratch(spark, "pack"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("best_fit_packing", pack),
]

#: The stages' model fitting, hashing and tokenising have no SQL; tests compare them with plain programs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; each result is written, then read as the next one's input, and only the last
    stage's tables are left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    between = Scratch(spark, "stages")
    for k, (name, stage) in enumerate(STAGES):
        work = Scratch(spark, name)
        docs = stage(spark, docs, sf_dir, work=work)
        if k + 1 < len(STAGES):
            docs = between.table(docs, name)
            work.close()
            if k:
                between.drop(STAGES[k - 1][0])
    return docs
