"""The corpus pipeline: language ID, near-duplicate groups, repeated passages, benchmark contamination, mixture.

Each stage takes (spark, docs, sf_dir) and returns documents' columns (the last: the mixture's rows); run() writes every stage's
rows under spark.checkpoint.dir and reads them again as the next one's docs.

Defined results, stage by stage.  language: null, empty or letter-free texts are rejected (no language), as is everything where no row has a
lang to learn from; near_duplicates: rows that share a doc_id are one document, kept or dropped together, and rows without one stay;
passages: rows without doc_id stay whole, a document of which nothing is left goes; decontamination: judged row by row;
mixture: a null lang or source is a leaf of its own.  Empty tables give empty results, an empty benchmark drops nothing.  Columns of documents
other than COLUMNS are left out from the first stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabriq.llm.common import Scratch, table
from fabriq.llm.decontamination import decontaminate
from fabriq.llm.language_id import identify, train
from fabriq.llm.mixing import mixed
from fabriq.llm.ngram_join import ngram_jaccard_join
from fabriq.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The least posterior of the predicted language with which a document stays.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a language that is more likely than all others together; lang becomes the predicted one."""
    model = train(docs, "doc_id", "text", "lang")
    got = identify(docs.select(*COLUMNS), model, keep=COLUMNS)
    got = got.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return got.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id.  Documents without an id are in no group and stay."""
    groups = ngram_jaccard_join(docs).where("doc_id = component_id").select("doc_id").distinct()
    docs = docs.select(*COLUMNS)
    return docs.where("doc_id is not null").join(groups, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages that others have kept; those of which nothing is left go."""
    got = substring_dedup(docs.select(*COLUMNS))
    kept = got.where((F.col("removed_words") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select("doc_id", "text", "lang", "source", F.when(F.col("removed_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).where(F.size("matches") == 0).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the target weights take of each document."""
    return mixed(docs)


STAGES = [("language_id", language), ("ngram_jaccard_join", near_duplicates), ("substring_dedup", passages), ("decontamination", decontamination), ("mixing", mixture)]

#: SQL can't express the classifier, the MinHash pieces or the embedding's walks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        docs = scratch.save(out, tidy=True)
    return docs
