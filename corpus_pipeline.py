"""A corpus pipeline: each stage is a function (spark, docs, sf_dir) -> DataFrame over all that the one before kept.

Defined cases of every stage: null and empty texts count as texts without words (the quality rules reject them); texts of
any length are treated whole; of rows with equal text the Jaccard join keeps one, the other stages judge them alike, and
ties are resolved as the operators say; empty tables give empty results; columns other than those of documents are
neither read nor returned, so their names cannot clash.

A stage's result must be written before the same thread calls the next stage, which deletes the tables that the one before
laid aside. It deletes no others: neither those of other threads nor those of operators called directly."""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from adspark.llm import decontamination, jaccard_join, mixing, quality_rules, token_output
from adspark.llm.common import delete, new_path, read, recorded, stage

#: Columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_held = threading.local()

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _clearing(function: Stage) -> Stage:
    """The stage, which first deletes what this thread's stage before it laid aside."""

    @wraps(function)
    def cleared(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, getattr(_held, "made", []))
        with recorded() as _held.made:
            return function(spark, docs, sf_dir)

    return cleared


@_clearing
def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, repeated rows included; null, empty and wordless texts go."""
    return quality_rules.apply_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


@_clearing
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of five-word shingles: the one of the smallest doc_id
    (null last). Texts without words are linked with nothing and all stay."""
    return jaccard_join.keep_one(docs.select(*COLUMNS), width=5, percent=80)


@_clearing
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items. Null and empty texts hold no item and stay; with an empty
    benchmark everything stays."""
    rows = docs.select(*COLUMNS)
    found = decontamination.match_benchmark(rows, read(spark, sf_dir, "benchmark"), others=["lang", "source", "n_chars"])
    return found.where(~decontamination.contaminated()).select(*COLUMNS)


@_clearing
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix of sources, weighing 1, 2, 3, takes of the documents: a row for each connected part of a text that a pass
    takes, whole texts mostly. A null source is one of its own, last in order; texts without words are never taken."""
    return mixing.mixed_documents(docs.select(*COLUMNS)).select(*COLUMNS)


@_clearing
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token table of the mix: doc_id, start, n_tokens and ids_crc32 of each of its rows, read back from it. Null and empty
    texts are the end id alone; rows stand by doc_id (null first), equal ones by a hash of the text."""
    path = new_path(spark, "tokens")
    token_output.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    found = token_output.token_digests(spark.read.parquet(path))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality_rules", filter_quality),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: SQL has no hash permutation and no tokenizer; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what one stage returns is written, and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
