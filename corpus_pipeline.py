"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``. A stage deletes what the one before it staged, so write each
result before calling the next, as ``run`` does.
"""

from __future__ import annotations

import gc
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.llm import exact_dedup, jaccard, packing, substring_dedup, toxicity
from tabkit.llm.frames import release_memory
from tabkit.session import collecting, delete_staged, scratch_path

#: What the latest stage has staged; its result is written before the next one begins.
_LATEST: list[str] = []

#: Texts go to Python in batches of this size: with the default of 64 MB, executor and
#: worker hold a batch of some 10,000 texts each.
BATCH_BYTES = "4m"
#: Rows that Spark's Parquet readers hold as arrays of the heap; the default of 4096
#: takes a row of 4 KB for an array of 16 MB, and as much again whenever it grows.
READ_ROWS = "512"

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WINDOW, END_ID = 4096, 2


def owned(step):
    """A stage that first deletes what the stage before it had staged."""

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete_staged(spark, _LATEST)
        # Plans of the stage before go, and what fitting a model has used in the driver.
        gc.collect()
        release_memory()
        # The setting of this job's session; its stages run when their results are written.
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)
        with collecting() as paths:
            result = step(spark, docs, sf_dir)
        _LATEST.extend(paths)
        return result

    return run_step


@owned
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled documents
    that reach this stage."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, model)


@owned
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the largest doc_id stays."""
    return exact_dedup.dedup(docs)


@owned
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by a similarity of 0.8 or more over five-word
    shingles, the smallest doc_id stays."""
    return jaccard.dedup(docs, threshold=0.8)


@owned
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 13 words or more that a document of smaller doc_id holds are cut from
    the texts; ``n_chars`` follows. All documents stay, if only with an empty text."""
    cut = substring_dedup.dedup(docs, window=13)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@owned
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids, placed in windows of 4096 tokens."""
    cut = packing.pieces(docs, VOCABULARY, window=WINDOW, end_id=END_ID, keep_ids=True)
    return packing.pack(cut, window=WINDOW)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: Tokens and a trained model are beyond SQL; the tests hold the stages against plain
#: versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
