"""A corpus pipeline: quality, near copies, repeated passages, benchmark passages, and the mix of sources.

``STAGES`` are (name, function) pairs. Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``. Between stages the rows are written as Parquet to the folder that the cluster shares
(``spark.checkpoint.dir``) and read again, so a lost executor costs no earlier stage; what a stage wrote goes when the next one
has written. The last stage's input stays, as its result is read from there. Checkpoints go with the DataFrames they belong
to where the session sets ``spark.cleaner.referenceTracking.cleanCheckpoints``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import decontaminate, mixing, quality, simhash, suffix_dedup
from terrane.llm.common import documents, ensure_checkpoint_dir
from terrane.session import make_importable

#: SQL cannot learn a classifier or sort suffixes; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    make_importable(spark)
    model = quality.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id; rows without an id stay.

    Groups are linked by a likeness of 0.8 or more (Jaccard) of five-word shingles.
    """
    make_importable(spark)
    return simhash.without_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that start earlier too. A column ``n_chars`` gets the new number of characters."""
    make_importable(spark)
    out = suffix_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten words of a benchmark item stand verbatim."""
    make_importable(spark)
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", near_copies),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_passages),
    ("source_mixing", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if 0 < k < len(STAGES) - 1:
            _remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
