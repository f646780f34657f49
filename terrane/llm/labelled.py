"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text in a sample of each class, at most; a single longer text is still taken.
CLASS_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, class_bytes: int = CLASS_BYTES) -> DataFrame:
    """doc_id, text, label of at most ``per_class`` documents of each value 0 and 1, those with the least hashes of
    their ids, as many as have ``class_bytes`` of text between them.

    Only the ids and labels of the sample are broadcast; texts are filtered where they are read. Rows whose label or id
    is null are no examples; where one id has several labels, the largest counts; where one id has several texts, the one
    with the least ``xxhash64`` does, once.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = None
    for value in (0, 1):
        part = rows.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min_by("text", "h").alias("text"))
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")  # per_class rows at most
    bounded = texts.select("*", F.row_number().over(order).alias("nth"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(order).alias("bytes"))
    return bounded.where((F.col("nth") == 1) | (F.col("bytes") <= class_bytes)).select("doc_id", "text", "label")
