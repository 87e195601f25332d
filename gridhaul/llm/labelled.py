"""A bounded sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridhaul.llm import common


def labelled_ids(labels: DataFrame, label: str, wanted: Column, limit: int) -> DataFrame:
    """doc_id and label of about limit documents at most (see common.sampled), picked by a hash of the id.

    wanted is a condition on doc_id. Null ids and labels are left out; of contradicting labels the least counts.
    """
    found = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    found = found.filter(wanted & F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    return common.sampled(found.groupBy("doc_id").agg(F.min("label").alias("label")), limit, "doc_id")


def labelled_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, label and text of the sampled documents; the sample's size bounds what is broadcast."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text")
