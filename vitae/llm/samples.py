"""Labelled documents, all of them, dealt to shards that a task can learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, mod: int):
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % F.lit(mod)


def held_out(doc_id: str, mod: int, rest: int):
    """True for rows no model may learn from; a null id counts as held out."""
    return F.coalesce(remainder(doc_id, mod) == F.lit(rest), F.lit(True))


def labelled_documents(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int, rows: int) -> DataFrame:
    """Every labelled training document: (doc_id, text, label, shard).

    Rows whose id has the held-out remainder never enter. Repeated ids count
    once: the largest label and the smallest text. Ids or labels that are null
    are left out. A shard holds about ``rows`` documents, by the hash of the id,
    so reruns agree; up to ``rows`` documents are one shard.
    """
    ids = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
           .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", mod, rest))
           .groupBy("doc_id").agg(F.max("label").alias("label")))
    shards = max(1, -(-ids.count() // rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return (texts.where(~held_out("doc_id", mod, rest)).join(ids, "doc_id")
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
            .withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")))
