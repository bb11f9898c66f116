"""Token output: whole texts as Parquet lists of ids, in ascending id order.

The files hold ``doc_id``, the range a document lies in, its first token
within the range, its token count, and the ids as a list column. Ids are
dictionary-encoded, counts and positions delta-encoded (format version 2), row
groups and pages are small, and Parquet writes page indexes, so a reader of
counts alone, or of a few documents, skips the token pages.

Defined cases: a null text is empty and gives just the end id; null ids come
first; rows that share an id are ordered by a hash of their text and each keep
their own tokens; an empty table gives files without rows; other columns of
the documents are not written.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from vitae.llm.tokenizing import encoded
from vitae.session import ensure_checkpoint_dir

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, tokens array<int>"
ROW_GROUP_BYTES, PAGE_BYTES = 16 << 20, 256 << 10


def write(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", spaced: bool = False,
          end: int = 2) -> str:
    """Encode every text and write the token files under ``path``."""
    def encode(batches):
        part, at = TaskContext.get().partitionId(), 0
        for rows, offsets, ids in encoded(batches, tokenizer, spaced, end):
            n = np.diff(offsets)
            yield pa.RecordBatch.from_arrays([
                rows.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(at + offsets[:-1]), pa.array(n),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))],
                ["doc_id", "part", "part_start", "n_tokens", "tokens"])
            at += int(offsets[-1])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
     .repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
     .mapInArrow(encode, SCHEMA)
     .write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.enable.dictionary", "true").option("parquet.block.size", str(ROW_GROUP_BYTES))
     .option("parquet.page.size", str(PAGE_BYTES)).parquet(path))
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, tokens.

    The starts of the ranges come from counts alone, one row per range.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
              .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    return files.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "tokens")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens of every document; the token pages are not read."""
    return spark.read.schema(SCHEMA).parquet(path).select("doc_id", "n_tokens")


def documents(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """doc_id, n_tokens, tokens of the documents with ids from ``low`` to ``high``.

    The files are in order of the id, so its statistics leave out whole files and
    row groups, and the column index leaves out pages of the others.
    """
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("doc_id").between(low, high)).select(
        "doc_id", "n_tokens", "tokens")


@F.arrow_udf(LongType())
def ids_crc32(tokens: pa.Array) -> pa.Array:
    """Unsigned CRC-32 of each list's ids as little-endian unsigned 32-bit integers."""
    offsets = tokens.offsets.to_numpy()
    data = memoryview(np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
    return pa.array([zlib.crc32(data[4 * a:4 * b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.int64())


def report(docs: DataFrame) -> DataFrame:
    """Write the token files of ``docs``, read them back, and digest each document."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/tokens-{uuid.uuid4().hex}"
    return read(spark, write(docs, path)).select(
        "doc_id", "start", "n_tokens", ids_crc32("tokens").alias("ids_crc32"))
