"""Upload intake: validate files by extension and size, per batch.

A batch whose total size exceeds the batch limit is rejected whole; otherwise
each file is rejected for a disallowed extension, then for its size; the rest
are processed. Batch totals are a partial aggregation joined back on the batch
key, so a very large batch is summed by many tasks, not one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitae.functions import dictionaries as D
from vitae.functions.text import human_size


def extension(name_col) -> F.Column:
    """Lower-cased text after the last dot; NULL when the name has no dot."""
    c = F.col(name_col) if isinstance(name_col, str) else name_col
    return F.when(c.contains("."), F.lower(F.element_at(F.split(c, r"\."), -1)))


def validate_intake(files: DataFrame, *, name_col: str = "filename", size_col: str = "size",
                    batch_col: str = "batch_id", extensions=D.ALLOWED_EXTENSIONS,
                    max_file: int = D.MAX_FILE_BYTES, max_batch: int = D.MAX_BATCH_BYTES) -> DataFrame:
    """Adds ``extension``, ``status`` (processed / rejected) and ``error``."""
    totals = files.groupBy(F.col(batch_col).alias("_batch")).agg(F.sum(size_col).alias("_batch_bytes"))
    f = files.join(totals, F.col(batch_col).eqNullSafe(F.col("_batch")))  # files without a batch are one batch
    ext = extension(name_col)
    allowed = ext.isin([e.lower() for e in extensions])
    too_big_batch = F.col("_batch_bytes") > F.lit(max_batch)
    status = (F.when(too_big_batch, F.lit("rejected"))
              .when(~F.coalesce(allowed, F.lit(False)), F.lit("rejected"))
              .when(F.col(size_col) > F.lit(max_file), F.lit("rejected"))
              .otherwise(F.lit("processed")))
    error = (F.when(too_big_batch, F.lit("Total size exceeds batch limit"))
             .when(~F.coalesce(allowed, F.lit(False)), F.lit("Invalid file type"))
             .when(F.col(size_col) > F.lit(max_file), F.lit("File exceeds size limit")))
    return f.select(*files.columns, ext.alias("extension"), status.alias("status"), error.alias("error"),
                    human_size(F.col(size_col)).alias("size_text"))


def processed_only(validated: DataFrame) -> DataFrame:
    """Files that reached the parser."""
    return validated.where(F.col("status") == "processed")


def parsed(files: DataFrame, error_col: str = "error") -> DataFrame:
    """Status after parsing: a processed file whose record carries an error becomes ``parse_error``."""
    failed = (F.col("status") == "processed") & F.col(error_col).isNotNull()
    return files.withColumn("status", F.when(failed, "parse_error").otherwise(F.col("status")))


def intake_counts(validated: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Per batch: processed, errors (status not processed/pending), success flag."""
    return validated.groupBy(batch_col).agg(
        F.count_if(F.col("status") == "processed").alias("processed"),
        F.count_if(~F.col("status").isin("processed", "pending")).alias("errors")).withColumn(
        "success", F.col("processed") > 0)


def intake_manifest(spark: SparkSession, path: str, extensions=D.ALLOWED_EXTENSIONS,
                    recursive: bool = True) -> DataFrame:
    """List files under ``path``: name, size, modification time; allowed extensions only (A3).

    Uses the binary file source with the ``content`` column pruned, so file
    bodies are never read.
    """
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
          .load(path).select("path", "length", "modificationTime"))
    name = F.element_at(F.split("path", "/"), -1)
    out = df.select(name.alias("filename"), F.col("length").alias("size"),
                    F.col("modificationTime").alias("modified"))
    return out.where(extension("filename").isin([e.lower() for e in extensions]))
