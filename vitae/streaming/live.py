"""Structured Streaming: live screening and running intake counts.

* Live screening reads what training stored once: ``store_profiles`` writes both sides' profiles
  with their term weights as one array per row, in folders by a hash of the
  id. A micro-batch of applications reads only the folders its ids fall into and
  scores each pair from its two rows: two joins on ids and per-row
  expressions, no term table, no fit. Each epoch's output is written to its own
  folder with overwrite, so a retried epoch replaces its own output.
* Running counts keep their state in the stream's checkpoint and emit the keys a
  micro-batch changed; each epoch merges them by key into a new version of a
  table of files. A version depends on those of earlier epochs alone, so a retried
  epoch writes the same again, and a stopped stream goes on where it was.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitae.functions import dictionaries as D
from vitae.operators import intake as IN
from vitae.operators import screening as SC
from vitae.operators import tfidf

#: Folders of a stored side; a micro-batch names those it needs, at most all of them.
FOLDERS = 64
_SIDES = {"cands": "resume_id", "jobs": "job_id"}


def _folder(key: str, folders: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(folders)).cast("int")


def store_profiles(cands: DataFrame, jobs: DataFrame, package: SC.ModelPackage, mode: str, path: str,
                   folders: int = FOLDERS) -> None:
    """Write both sides for ``mode`` under ``path``: profile columns and ``terms``, an array of (term, w) per row.

    ``w`` is the unit-length weight under the package's vocabulary; in a mode that
    fits each pair alone (casual skills, or without a vocabulary) it is the count.
    """
    if mode not in SC.MODES:
        raise ValueError(f"unknown mode {mode!r}; choose one of {SC.MODES}")
    for (side, key), df in zip(_SIDES.items(), (cands, jobs)):
        terms = SC.skill_terms(df, key, package, mode) if mode.endswith("_skills") else SC.full_terms(df, key)
        if _per_pair(package, mode):
            held = terms.where(F.col("term").isNotNull()).select("id", "term", F.col("cnt").cast("double").alias("w"))
        else:
            held = tfidf.weights(terms, package.vocabulary)
        arrays = held.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("terms"))
        rows = df.join(arrays, df[key] == arrays["id"], "left").drop("id").withColumn("folder", _folder(key, folders))
        (rows.repartition("folder").sortWithinPartitions(key).write.partitionBy("folder")
         .mode("overwrite").parquet(f"{path}/{side}"))


def _per_pair(package: SC.ModelPackage, mode: str) -> bool:
    return mode == "casual_skills" or (mode == "strict_skills" and package.vocabulary is None)


def _stored(batch: DataFrame, path: str, side: str, folders: int) -> DataFrame:
    """The rows of one stored side in the folders that the batch's ids fall into."""
    key = _SIDES[side]
    needed = [r[0] for r in batch.select(_folder(key, folders)).distinct().collect()]
    return batch.sparkSession.read.parquet(f"{path}/{side}").where(F.col("folder").isin(needed)).drop("folder")


def _similarity(per_pair: bool) -> Column:
    """Cosine of a row's two arrays ``r_terms`` and ``j_terms``; 0 where one is empty."""
    none = F.array().cast("array<struct<term:string,w:double>>")
    left, right = F.coalesce("r_terms", none), F.coalesce("j_terms", none)
    in_left, in_right = F.map_from_entries(left), F.map_from_entries(right)

    def total(terms: Column, value) -> Column:
        return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + value(t))

    dot = total(left, lambda t: t["w"] * F.coalesce(F.try_element_at(in_right, t["term"]), F.lit(0.0)))
    if not per_pair:
        return dot
    # refitted on the two texts: idf 1 for a term of both, 1 + ln 1.5 for one of either
    alone = 1.0 + math.log(1.5)

    def length(terms: Column, other: Column) -> Column:
        return F.sqrt(total(terms, lambda t: F.pow(t["w"] * F.when(F.map_contains_key(other, t["term"]), 1.0).otherwise(alone), 2)))

    lengths = length(left, in_right) * length(right, in_left)
    return F.when(lengths > 0, dot / lengths).otherwise(0.0)


def screen_batch(batch: DataFrame, path: str, package: SC.ModelPackage, mode: str, folders: int = FOLDERS) -> DataFrame:
    """``screening.screen`` of the batch's pairs from the stored sides; pairs without both profiles give no row."""
    pairs = batch.select("resume_id", "job_id")
    c = _stored(pairs, path, "cands", folders).select(
        "resume_id", "name", "email", "phone", F.col("skills").alias("r_skills"), F.col("certifications").alias("r_certs"),
        "degree", "experience_days", F.col("terms").alias("r_terms"))
    j = _stored(pairs, path, "jobs", folders).select(
        "job_id", F.col("skills").alias("j_skills"), F.col("certifications").alias("j_certs"), F.col("terms").alias("j_terms"))
    met = pairs.join(c, "resume_id").join(j, "job_id").withColumn("raw", _similarity(_per_pair(package, mode)))
    if mode.endswith("_skills"):
        return SC.skills_results(met, package, mode)
    return SC.score_full(SC.profile_features(met.withColumnRenamed("raw", "skill_similarity")), package, mode)


def screen_stream(applications: DataFrame, profiles: str, package: SC.ModelPackage, mode: str, out_path: str,
                  checkpoint: str, trigger_once: bool = True, folders: int = FOLDERS):
    """Start a streaming screen of ``applications`` (a streaming DataFrame of ``resume_id, job_id``) against
    the sides stored under ``profiles``; returns the ``StreamingQuery``."""

    def per_batch(batch: DataFrame, epoch: int) -> None:
        screen_batch(batch, profiles, package, mode, folders).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    w = applications.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="10 seconds")
    return w.start()


def read_counts(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The latest version of a table of running counts (of those before an epoch); None without one."""
    try:
        versions = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    if before is not None:
        versions = versions.where(F.col("version") < before)
    last = versions.agg(F.max("version")).first()[0]
    return None if last is None else versions.where(F.col("version") == last).drop("version")


def running_counts(rows: DataFrame, keys: list[str], path: str, checkpoint: str):
    """Running counts of a stream's rows by ``keys`` as a table under ``path``; returns the ``StreamingQuery``.

    Null keys count as keys. ``read_counts`` gives the table as of the last finished epoch.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))

    def merge(changed: DataFrame, epoch: int) -> None:
        spark = changed.sparkSession
        earlier = read_counts(spark, path, epoch)
        if earlier is not None:
            same = [earlier[k].eqNullSafe(changed[k]) for k in keys]
            on = same[0]
            for c in same[1:]:
                on = on & c
            changed = earlier.join(changed, on, "left_anti").unionByName(changed)
        changed.write.mode("overwrite").parquet(f"{path}/version={epoch}")

    return (counts.writeStream.outputMode("update").foreachBatch(merge)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def intake_counts_stream(files: DataFrame, path: str, checkpoint: str, extensions=D.ALLOWED_EXTENSIONS,
                         max_file: int = D.MAX_FILE_BYTES):
    """Running counts by status of a stream of file records (``filename, size``), as a table under ``path``.

    Per-file checks only (a batch cap needs the whole batch: use
    ``validate_intake`` per micro-batch for that). Returns the ``StreamingQuery``.
    """
    ext = IN.extension("filename")
    status = (F.when(~F.coalesce(ext.isin([e.lower() for e in extensions]), F.lit(False)), F.lit("rejected"))
              .when(F.col("size") > F.lit(max_file), F.lit("rejected"))
              .otherwise(F.lit("processed")))
    return running_counts(files.select(status.alias("status")), ["status"], path, checkpoint)
