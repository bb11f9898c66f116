"""Exact dedup: group by a 128-bit content hash, compare bytes, keep one row.

Built from DataFrame operations only. The grouping key is the MD5 of the text
and the text itself: Spark compares grouping keys byte by byte, so two texts
whose hashes collide stay two groups. Equal texts are folded in each task
before the shuffle, so a text that a third of all rows hold arrives as one row
per task.

Defined cases: a null text counts as empty and equals other empty texts; a
null id is smaller than every other id; of rows that repeat id and text
exactly one is kept; an empty table gives no rows; other columns pass through,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitae.session import materialize


def _keyed(docs: DataFrame, *columns) -> DataFrame:
    """``columns`` of ``docs``, ``__text``, null made empty, and its 128-bit ``__hash``."""
    return (docs.select(*columns, F.coalesce("text", F.lit("")).alias("__text"))
            .withColumn("__hash", F.unhex(F.md5(F.encode("__text", "UTF-8")))))


def deduplicate(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row of each group of equal texts, with the columns of ``docs``.

    ``keep`` names the id that stays, "smallest" or "largest". The rows meet
    in one shuffle, already folded by task.
    """
    pick = F.min_by if keep == "smallest" else F.max_by
    rest = F.struct(*[docs[c] for c in docs.columns if c != "text"])
    row = F.struct(rest.alias("doc"), docs["text"].isNull().alias("none")).alias("__row")
    kept = _keyed(docs, row).groupBy("__hash", "__text").agg(pick("__row", F.struct("__row.doc.doc_id")).alias("__row"))
    text = F.when(~F.col("__row.none"), F.col("__text")).alias("text")
    return kept.select(*[text if c == "text" else F.col("__row.doc")[c].alias(c) for c in docs.columns])


def report(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row, dropped ones too.

    A hash with one text, which is all of them but for collisions, names its
    group, so rows find it without their texts. Where a hash has several
    texts, its rows join on the text as well.
    """
    staged = materialize(
        _keyed(docs, "doc_id")
        .withColumn("__sha", F.sha2(F.encode("__text", "UTF-8"), 256))
        .withColumn("__rowno", F.monotonically_increasing_id()), "exact-docs")
    pick = F.min if keep == "smallest" else F.max
    groups = materialize(
        staged.groupBy("__hash", "__text")
        .agg(F.count(F.lit(1)).alias("__n"), pick(F.struct("doc_id", "__rowno")).alias("__best"))
        .select("__hash", "__n", "__best", F.when(F.col("__n") > 1, F.col("__text")).alias("__text")), "exact-groups")
    many = materialize(groups.groupBy("__hash").agg(F.count(F.lit(1)).alias("__texts")).where("__texts > 1"),
                       "exact-collisions")
    repeated = materialize(groups.where("__n > 1").join(many, "__hash", "left_anti")
                           .select("__hash", "__n", "__best"), "exact-repeated")
    rows = staged.join(repeated, "__hash", "left")
    if not many.isEmpty():
        collided = groups.where("__n > 1").join(many, "__hash", "left_semi").select(
            "__hash", "__text", F.col("__n").alias("__n2"), F.col("__best").alias("__best2"))
        rows = (rows.join(collided, ["__hash", "__text"], "left")
                .withColumn("__n", F.coalesce("__n", "__n2")).withColumn("__best", F.coalesce("__best", "__best2")))
    alone = F.col("__best").isNull()
    return rows.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("__best.doc_id")).alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("__best.__rowno") == F.col("__rowno"))).alias("kept"), F.col("__sha").alias("text_sha256"))


REPORT_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
g AS (SELECT t, count(*) AS n, arg_max(r, (coalesce(doc_id, -9223372036854775807), r)) AS best,
             max(doc_id) AS keep_id FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.n AS group_size, d.r = g.best AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""
