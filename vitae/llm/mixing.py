"""Mixing sources to target weights by systematic sampling over whole documents.

Every source gets a target in words: its weight's share of the budget, but no
more than ``most`` times the source's size; what exceeds that is shared again
by weight among the others. Within a source each document expects the same
number of copies, target / size. Expected copies are summed along the
documents in order of size, one offset is added per source, and a document is
taken once for each integer its interval crosses. In order of size a source's
taken words differ from its target by about one document.

The running sums need no task that holds a source: documents are dealt by
range of (source, size, id), each range counts its rows per source, and only
those counts are summed across ranges.

Defined cases: a null text has size 0; null sources form one source, weighed
last; a source of size 0 has target 0 and gives nothing; rows that repeat are
separate documents; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitae.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0


def text_size(text: str = "text"):
    """Number of words of a text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.0, most: float = MOST) -> DataFrame:
    """Targets of a table (source, source_size) with one row per source.

    Sorted by how soon it hits its ceiling, a source is capped if even the
    share left for it by the capped ones before it exceeds the ceiling; the
    last uncapped share is what all the rest get per unit of weight. One row
    per source goes through these windows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("__w", w).withColumn("__cap", F.lit(most) * F.col("source_size"))
    rows = rows.withColumn("__level", F.col("__cap") / F.col("__w"))
    all_rows = Window.partitionBy()
    before = Window.orderBy("__level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = (rows.withColumn("__total", F.lit(budget) * F.sum("source_size").over(all_rows))
            .withColumn("__left", F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
            .withColumn("__weights", F.sum("__w").over(all_rows) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
            .withColumn("__share", F.col("__left") / F.col("__weights"))
            .withColumn("__free", F.col("__level") >= F.col("__share")))
    rows = rows.withColumn("__rate", F.max(F.when(F.col("__free"), F.col("__share"))).over(all_rows))
    target = F.when(F.col("__level") < F.coalesce(F.col("__rate"), F.lit(float("inf"))), F.col("__cap")).otherwise(
        F.col("__rate") * F.col("__w"))
    return rows.select("source", "source_size", target.alias("target"))


def offset(source: str, seed: int = 0):
    """A fixed uniform number in [0, 1) for each source."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, ``__size`` (words), ``__tie`` (hash of the text, orders rows that share size and id), and all
    columns of the row in ``__doc``, out of the way of the names used here."""
    return docs.select("doc_id", "source", text_size().alias("__size"), F.xxhash64("text").alias("__tie"),
                       F.struct(*[docs[c] for c in docs.columns]).alias("__doc"))


def plan(docs: DataFrame, weights=WEIGHTS, budget: float = 1.0, most: float = MOST, seed: int = 0) -> DataFrame:
    """Rows of ``docs`` (as ``sized`` gives them) with ``__source_size``, ``__target``, ``__copies``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").asc_nulls_last(), F.col("__size"), F.col("doc_id"), F.col("__tie")]
    ranged = materialize(
        docs.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("__row", F.monotonically_increasing_id())
        .withColumn("__range", F.spark_partition_id()), "mix-ranges")
    counts = materialize(ranged.groupBy("source", "__range").agg(
        F.count(F.lit(1)).alias("__rows"), F.sum("__size").alias("__words"),
        F.min("__row").alias("__first")), "mix-counts")
    before = Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("source").alias("__src"), F.col("__range").alias("__r"), "__first",
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    targets = source_targets(counts.groupBy("source").agg(F.sum("__words").alias("source_size")), weights, budget, most)
    rates = targets.select(
        F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
        F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most)))
        .otherwise(0.0).alias("__rate"), offset("source", seed).alias("__offset"))
    head = starts.join(rates, F.col("__src").eqNullSafe(F.col("__s")))
    rows = ranged.join(head, F.col("source").eqNullSafe(F.col("__src")) & (F.col("__range") == F.col("__r")))
    k = F.col("__before") + F.col("__row") - F.col("__first") + 1
    crossed = F.floor(k * F.col("__rate") + F.col("__offset")) - F.floor((k - 1) * F.col("__rate") + F.col("__offset"))
    copies = F.when(F.col("__size") > 0, F.least(crossed, F.ceil(F.lit(most)))).otherwise(0)
    return rows.withColumn("__copies", copies.cast("long"))


def report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    return plan(sized(docs).select("doc_id", "source", "__size", "__tie"), **how).select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents, each as often as it is taken, with the columns of ``docs``."""
    rows = plan(sized(docs), **how).where("__copies > 0")
    return rows.select("__doc", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("__doc.*")


REPORT_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS cap,
        [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
      FROM d GROUP BY source),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS share
      FROM s WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, max(CASE WHEN cap / w >= share THEN share END) OVER () AS rate FROM l),
t AS (SELECT source, source_size,
        CASE WHEN rate IS NULL OR cap / w < rate THEN cap ELSE rate * w END AS target,
        ('0x' || substr(md5('0:' || coalesce('=' || source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift FROM r),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.shift,
        CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0) ELSE 0 END AS rate,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  CASE WHEN size > 0 THEN least(floor(k * rate + shift) - floor((k - 1) * rate + shift), 3) ELSE 0 END::BIGINT * size AS taken
FROM k
"""
