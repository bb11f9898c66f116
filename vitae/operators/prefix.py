"""Running sums and exact order statistics without a task that sees every row.

``running_sums`` works in two passes: a range partition by the order gives every
task a run of neighbouring rows; each run's totals (one row a task) give what
precedes it; inside a run the sums are a window of that run alone.

``order_statistics`` finds the value of a wanted rank by narrowing: the values
that can still hold the rank are cut at approximate quantiles, counted between the
cuts, and the part that holds the rank is next. Only counts reach the driver,
and rows are never sorted or moved by value.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitae.session import materialize

#: Cuts per round: a part holds about this share of the values it was cut from.
CUTS = 64


def running_sums(rows: DataFrame, order: list[Column], sums: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """(rows with ``run_<c>``, totals): for each column of ``sums`` its sum over all rows up to this one in ``order``.

    Rows that are equal in ``order`` stand in any order among each other. What
    reaches the driver is one row of totals per task.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialize(ranged.withColumn("_run", F.spark_partition_id())
                           .withColumn("_at", F.monotonically_increasing_id()), "runs")
    parts = sorted(numbered.groupBy("_run").agg(*[F.sum(c).alias(c) for c in sums]).collect(), key=lambda r: r["_run"])
    totals = {c: sum(r[c] for r in parts) for c in sums}
    kinds = dict(numbered.selectExpr(*[f"sum(`{c}`) as `{c}`" for c in sums]).dtypes)
    before = {c: list(accumulate([0.0 if kinds[c] == "double" else 0, *[r[c] for r in parts]]))[:-1] for c in sums}
    offsets = rows.sparkSession.createDataFrame(
        [(r["_run"], *[before[c][k] for c in sums]) for k, r in enumerate(parts)],
        "_run int, " + ", ".join(f"`_b_{c}` {kinds[c]}" for c in sums))
    inside = Window.partitionBy("_run").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = numbered.join(F.broadcast(offsets), "_run").withColumns(
        {f"run_{c}": F.sum(c).over(inside) + F.col(f"_b_{c}") for c in sums})
    return out.drop("_run", "_at", *[f"_b_{c}" for c in sums]), totals


def order_statistics(rows: DataFrame, key: str, value: str, ranks: dict) -> dict:
    """``{k: {rank: value}}`` for the wanted 0-based ``ranks`` (``{k: ranks}``) of ``value`` among each key's rows.

    The keys are named by the caller, so they are few. Each round runs two
    counting jobs over the rows and divides the rows in question by about
    ``CUTS``; a round without an answer still parts two different values.
    """
    spark = rows.sparkSession
    found: dict = {k: {} for k in ranks}
    open_ = {(k, None, None): [(r, 0) for r in sorted(set(wanted))] for k, wanted in ranks.items() if wanted}
    while open_:
        spans = list(open_)
        table = F.broadcast(spark.createDataFrame(
            [(n, k, lo, hi) for n, (k, lo, hi) in enumerate(spans)], f"_n int, _k {dict(rows.dtypes)[key]}, _lo double, _hi double"))
        held = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")).join(
            table, "_k").where((F.col("_lo").isNull() | (F.col("_v") >= F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi"))))
        cuts = {r["_n"]: sorted(set(r["c"])) for r in held.groupBy("_n").agg(
            F.percentile_approx("_v", [i / CUTS for i in range(CUTS + 1)]).alias("c")).collect()}
        edges = F.broadcast(spark.createDataFrame(list(cuts.items()), "_n int, _c array<double>"))
        # a cut's own value is a part of its own, between the parts below and above it
        part = 2 * F.size(F.filter("_c", lambda c: c < F.col("_v"))) + F.array_contains("_c", F.col("_v")).cast("int")
        counted = held.join(edges, "_n").groupBy("_n", part.alias("_p")).agg(
            F.count(F.lit(1)).alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        parts: dict = {}
        for r in sorted(counted.collect(), key=lambda r: (r["_n"], r["_p"])):
            parts.setdefault(r["_n"], []).append((r["c"], r["lo"], r["hi"]))
        following: dict = {}
        for n, (k, _, _) in enumerate(spans):
            for rank, below in open_[spans[n]]:
                for count, lo, hi in parts[n]:
                    if rank < below + count:
                        break
                    below += count
                else:
                    raise ValueError(f"rank {rank} of {k!r} is beyond its rows")
                if lo == hi:
                    found[k][rank] = lo
                else:
                    following.setdefault((k, lo, hi), []).append((rank, below))
        open_ = following
    return found
