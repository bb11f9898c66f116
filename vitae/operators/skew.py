"""Equi-joins that split their heavy keys by measured frequency.

A sketch of the keys of the larger side counts approximately: every task keeps the counts of a
fixed number of hash cells (a count sketch with one row, whose cells only ever
overestimate), the cells meet by number, and a key is heavy if its cell holds
more than one task's fair share of rows. A heavy key's rows are dealt to as many
parts as it has shares, and the other side's rows of that key are copied to each
of these parts. Keys that share a cell with a heavy one are split with it, which is
more copying but never a wrong result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of the sketch: what is broadcast is the heavy ones among them, at most as many as there are shares.
CELLS = 1 << 16


def _cell(on: list[str]) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(CELLS)).cast("int")


def one_row_an_id(df: DataFrame, id_col: str) -> bool:
    """True when no id comes twice; null ids do not count, as they join with nothing."""
    return df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def heavy_cells(rows: DataFrame, on: list[str], shares: int | None = None) -> dict[int, int]:
    """``{cell: parts}`` of the cells that hold more than one of ``shares`` equal shares of the rows.

    At most ``shares`` cells can, so the result has a fixed bound, as has the
    shuffle behind it: one row a task and cell.
    """
    shares = shares or max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = rows.groupBy(_cell(on).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    # one row: the sum, and as many of the largest cells as can be heavy
    top = counts.agg(F.sum("n").alias("total"), F.slice(F.sort_array(F.collect_list(F.struct("n", "cell")), False), 1, shares)
                     .alias("cells")).first()
    fair = max(1.0, (top["total"] or 0) / shares)
    return {c["cell"]: math.ceil(c["n"] / fair) for c in top["cells"] if c["n"] > fair}


def split(large: DataFrame, other: DataFrame, on: list[str], part: str = "_part",
          shares: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``part``: each row of ``large`` in one part of its key, each row of ``other`` in all.

    Joining on the keys and ``part`` equals joining on the keys; more columns may
    join along. Without a heavy key everything is part 0.
    """
    heavy = heavy_cells(large, on, shares)
    if not heavy:
        return large.withColumn(part, F.lit(0)), other.withColumn(part, F.lit(0))
    parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in heavy.items() for x in kv]), _cell(on)), F.lit(1))
    deal = F.pmod(F.xxhash64(*large.columns), parts).cast("int")
    return large.withColumn(part, deal), other.withColumn(part, F.explode(F.sequence(F.lit(0), parts - 1)))


def join_split(large: DataFrame, other: DataFrame, on: list[str], how: str = "inner", shares: int | None = None) -> DataFrame:
    """``large`` joined (inner or left) with ``other`` on equal keys; heavy keys of ``large`` are split over several tasks."""
    left, right = split(large, other, on, "_part", shares)
    return left.join(right, [*on, "_part"], how).drop("_part")
