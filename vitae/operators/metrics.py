"""Labels, thresholds, evaluation metrics, curves, splits and resampling.

Input is a *scored* table with a true class ``y`` (0/1), a ``score`` and, for
class metrics, a predicted class ``yhat``.

Scale: counts are one partial aggregation. Curves aggregate to distinct scores,
unrounded, and take their running counts in two passes over ranges of them
(``prefix.running_sums``); areas and best thresholds are then sums and maxima over rows
that each know their own step. Quartiles come from counts alone
(``prefix.order_statistics``). No task sees all scores or all values.
Ranks within a class (splits, folds, oversampling) come from a range-partitioned
sort plus per-partition offsets (``rank_within``): no task ever holds a class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitae.functions import dictionaries as D
from vitae.operators.prefix import order_statistics, running_sums
from vitae.session import materialize


def label(col, threshold: float) -> Column:
    """1 when the value is strictly above the threshold."""
    c = F.col(col) if isinstance(col, str) else col
    return (c > F.lit(float(threshold))).cast("int")


def decide(col, threshold: float) -> Column:
    """1 when the value is at or above the threshold."""
    c = F.col(col) if isinstance(col, str) else col
    return (c >= F.lit(float(threshold))).cast("int")


def _stack(df: DataFrame, key: str, cols: list[str], names: list[str] | None = None,
           value: str = "value") -> DataFrame:
    names = names or cols
    pairs = ", ".join(f"'{n}', `{c}`" for n, c in zip(names, cols))
    return df.selectExpr(f"stack({len(cols)}, {pairs}) as ({key}, {value})")


# ---------------------------------------------------------------- counts ---

def class_counts(df: DataFrame, y: str = "label") -> DataFrame:
    """Rows per class and the class's percentage of all rows."""
    w = Window.partitionBy()
    c = df.groupBy(F.col(y).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("label", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(w), 6).alias("pct"))


def threshold_sweep(df: DataFrame, col: str = "match_score",
                    thresholds=D.THRESHOLD_SWEEP) -> DataFrame:
    """Positives (``> t``), total and percentage per threshold, in one pass."""
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, t in enumerate(thresholds):
        aggs.append(F.count_if(F.col(col) > F.lit(float(t))).alias(f"p{i}"))
    row = df.agg(*aggs)
    stacked = row.selectExpr("total", "stack({}, {}) as (threshold, positives)".format(
        len(thresholds), ", ".join(f"CAST({float(t)} AS DOUBLE), p{i}" for i, t in enumerate(thresholds))))
    return stacked.select("threshold", F.col("positives").cast("long").alias("positives"),
                          F.col("total").cast("long").alias("total"),
                          F.round(F.when(F.col("total") > 0, F.col("positives") * 100.0 / F.col("total"))
                                  .otherwise(0.0), 6).alias("pct"))


def class_weights(df: DataFrame, y: str = "label") -> DataFrame:
    """Balanced ``n / (2 n_c)`` and custom ``{0: 1, 1: n0 / max(1, n1)}`` per class."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 0).alias("n0"),
                 F.count_if(F.col(y) == 1).alias("n1"))
    out = row.selectExpr(
        "stack(2, 0, n0, n, n0, n1, 1, n1, n, n0, n1) as (label, n_c, n, n0, n1)")
    return out.select(
        F.col("label").cast("int").alias("label"), F.col("n_c").cast("long").alias("n"),
        F.round(F.when(F.col("n_c") > 0, F.col("n") / (2.0 * F.col("n_c"))), 6).alias("balanced"),
        F.round(F.when(F.col("label") == 0, F.lit(1.0))
                .otherwise(F.col("n0") / F.greatest(F.lit(1), F.col("n1")).cast("double")), 6).alias("custom"))


# ------------------------------------------------------------ classifier ---

def confusion(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """All four cells of the 2×2 confusion matrix, zeros included."""
    row = df.agg(*[F.count_if((F.col(y) == a) & (F.col(yhat) == b)).alias(f"c{a}{b}")
                   for a in (0, 1) for b in (0, 1)])
    return row.selectExpr("stack(4, 0, 0, c00, 0, 1, c01, 1, 0, c10, 1, 1, c11) as (y, yhat, n)") \
        .select(F.col("y").cast("int"), F.col("yhat").cast("int"), F.col("n").cast("long"))


def accuracy(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Share of rows whose prediction equals the truth."""
    return df.agg(F.round(F.avg((F.col(y) == F.col(yhat)).cast("double")), 6).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Precision, recall, F1 and support per class, macro and weighted averages.

    Empty denominators give 0.
    """
    cells = {f"c{a}{b}": F.count_if((F.col(y) == a) & (F.col(yhat) == b)) for a in (0, 1) for b in (0, 1)}
    row = df.agg(*[v.alias(k) for k, v in cells.items()])

    def safe(num, den):
        return F.when(den > 0, num / den).otherwise(F.lit(0.0))

    cols = []
    for c in (0, 1):
        o = 1 - c
        tp, fp, fn = F.col(f"c{c}{c}"), F.col(f"c{o}{c}"), F.col(f"c{c}{o}")
        p = safe(tp.cast("double"), (tp + fp).cast("double"))
        r = safe(tp.cast("double"), (tp + fn).cast("double"))
        cols += [p.alias(f"p{c}"), r.alias(f"r{c}"), (tp + fn).alias(f"s{c}")]
    m = row.select(*cols)
    for c in (0, 1):
        m = m.withColumn(f"f{c}", safe(2 * F.col(f"p{c}") * F.col(f"r{c}"), F.col(f"p{c}") + F.col(f"r{c}")))
    tot = (F.col("s0") + F.col("s1")).cast("double")
    m = m.select(
        "*",
        ((F.col("p0") + F.col("p1")) / 2).alias("pm"), ((F.col("r0") + F.col("r1")) / 2).alias("rm"),
        ((F.col("f0") + F.col("f1")) / 2).alias("fm"),
        safe(F.col("p0") * F.col("s0") + F.col("p1") * F.col("s1"), tot).alias("pw"),
        safe(F.col("r0") * F.col("s0") + F.col("r1") * F.col("s1"), tot).alias("rw"),
        safe(F.col("f0") * F.col("s0") + F.col("f1") * F.col("s1"), tot).alias("fw"),
        (F.col("s0") + F.col("s1")).alias("st"))
    out = m.selectExpr(
        "stack(4, '0', p0, r0, f0, s0, '1', p1, r1, f1, s1, "
        "'macro avg', pm, rm, fm, st, 'weighted avg', pw, rw, fw, st) "
        "as (class, precision, recall, f1, support)")
    return out.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("long").alias("support"))


# ---------------------------------------------------------------- curves ---

def score_counts(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score: the curves' input."""
    return (df.groupBy(F.col(score).alias("threshold"))
            .agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")))


def curve(df: DataFrame, y: str = "y", score: str = "score") -> tuple[DataFrame, int, int]:
    """The running counts that ``roc_auc``, ``pr_auc``, ``average_precision`` and ``strict_f1_threshold`` start from, stored for several of them."""
    run, P, N = _running(df, y, score)
    return materialize(run, "curve"), P, N


def _running(df, y: str, score: str) -> tuple[DataFrame, int, int]:
    """(threshold, pos, neg, tp, fp at ``score >= threshold``), all positives, all negatives (E4); a ``curve`` as it is."""
    if isinstance(df, tuple):
        return df
    run, totals = running_sums(score_counts(df, y, score), [F.col("threshold").desc()], ["pos", "neg"])
    return run.withColumnsRenamed({"run_pos": "tp", "run_neg": "fp"}), int(totals["pos"]), int(totals["neg"])


def _precision(tp: Column, fp: Column, empty: float = 0.0) -> Column:
    return F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(empty))


def _pr_points(df: DataFrame, y: str, score: str) -> DataFrame:
    """PR points with the step from the next higher threshold: its recall and precision."""
    run, P, _ = _running(df, y, score)
    tp, fp = F.col("tp"), F.col("fp")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    first = tp0 + fp0 == 0
    recall, recall0 = ((tp / F.lit(P), tp0 / F.lit(P)) if P else (F.lit(1.0), F.when(first, 0.0).otherwise(1.0)))
    return run.select("threshold", _precision(tp, fp).alias("precision"), recall.alias("recall"), "tp", "fp",
                      _precision(tp0, fp0, 1.0).alias("precision0"), recall0.alias("recall0"))


def pr_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Precision and recall when predicting ``score >= t`` at each distinct score,
    plus the closing point (precision 1, recall 0, threshold NULL) (D16)."""
    close = df.sparkSession.createDataFrame(
        [(None, 1.0, 0.0, None, None)], "threshold double, precision double, recall double, tp long, fp long")
    return _pr_points(df, y, score).drop("precision0", "recall0").unionByName(close)


def roc_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """False and true positive rates at each distinct score, plus (0, 0)."""
    run, P, N = _running(df, y, score)
    pts = run.select("threshold", *[(F.col(c) / F.lit(n) if n else F.lit(float("nan"))).alias(out)
                                    for c, n, out in (("fp", N, "fpr"), ("tp", P, "tpr"))])
    start = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return pts.unionByName(start)


def _total(steps: DataFrame, step: Column, name: str) -> DataFrame:
    return steps.agg(F.round(F.coalesce(F.sum(step), F.lit(0.0)), 6).alias(name))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Area under the ROC curve: a trapezoid per threshold, neg · (2 tp − pos) / 2 of P · N."""
    run, P, N = _running(df, y, score)
    area = F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0 / F.lit(P) / F.lit(N) if P and N else F.lit(float("nan"))
    return _total(run, area, "roc_auc")


def pr_auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Area under the precision–recall curve by trapezoids."""
    step = (F.col("recall") - F.col("recall0")) * (F.col("precision") + F.col("precision0")) / 2.0
    return _total(_pr_points(df, y, score), step, "pr_auc")


def average_precision(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Σ (R_k − R_{k−1}) · P_k over thresholds from high to low, R_0 = 0."""
    return _total(_pr_points(df, y, score), (F.col("recall") - F.col("recall0")) * F.col("precision"), "average_precision")


def fold_average_precisions(df: DataFrame, fold: str, y: str = "y", score: str = "score") -> dict[int, float]:
    """``{fold: average precision}`` of all folds in one pass: running counts over (fold, falling score)."""
    counts = df.groupBy(F.col(fold).alias("fold"), F.col(score).alias("threshold")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    run, _ = running_sums(counts, [F.col("fold").asc(), F.col("threshold").desc()], ["pos", "neg"])
    sizes = sorted(counts.groupBy("fold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect(), key=lambda r: r["fold"])
    rows, pos, neg = [], 0, 0
    for r in sizes:
        rows.append((r["fold"], pos, neg, r["pos"]))
        pos, neg = pos + r["pos"], neg + r["neg"]
    starts = df.sparkSession.createDataFrame(rows, "fold int, pos0 long, neg0 long, P long")
    tp, fp = F.col("run_pos") - F.col("pos0"), F.col("run_neg") - F.col("neg0")
    step = F.when(F.col("P") > 0, F.col("pos") / F.col("P") * tp / (tp + fp)).otherwise(0.0)
    found = run.join(F.broadcast(starts), "fold").groupBy("fold").agg(F.round(F.sum(step), 6).alias("ap")).collect()
    return {r["fold"]: r["ap"] for r in found}


def best_f1_threshold(df: DataFrame, y: str = "y", score: str = "score", eps: float = 1e-8) -> DataFrame:
    """Threshold maximising ``2PR / (P + R + eps)``; first maximum in ascending order."""
    f1 = 2 * (F.col("precision") * F.col("recall")) / (F.col("precision") + F.col("recall") + F.lit(eps))
    best = _pr_points(df, y, score).select(f1.alias("f1"), "threshold").agg(
        F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("neg"))).alias("b"))
    return best.select((-F.col("b.neg")).alias("threshold"), F.round("b.f1", 6).alias("f1"))


def strict_f1_threshold(df: DataFrame, y: str = "y", score: str = "score", margin: float = 0.03) -> DataFrame:
    """Plain F1 ``2tp / (2tp + fp + fn)`` (0 if undefined) at each PR threshold; first
    maximum in ascending order, then ``min(1, t + margin)`` (D21)."""
    run, P, _ = _running(df, y, score)
    fn = F.lit(P) - F.col("tp")
    den = 2 * F.col("tp") + F.col("fp") + fn
    f1 = F.when(den > 0, 2.0 * F.col("tp") / den).otherwise(F.lit(0.0))
    best = run.select(f1.alias("f1"), "threshold").agg(
        F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("neg"))).alias("b"))
    return best.select(F.round(F.least(F.lit(1.0), -F.col("b.neg") + F.lit(margin)), 6).alias("threshold"),
                       F.round("b.f1", 6).alias("f1"))


def natural_threshold(df: DataFrame, score: str = "score") -> DataFrame:
    """Midpoint of the two 1-D cluster centres of the exact best 2-way split.

    Every split "values ≤ v | values > v" at a distinct value v is scored by its
    within-group sum of squares from running sums; the smallest wins (ties: the
    lowest v). Output: ``threshold, low_center, high_center``.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    counts = counts.select("v", "c", (F.col("c") * F.col("v")).alias("s"), (F.col("c") * F.col("v") * F.col("v")).alias("q"))
    run, total = running_sums(counts, [F.col("v").asc()], ["c", "s", "q"])
    n, s, q = (F.lit(total[k]) for k in "csq")
    n1, s1, q1 = (F.col(f"run_{k}") for k in "csq")
    sse = q1 - s1 * s1 / n1 + (q - q1) - (s - s1) * (s - s1) / (n - n1)
    best = run.where(n1 < n).select("v", n1.alias("n1"), s1.alias("s1"), (n - n1).alias("n2"), (s - s1).alias("s2"),
                                    sse.alias("sse")).agg(
        F.min(F.struct(F.round("sse", 9).alias("sse"), "v", "n1", "s1", "n2", "s2")).alias("b"))
    return _midpoint(best, F.col("b.s1") / F.col("b.n1"), F.col("b.s2") / F.col("b.n2"))


def _midpoint(row: DataFrame, lo: Column, hi: Column) -> DataFrame:
    return row.select(F.round((lo + hi) / 2.0, 6).alias("threshold"),
                      F.round(lo, 6).alias("low_center"), F.round(hi, 6).alias("high_center"))


def cluster_centers(df: DataFrame, score: str = "score", most: int = 300) -> tuple[float, float] | None:
    """The two centres that Lloyd's iterations from the least and the greatest value reach.

    The values are a histogram in a table, one row per distinct value; an
    iteration is one sum over it, and only the two means reach the driver. A
    value in the middle goes to the lower centre. None without values.
    """
    counts = materialize(df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("v"))
                         .agg(F.count(F.lit(1)).alias("c")), "histogram")
    lo, hi = counts.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        return None
    low = None
    for _ in range(most):
        near = F.col("v") <= F.lit((lo + hi) / 2.0)
        row = counts.agg(*[f(F.when(side, x)).alias(n) for n, f, side, x in (
            ("n1", F.sum, near, F.col("c")), ("s1", F.sum, near, F.col("c") * F.col("v")),
            ("n2", F.sum, ~near, F.col("c")), ("s2", F.sum, ~near, F.col("c") * F.col("v")))]).first()
        if row["n1"] == low:  # the same values lie on each side: a fixed point
            break
        low = row["n1"]
        lo = row["s1"] / row["n1"] if row["n1"] else lo
        hi = row["s2"] / row["n2"] if row["n2"] else hi
    return lo, hi


def cluster_threshold(df: DataFrame, score: str = "score") -> DataFrame:
    """Midpoint of the two cluster centres of the scores, with the centres."""
    centers = cluster_centers(df, score)
    found = df.sparkSession.createDataFrame([centers] if centers else [], "lo double, hi double")
    return _midpoint(found, F.col("lo"), F.col("hi"))


# ------------------------------------------------------------ statistics ---

def describe(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear interpolation), max per column.

    The columns are stacked into ``(feature, value)`` rows; moments are one
    partial aggregation, quartiles exact order statistics.
    """
    long = materialize(df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("x")).select("x.feature", "x.value"), "stacked")
    stats = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    qs = quantiles_by(long, "feature", "value", cols, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    out = stats.join(F.broadcast(qs), "feature", "left")  # one row per column
    return out.select("feature", F.col("count").cast("long").alias("count"),
                      *[F.round(x, digits).alias(x) for x in ("mean", "std", "min", "q25", "q50", "q75", "max")])


def quantiles_by(long: DataFrame, key: str, value: str, keys: list, qs: list[float], names: list[str]) -> DataFrame:
    """Exact quantiles (linear interpolation) of ``value`` for each of ``keys``, one column per q; keys without values have none."""
    sizes = {r[key]: r["n"] for r in long.where(F.col(key).isin(*keys)).groupBy(key).agg(F.count(value).alias("n")).collect()}
    at = {k: [(n - 1) * float(q) for q in qs] for k, n in sizes.items() if n}
    found = order_statistics(long, key, value, {k: {r for h in hs for r in (math.floor(h), math.ceil(h))} for k, hs in at.items()})
    rows = []
    for k, hs in at.items():
        ends = [(found[k][math.floor(h)], found[k][math.ceil(h)], h - math.floor(h)) for h in hs]
        rows.append((k, *[a + share * (b - a) for a, b, share in ends]))
    kind = dict(long.dtypes)[key]
    return long.sparkSession.createDataFrame(rows, f"`{key}` {kind}, " + ", ".join(f"`{n}` double" for n in names))


def correlations(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """Pearson correlation of every pair of columns, long form, one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    stacked = row.selectExpr("stack({}, {}) as (a, b, r)".format(
        len(pairs), ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs)))
    return stacked.select("a", "b", F.round("r", digits).alias("corr"))


def histogram(df: DataFrame, col: str, bins: int = 20, digits: int = 6) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is closed."""
    df = materialize(df.select(col), "histogram-values")  # read twice, worked out once
    mm = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n long")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", F.round(F.lit(lo) + F.col("bin") * F.lit(width), digits).alias("lower"),
                         F.round(F.lit(lo) + (F.col("bin") + 1) * F.lit(width), digits).alias("upper"),
                         F.col("n").cast("long").alias("n"))


# ----------------------------------------------------- ranks and samples ---

def rank_within(df: DataFrame, by: str, order: Column, out: str = "rank") -> DataFrame:
    """0-based rank of each row within its ``by`` group, ascending ``order``.

    A range-partitioned sort spreads every group over many tasks and numbers
    the rows in order; a row's rank is its distance from the first row of its
    group in its task, plus the group's rows in earlier tasks (one row per task
    and group is added up). No task holds a whole group.
    """
    ranged = df.withColumn("_ord", order).repartitionByRange(by, "_ord").sortWithinPartitions(by, "_ord").drop("_ord")
    numbered = materialize(ranged.withColumn("_pid", F.spark_partition_id())
                           .withColumn("_at", F.monotonically_increasing_id()), "ranked")
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (numbered.groupBy(F.col("_pid").alias("_p"), F.col(by).alias("_g"))
               .agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")))
    return (numbered.join(offsets, (F.col("_pid") == F.col("_p")) & F.col(by).eqNullSafe(F.col("_g")))
            .withColumn(out, (F.col("_at") + F.col("_off")).cast("long"))
            .drop("_pid", "_at", "_p", "_g", "_n", "_first", "_off"))


def hash_order(id_col: str, seed: int = 42) -> Column:
    """Deterministic pseudo-random order: md5 of the seed and the id, as bytes."""
    return F.unhex(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))))


def stratified_split(df: DataFrame, id_col: str, y: str = "y", test_frac: float = 0.2,
                     seed: int = 42, stratify: bool = True, keep_rank: bool = False) -> DataFrame:
    """Adds ``is_test``: per class (or overall) the first ``ceil(frac · n)`` rows in
    hash order are the test set (M7). With ``keep_rank`` also ``_r``, the place in that order."""
    by = y if stratify else "_all"
    base = df if stratify else df.withColumn("_all", F.lit(0))
    ranked = rank_within(base, by, hash_order(id_col, seed), "_r")
    sizes = base.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    out = ranked.join(F.broadcast(sizes), by).withColumn(
        "is_test", (F.col("_r") < F.ceil(F.col("_n") * F.lit(float(test_frac)))).cast("int"))
    out = out.drop("_n") if keep_rank else out.drop("_r", "_n")
    return out.drop("_all") if not stratify else out


def folds(df: DataFrame, id_col: str, y: str = "y", k: int | None = None, seed: int = 42, ranked: bool = False) -> DataFrame:
    """Stratified fold number ``rank within class mod k``; k = min(5, positives) (E5).

    With ``ranked``, ``df`` has the rank already: ``_r`` of a stratified split in the same seed's order."""
    if k is None:
        pos = df.agg(F.count_if(F.col(y) == 1)).first()[0]
        k = max(1, min(5, int(pos)))
    placed = df if ranked else rank_within(df, y, hash_order(id_col, seed), "_r")
    return placed.withColumn("fold", F.pmod(F.col("_r"), F.lit(k)).cast("int")).drop("_r")


def oversample(df: DataFrame, id_col: str, y: str = "y", seed: int = 42) -> DataFrame:
    """Random oversampling of class 1 to the size of class 0, only if it is smaller (M8).

    Each minority row is repeated ``floor(n0 / n1)`` times, and the first
    ``n0 mod n1`` minority rows in hash order once more. Adds ``copy``.
    """
    row = df.agg(F.count_if(F.col(y) == 0).alias("n0"), F.count_if(F.col(y) == 1).alias("n1")).first()
    n0, n1 = int(row["n0"]), int(row["n1"])
    if n1 == 0 or n1 >= n0:
        return df.withColumn("copy", F.lit(0))
    reps, extra = n0 // n1, n0 % n1
    minority = rank_within(df.where(F.col(y) == 1), y, hash_order(id_col, seed), "_r")
    times = F.lit(reps) + F.when(F.col("_r") < extra, 1).otherwise(0)
    grown = minority.select("*", F.explode(F.sequence(F.lit(0), times - 1)).alias("copy")).drop("_r")
    return df.where(F.col(y) != 1).withColumn("copy", F.lit(0)).unionByName(grown)


def sample_rows(df: DataFrame, id_col: str, n: int = 5, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows without replacement, deterministic by hash order."""
    return df.orderBy(hash_order(id_col, seed), F.col(id_col)).limit(n)
