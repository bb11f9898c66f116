"""Distributed running sums, order statistics, curves and clustering against plain Python."""

import inspect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitae.operators import metrics as M
from vitae.operators import prefix


def scored(spark, rows):
    return spark.createDataFrame([(i, y, s) for i, (y, s) in enumerate(rows)], "id long, y int, score double").repartition(5)


def test_running_sums_over_many_tasks(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(-5, 9), rng.random()) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, a int, b double").repartition(7)
    for order, sign in ((F.col("k").asc(), 1), (F.col("k").desc(), -1)):
        run, totals = prefix.running_sums(df, [order], ["a", "b"])
        got = {r.k: (r.run_a, r.run_b) for r in run.collect()}
        a = b = 0
        for k, x, y in sorted(rows, key=lambda r: sign * r[0]):
            a, b = a + x, b + y
            assert got[k][0] == a and math.isclose(got[k][1], b, rel_tol=1e-9)
        assert totals["a"] == a and math.isclose(totals["b"], b, rel_tol=1e-9)
        assert run.select("k", "a", "b").exceptAll(df).count() == 0


def test_running_sums_use_several_tasks_and_none_without_rows(spark):
    df = spark.range(0, 4000).select(F.col("id"), F.lit(1).alias("c"))
    run, _ = prefix.running_sums(df, [F.col("id").asc()], ["c"])
    assert run.where("run_c <> id + 1").count() == 0
    none, totals = prefix.running_sums(df.limit(0), [F.col("id").asc()], ["c"])
    assert none.count() == 0 and totals == {"c": 0}


VALUES = {
    "ties": [3.0] * 900 + [1.0] * 5 + [9.0] * 95,
    "top": [float(i % 3 == 0) for i in range(50)] + [5.0] * 5000,
    "wide": [(-1) ** i * 10.0 ** (i % 300) for i in range(2000)],
    "close": [1.0 + i * 2.0**-50 for i in range(1500)],
    "one": [2.5],
    "rand": list(np.random.default_rng(3).normal(size=3001)),
}


def test_order_statistics_of_odd_distributions(spark):
    rows = [(k, float(v)) for k, vs in VALUES.items() for v in vs] + [("ties", None), ("other", 1.0)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    ranks = {k: {0, len(v) // 4, len(v) // 2, len(v) - 1} for k, v in VALUES.items()}
    got = prefix.order_statistics(df, "k", "v", ranks)
    assert got == {k: {r: sorted(VALUES[k])[r] for r in rs} for k, rs in ranks.items()}
    qs = {r.k: r for r in M.quantiles_by(df, "k", "v", [*VALUES, "none"], [0.25, 0.5, 0.9], ["a", "b", "c"]).collect()}
    assert set(qs) == set(VALUES)
    for k, vs in VALUES.items():
        for name, q in (("a", 25), ("b", 50), ("c", 90)):
            assert math.isclose(qs[k][name], np.percentile(vs, q), rel_tol=1e-12)


def curve(rows):
    points, tp, fp = [], 0, 0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp += sum(y == 1 for y, s in rows if s == t)
        fp += sum(y != 1 for y, s in rows if s == t)
        points.append((t, tp, fp))
    return points


@pytest.mark.parametrize("kind", ["mixed", "no positives", "no negatives", "one score"])
def test_curves_on_unrounded_scores(spark, kind):
    rng = random.Random(kind)
    rows = [(int(rng.random() < 0.4), 0.5 + rng.randrange(40) * 1e-9 + rng.randrange(5) / 10) for _ in range(700)]
    rows = {"mixed": rows, "no positives": [(0, s) for _, s in rows], "no negatives": [(1, s) for _, s in rows],
            "one score": [(y, 0.25) for y, _ in rows]}[kind]
    df, points = scored(spark, rows), curve(rows)
    P = sum(y for y, _ in rows)
    N = len(rows) - P
    pr = {r.threshold: (r.precision, r.recall, r.tp, r.fp) for r in M.pr_curve(df).collect()}
    assert pr.pop(None) == (1.0, 0.0, None, None)
    assert pr == {t: (tp / (tp + fp), tp / P if P else 1.0, tp, fp) for t, tp, fp in points}
    if P and N:
        roc = {r.threshold: (r.fpr, r.tpr) for r in M.roc_curve(df).collect()}
        assert roc == {None: (0.0, 0.0), **{t: (fp / N, tp / P) for t, tp, fp in points}}
        auc = np.trapezoid([0, *[tp / P for _, tp, _ in points]], [0, *[fp / N for _, _, fp in points]])
        assert math.isclose(M.roc_auc(df).first()[0], round(float(auc), 6), abs_tol=1.1e-6)
    else:
        assert math.isnan(M.roc_auc(df).first()[0])
    steps = [(0.0, 1.0), *[(pr[t][1], pr[t][0]) for t, _, _ in points]]
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(steps, steps[1:]))
    ap = sum((b[0] - a[0]) * b[1] for a, b in zip(steps, steps[1:]))
    assert math.isclose(M.pr_auc(df).first()[0], round(area, 6), abs_tol=1.1e-6)
    assert math.isclose(M.average_precision(df).first()[0], round(ap, 6), abs_tol=1.1e-6)
    f1 = {t: 2 * p * r / (p + r + 1e-8) for t, (p, r, _, _) in pr.items()}
    best = M.best_f1_threshold(df).first()
    assert math.isclose(best.f1, max(f1.values()), abs_tol=1e-6) and math.isclose(f1[best.threshold], max(f1.values()), abs_tol=1e-12)


def test_cluster_centres_are_a_fixed_point(spark):
    rng = np.random.default_rng(5)
    values = [*rng.normal(0.1, 0.04, 400), *rng.normal(0.6, 0.1, 150), *[0.1] * 50]
    lo, hi = M.cluster_centers(scored(spark, [(0, float(v)) for v in values]))
    low = [v for v in values if v <= (lo + hi) / 2]
    high = [v for v in values if v > (lo + hi) / 2]
    assert math.isclose(lo, np.mean(low), rel_tol=1e-9) and math.isclose(hi, np.mean(high), rel_tol=1e-9)
    assert 0.05 < lo < 0.15 and 0.5 < hi < 0.7
    assert M.cluster_centers(scored(spark, [(0, 2.0)] * 3)) == (2.0, 2.0)
    assert M.cluster_threshold(scored(spark, [])).count() == 0
    exact = M.natural_threshold(scored(spark, [(0, float(v)) for v in values])).first()
    assert math.isclose(exact.threshold, (lo + hi) / 2, abs_tol=0.02)


def test_no_window_over_all_rows():
    assert "Window.orderBy" not in inspect.getsource(M) and "Window.orderBy" not in inspect.getsource(prefix)
