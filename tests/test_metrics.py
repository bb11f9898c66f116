import math

import numpy as np
from pyspark.sql import functions as F

from vitae.operators import metrics as M

Y = [1, 0, 1, 1, 0, 0, 1, 0, 1, 0, 0, 1]
S = [0.9, 0.1, 0.8, 0.35, 0.4, 0.2, 0.7, 0.65, 0.3, 0.05, 0.5, 0.6]


def scored(spark):
    rows = [(i, y, s, int(s > 0.5)) for i, (y, s) in enumerate(zip(Y, S))]
    return spark.createDataFrame(rows, "id long, y int, score double, yhat int")


def np_curve():
    ts = sorted(set(S), reverse=True)
    y, s = np.array(Y), np.array(S)
    P = y.sum()
    pts = []
    for t in ts:
        pred = s >= t
        tp, fp = int((pred & (y == 1)).sum()), int((pred & (y == 0)).sum())
        pts.append((t, tp, fp))
    return pts, P, len(Y) - P


def test_confusion_and_accuracy(spark):
    df = scored(spark)
    cells = {(r.y, r.yhat): r.n for r in M.confusion(df).collect()}
    yh = [int(s > 0.5) for s in S]
    for a in (0, 1):
        for b in (0, 1):
            assert cells[(a, b)] == sum(1 for y, h in zip(Y, yh) if y == a and h == b)
    acc = M.accuracy(df).first()["accuracy"]
    assert math.isclose(acc, round(np.mean(np.array(Y) == np.array(yh)), 6))


def test_average_precision_and_auc(spark):
    df = scored(spark)
    pts, P, N = np_curve()
    ap, prev = 0.0, 0.0
    for _, tp, fp in pts:
        ap += (tp / P - prev) * (tp / (tp + fp))
        prev = tp / P
    assert math.isclose(M.average_precision(df).first()[0], round(ap, 6), abs_tol=1e-6)
    xs = [0.0] + [fp / N for _, _, fp in pts]
    ys = [0.0] + [tp / P for _, tp, _ in pts]
    auc = sum((xs[i] - xs[i - 1]) * (ys[i] + ys[i - 1]) / 2 for i in range(1, len(xs)))
    assert math.isclose(M.roc_auc(df).first()[0], round(auc, 6), abs_tol=1e-6)


def test_rank_within_equals_row_number(spark):
    df = spark.range(0, 500).select(F.col("id"), (F.col("id") % 3).alias("g"))
    got = {(r.id, r.rank) for r in M.rank_within(df, "g", M.hash_order("id")).collect()}
    rows = sorted(((r.g, r.k, r.id) for r in df.select("g", M.hash_order("id").alias("k"), "id").collect()))
    want, count = set(), {}
    for g, _, i in rows:
        want.add((i, count.get(g, 0)))
        count[g] = count.get(g, 0) + 1
    assert got == want


def test_natural_threshold_brute_force(spark):
    df = scored(spark)
    vals = sorted(S)
    best = None
    for k in range(1, len(vals)):
        a, b = vals[:k], vals[k:]
        sse = sum((x - np.mean(a)) ** 2 for x in a) + sum((x - np.mean(b)) ** 2 for x in b)
        if best is None or sse < best[0] - 1e-12:
            best = (sse, (np.mean(a) + np.mean(b)) / 2)
    assert math.isclose(M.natural_threshold(df).first()["threshold"], round(best[1], 6), abs_tol=1e-6)


def test_describe_quartiles(spark):
    df = scored(spark)
    row = M.describe(df, ["score"]).first()
    q = np.percentile(S, [25, 50, 75])
    assert math.isclose(row["q25"], round(q[0], 6)) and math.isclose(row["q50"], round(q[1], 6))
    assert math.isclose(row["std"], round(float(np.std(S, ddof=1)), 6))
