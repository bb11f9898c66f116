"""Registered queries: evaluation of best-match scores against true labels.

The scored table: every labelled resume with the best-match score of its text
(the flagship), and ``labels.quality`` as the true class; the predicted class is the
skills label rule ``score > 0.18`` (B7).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vitae.functions import dictionaries as D
from vitae.operators import metrics as M
from vitae.operators import tfidf
from vitae.plans import sql as S
from vitae.plans.catalog import register
from vitae.session import materialize
from vitae.sources.tables import table

T_SKILLS = D.LABEL_THRESHOLD_SKILLS


def scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    # stored: the match and the labels' texts both read them, so texts are cleaned once
    rows = materialize(tfidf.text_rows(docs, "doc_id", "text"), "rows")
    best = tfidf.best_match(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), rows_r=rows)
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    reps = tfidf.representatives_of(rows)
    named = labels.join(reps, F.col("doc_id") == F.col("id")).select("id", "rep", "quality")
    # stored: splits, folds and curves read the scores several times
    return materialize(named.join(best, F.col("rep") == F.col("resume_id")).select(
        "id", F.col("quality").cast("int").alias("y"),
        F.col("match_score").alias("score"), M.label("match_score", T_SKILLS).alias("yhat")), "scored")


SCORED = S.best_match_ctes() + f""",
scored AS (SELECT l.doc_id AS id, CAST(l.quality AS INTEGER) AS y, b.match_score AS score,
                  CAST(b.match_score > {T_SKILLS} AS INTEGER) AS yhat
           FROM labels l JOIN r_clean c ON c.id = l.doc_id JOIN r_dist d ON d.t IS NOT DISTINCT FROM c.t
           JOIN best b ON b.resume_id = d.id),
sc AS (SELECT score AS threshold, count(*) FILTER (WHERE y = 1) AS pos,
              count(*) FILTER (WHERE y <> 1) AS neg FROM scored GROUP BY score),
run AS (SELECT threshold,
          sum(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
          sum(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
          sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM sc),
pr AS (SELECT threshold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
              CASE WHEN P > 0 THEN tp / P ELSE 1.0 END AS recall,
              CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM run
       UNION ALL SELECT NULL, 1.0, 0.0, NULL, NULL),
roc AS (SELECT threshold, CASE WHEN N > 0 THEN fp / N ELSE 'nan'::DOUBLE END AS fpr,
               CASE WHEN P > 0 THEN tp / P ELSE 'nan'::DOUBLE END AS tpr FROM run
        UNION ALL SELECT NULL, 0.0, 0.0)"""


def q(body: str) -> str:
    return f"WITH {SCORED}\n{body}"


@register("label_scores", q("SELECT id, y, score, yhat FROM scored"))
def label_scores(spark, sf_dir):
    """Best-match scores with true and predicted class (B7, E10 corpus)."""
    return scored(spark, sf_dir)


@register("confusion_matrix", q("""
SELECT CAST(c.y AS INTEGER) AS y, CAST(c.yhat AS INTEGER) AS yhat, CAST(coalesce(k.n, 0) AS BIGINT) AS n
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(y, yhat)
LEFT JOIN (SELECT y, yhat, count(*) AS n FROM scored GROUP BY y, yhat) k
  ON k.y = c.y AND k.yhat = c.yhat"""))
def confusion_matrix(spark, sf_dir):
    """2×2 confusion matrix."""
    return M.confusion(scored(spark, sf_dir))


@register("accuracy", q("SELECT round(avg(CAST(y = yhat AS DOUBLE)), 6) AS accuracy, count(*) AS n FROM scored"))
def accuracy(spark, sf_dir):
    """Accuracy (D14)."""
    return M.accuracy(scored(spark, sf_dir))


@register("classification_report", q("""
, cells AS (SELECT count(*) FILTER (WHERE y = 0 AND yhat = 0) AS c00, count(*) FILTER (WHERE y = 0 AND yhat = 1) AS c01,
                   count(*) FILTER (WHERE y = 1 AND yhat = 0) AS c10, count(*) FILTER (WHERE y = 1 AND yhat = 1) AS c11
            FROM scored),
per AS (SELECT CASE WHEN c00 + c10 > 0 THEN c00 / (c00 + c10) ELSE 0.0 END AS p0,
               CASE WHEN c00 + c01 > 0 THEN c00 / (c00 + c01) ELSE 0.0 END AS r0, c00 + c01 AS s0,
               CASE WHEN c11 + c01 > 0 THEN c11 / (c11 + c01) ELSE 0.0 END AS p1,
               CASE WHEN c11 + c10 > 0 THEN c11 / (c11 + c10) ELSE 0.0 END AS r1, c11 + c10 AS s1 FROM cells),
f AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f0,
                CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1 FROM per),
rows_ AS (
  SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM f
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM f
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM f
  UNION ALL SELECT 'weighted avg',
    CASE WHEN s0 + s1 > 0 THEN (p0 * s0 + p1 * s1) / CAST(s0 + s1 AS DOUBLE) ELSE 0.0 END,
    CASE WHEN s0 + s1 > 0 THEN (r0 * s0 + r1 * s1) / CAST(s0 + s1 AS DOUBLE) ELSE 0.0 END,
    CASE WHEN s0 + s1 > 0 THEN (f0 * s0 + f1 * s1) / CAST(s0 + s1 AS DOUBLE) ELSE 0.0 END, s0 + s1 FROM f)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM rows_""".replace("\n, cells", ", cells", 1)))
def classification_report(spark, sf_dir):
    """Per-class precision/recall/F1/support with macro and weighted averages."""
    return M.classification_report(scored(spark, sf_dir))


@register("pr_curve", q("SELECT threshold, precision, recall, tp, fp FROM pr"))
def pr_curve(spark, sf_dir):
    """Precision–recall curve at every distinct score."""
    return M.pr_curve(scored(spark, sf_dir))


@register("roc_curve", q("SELECT threshold, fpr, tpr FROM roc"))
def roc_curve(spark, sf_dir):
    """ROC curve at every distinct score."""
    return M.roc_curve(scored(spark, sf_dir))


@register("roc_auc", q("""
SELECT round(coalesce(sum(a), 0.0), 6) AS roc_auc FROM (
  SELECT abs(fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2.0 AS a FROM roc
  WINDOW w AS (ORDER BY coalesce(threshold, 'inf'::DOUBLE) DESC)) s"""))
def roc_auc(spark, sf_dir):
    """Area under the ROC curve by trapezoids."""
    return M.roc_auc(scored(spark, sf_dir))


@register("pr_auc", q("""
SELECT round(coalesce(sum(a), 0.0), 6) AS pr_auc FROM (
  SELECT abs(recall - lag(recall) OVER w) * (precision + lag(precision) OVER w) / 2.0 AS a FROM pr
  WINDOW w AS (ORDER BY coalesce(threshold, 'inf'::DOUBLE) DESC)) s"""))
def pr_auc(spark, sf_dir):
    """Area under the precision–recall curve by trapezoids."""
    return M.pr_auc(scored(spark, sf_dir))


@register("average_precision", q("""
SELECT round(coalesce(sum(s), 0.0), 6) AS average_precision FROM (
  SELECT (recall - coalesce(lag(recall) OVER (ORDER BY threshold DESC), 0.0)) * precision AS s
  FROM pr WHERE threshold IS NOT NULL) x"""))
def average_precision(spark, sf_dir):
    """Average precision."""
    return M.average_precision(scored(spark, sf_dir))


@register("best_f1_threshold", q("""
SELECT threshold, round(f1, 6) AS f1 FROM (
  SELECT threshold, 2 * (precision * recall) / (precision + recall + 1e-8) AS f1
  FROM pr WHERE threshold IS NOT NULL) x ORDER BY f1 DESC, threshold ASC LIMIT 1"""))
def best_f1_threshold(spark, sf_dir):
    """Threshold of the best smoothed F1."""
    return M.best_f1_threshold(scored(spark, sf_dir))


@register("strict_f1_threshold", q("""
SELECT round(least(1.0, threshold + 0.03), 6) AS threshold, round(f1, 6) AS f1 FROM (
  SELECT threshold, CASE WHEN 2 * tp + fp + ((SELECT count(*) FROM scored WHERE y = 1) - tp) > 0
         THEN 2.0 * tp / (2 * tp + fp + ((SELECT count(*) FROM scored WHERE y = 1) - tp)) ELSE 0.0 END AS f1
  FROM pr WHERE threshold IS NOT NULL) x ORDER BY f1 DESC, threshold ASC LIMIT 1"""))
def strict_f1_threshold(spark, sf_dir):
    """Best plain-F1 threshold made 0.03 stricter."""
    return M.strict_f1_threshold(scored(spark, sf_dir))


@register("natural_threshold", q("""
, vc AS (SELECT score AS v, count(*) AS c, sum(score) AS s, sum(score * score) AS q
         FROM scored GROUP BY score),
r AS (SELECT v, sum(c) OVER w AS n1, sum(s) OVER w AS s1, sum(q) OVER w AS q1,
             sum(c) OVER () AS n, sum(s) OVER () AS st, sum(q) OVER () AS qt
      FROM vc WINDOW w AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sp AS (SELECT v, n1, s1, n - n1 AS n2, st - s1 AS s2,
              q1 - s1 * s1 / n1 + (qt - q1) - (st - s1) * (st - s1) / (n - n1) AS sse
       FROM r WHERE n1 < n),
b AS (SELECT * FROM sp ORDER BY round(sse, 9), v LIMIT 1)
SELECT round((s1 / n1 + s2 / n2) / 2.0, 6) AS threshold, round(s1 / n1, 6) AS low_center,
       round(s2 / n2, 6) AS high_center FROM b""".replace("\n, vc", ", vc", 1)))
def natural_threshold(spark, sf_dir):
    """Natural threshold: midpoint of the best two-group split of the scores."""
    return M.natural_threshold(scored(spark, sf_dir))


@register("cluster_threshold", "WITH RECURSIVE" + q("""
, lloyd(i, lo, hi) AS (
  SELECT 0, min(score), max(score) FROM scored
  UNION
  SELECT * FROM (SELECT i + 1, coalesce(avg(score) FILTER (WHERE score <= (lo + hi) / 2), lo),
                        coalesce(avg(score) FILTER (WHERE score > (lo + hi) / 2), hi)
                 FROM lloyd, scored WHERE i < 300 GROUP BY i, lo, hi))
SELECT round((lo + hi) / 2.0, 6) AS threshold, round(lo, 6) AS low_center, round(hi, 6) AS high_center
FROM lloyd ORDER BY i DESC LIMIT 1""".replace("\n, lloyd", ", lloyd", 1)).removeprefix("WITH"))
def cluster_threshold(spark, sf_dir):
    """Threshold halfway between the two cluster centres of the scores."""
    return M.cluster_threshold(scored(spark, sf_dir))


def _rank_sql(partition: str = "y") -> str:
    return (f"row_number() OVER (PARTITION BY {partition} "
            "ORDER BY md5(concat_ws(':', '42', CAST(id AS VARCHAR)))) - 1")


@register("stratified_split", q(f"""
, rk AS (SELECT *, {_rank_sql()} AS r, count(*) OVER (PARTITION BY y) AS n FROM scored)
SELECT id, y, score, yhat, CAST(r < ceil(n * 0.2) AS INTEGER) AS is_test FROM rk""".replace("\n, rk", ", rk", 1)))
def stratified_split(spark, sf_dir):
    """80/20 split stratified by class, deterministic hash order (M7)."""
    return M.stratified_split(scored(spark, sf_dir), "id", "y", 0.2)


@register("cv_folds", q(f"""
, k AS (SELECT greatest(1, least(5, count(*) FILTER (WHERE y = 1))) AS k FROM scored)
SELECT id, y, score, yhat, CAST(({_rank_sql()}) % (SELECT k FROM k) AS INTEGER) AS fold
FROM scored""".replace("\n, k", ", k", 1)))
def cv_folds(spark, sf_dir):
    """Stratified folds, k = min(5, positives) (E5)."""
    return M.folds(scored(spark, sf_dir), "id", "y")


@register("oversample", q(f"""
, cnt AS (SELECT count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1 FROM scored),
minority AS (SELECT s.*, {_rank_sql()} AS r FROM scored s WHERE y = 1)
SELECT id, y, score, yhat, 0 AS copy FROM scored
WHERE y <> 1 OR (SELECT n1 = 0 OR n1 >= n0 FROM cnt)
UNION ALL
SELECT id, y, score, yhat, CAST(unnest(range((SELECT n0 // n1 FROM cnt)
         + CASE WHEN r < (SELECT n0 % n1 FROM cnt) THEN 1 ELSE 0 END)) AS INTEGER) AS copy
FROM minority WHERE (SELECT n1 > 0 AND n1 < n0 FROM cnt)""".replace("\n, cnt", ", cnt", 1)))
def oversample(spark, sf_dir):
    """Random oversampling of the minority class to parity (M8)."""
    return M.oversample(scored(spark, sf_dir), "id", "y").select(
        "id", "y", "score", "yhat", F.col("copy").cast("int").alias("copy"))


@register("review_sample", q("""
SELECT id, y, score, yhat FROM scored WHERE y = 1
ORDER BY md5(concat_ws(':', '42', CAST(id AS VARCHAR))), id LIMIT 5"""))
def review_sample(spark, sf_dir):
    """Up to 5 positive rows for review, without replacement."""
    s = scored(spark, sf_dir)
    return M.sample_rows(s.where(F.col("y") == 1), "id", 5)
