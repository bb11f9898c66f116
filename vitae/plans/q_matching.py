"""Registered queries: text cleaning, TF-IDF and similarity matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitae.operators import tfidf
from vitae.plans import sql as S
from vitae.plans.catalog import register
from vitae.session import materialize
from vitae.sources.tables import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text")


def _jobs(spark, sf_dir):
    return table(spark, sf_dir, "benchmark", "item_id", "text")


@register("match_best", S.with_(S.best_match_ctes(),
                                "SELECT resume_id, job_id, match_score FROM best"))
def match_best(spark, sf_dir):
    """Flagship: best job per distinct resume text (documents × benchmark)."""
    return tfidf.best_match(_docs(spark, sf_dir), _jobs(spark, sf_dir))


@register("match_best_resume", S.with_(
    S.best_match_ctes("benchmark", "item_id", "text", "documents", "doc_id", "text"),
    "SELECT resume_id AS job_id, job_id AS resume_id, match_score FROM best"))
def match_best_resume(spark, sf_dir):
    """Best distinct resume text per distinct job: each job meets all resumes, by the index ordered by impact."""
    best = tfidf.best_match(_jobs(spark, sf_dir), _docs(spark, sf_dir), id_col_r="item_id", id_col_j="doc_id", pruned=True)
    return best.select(F.col("resume_id").alias("job_id"), F.col("job_id").alias("resume_id"), "match_score")


@register("tfidf_union", S.with_(",".join([
    S.term_ctes("r", "documents", "doc_id", "text"), S.term_ctes("j", "benchmark", "item_id", "text"),
    S.idf_cte("vocab", "r", "j"), S.weight_ctes("r", "vocab"), S.weight_ctes("j", "vocab")]),
    "SELECT 'resume' AS side, id, term, round(w, 6) AS weight FROM r_w "
    "UNION ALL SELECT 'job', id, term, round(w, 6) FROM j_w"))
def tfidf_union(spark, sf_dir):
    """Unit-length TF-IDF rows of distinct resumes and jobs, vocabulary fitted on both."""
    tr = materialize(tfidf.term_table(_docs(spark, sf_dir), "doc_id", "text"), "terms_r")
    tj = materialize(tfidf.term_table(_jobs(spark, sf_dir), "item_id", "text"), "terms_j")
    vocab = tfidf.fit_idf(tr, tj)
    wr = tfidf.weights(tr, vocab).select(F.lit("resume").alias("side"), "id", "term", F.round("w", 6).alias("weight"))
    wj = tfidf.weights(tj, vocab).select(F.lit("job").alias("side"), "id", "term", F.round("w", 6).alias("weight"))
    return wr.unionByName(wj)


def _paired(spark, sf_dir):
    """Each document paired with one job: item_id = doc_id mod (number of jobs)."""
    docs = _docs(spark, sf_dir)
    n_jobs = _jobs(spark, sf_dir).count()
    return docs.select(F.col("doc_id").alias("lid"), F.pmod(F.col("doc_id"), F.lit(n_jobs)).alias("rid"))


_PAIRS_SQL = "pairs AS (SELECT doc_id AS lid, doc_id % (SELECT count(*) FROM benchmark) AS rid FROM documents)"


def _rowwise_sql():
    return ",".join([
        S.term_ctes("r", "(SELECT doc_id AS id0, text FROM documents)", "id0", "text").replace(
            "r_dist AS (SELECT min(id) AS id, t FROM r_clean GROUP BY t)", "r_dist AS (SELECT id, t FROM r_clean)"),
        S.term_ctes("j", "benchmark", "item_id", "text").replace(
            "j_dist AS (SELECT min(id) AS id, t FROM j_clean GROUP BY t)", "j_dist AS (SELECT id, t FROM j_clean)"),
        S.idf_cte("vocab", "r"), S.weight_ctes("r", "vocab"), S.weight_ctes("j", "vocab"), _PAIRS_SQL])


@register("pair_cosine_rowwise", S.with_(_rowwise_sql() + """,
dots AS (SELECT p.lid, p.rid, sum(r.w * j.w) AS dot FROM pairs p JOIN r_w r ON r.id = p.lid
         JOIN j_w j ON j.id = p.rid AND j.term = r.term GROUP BY p.lid, p.rid)""",
                                         """SELECT p.lid AS doc_id, p.rid AS item_id, round(coalesce(d.dot, 0.0), 6) AS score
FROM pairs p LEFT JOIN dots d ON d.lid = p.lid AND d.rid = p.rid"""))
def pair_cosine_rowwise(spark, sf_dir):
    """Row-wise cosine of given (resume, job) pairs; vocabulary fitted on the resume rows only,
    job terms outside it dropped (C2, M2, M4)."""
    # stored: the vocabulary and the weights both read the terms
    tr = materialize(tfidf.term_table(_docs(spark, sf_dir), "doc_id", "text", dedup=False), "terms_r")
    tj = materialize(tfidf.term_table(_jobs(spark, sf_dir), "item_id", "text", dedup=False), "terms_j")
    vocab = tfidf.fit_idf(tr)
    sim = tfidf.rowwise_cosine(_paired(spark, sf_dir), tfidf.weights(tr, vocab), tfidf.weights(tj, vocab))
    return sim.select(F.col("lid").alias("doc_id"), F.col("rid").alias("item_id"), "score")


@register("tfidf_apply", S.with_(_rowwise_sql(), "SELECT id AS item_id, term, round(w, 6) AS weight FROM j_w"))
def tfidf_apply(spark, sf_dir):
    """A vocabulary fitted on resumes, stored, and applied to job texts (M4, M2)."""
    tr = tfidf.term_table(_docs(spark, sf_dir), "doc_id", "text", dedup=False)
    tj = tfidf.term_table(_jobs(spark, sf_dir), "item_id", "text", dedup=False)
    vocab = tfidf.fit_idf(tr)
    return tfidf.weights(tj, vocab).select(F.col("id").alias("item_id"), "term", F.round("w", 6).alias("weight"))


def _pair_sql():
    import math
    one = f"(1.0 + {math.log(1.5)!r})"
    base = ",".join([
        S.term_ctes("r", "(SELECT doc_id AS id0, text FROM documents)", "id0", "text").replace(
            "r_dist AS (SELECT min(id) AS id, t FROM r_clean GROUP BY t)", "r_dist AS (SELECT id, t FROM r_clean)"),
        S.term_ctes("j", "benchmark", "item_id", "text").replace(
            "j_dist AS (SELECT min(id) AS id, t FROM j_clean GROUP BY t)", "j_dist AS (SELECT id, t FROM j_clean)"),
        _PAIRS_SQL])
    return S.with_(base + f""",
l AS (SELECT p.lid, p.rid, t.term, t.cnt FROM pairs p JOIN r_tf t ON t.id = p.lid),
r AS (SELECT p.lid, p.rid, t.term, t.cnt FROM pairs p JOIN j_tf t ON t.id = p.rid),
b AS (SELECT coalesce(l.lid, r.lid) AS lid, coalesce(l.rid, r.rid) AS rid, l.cnt AS lc, r.cnt AS rc
      FROM l FULL OUTER JOIN r ON l.lid = r.lid AND l.rid = r.rid AND l.term = r.term),
w AS (SELECT lid, rid, coalesce(lc, 0) * CASE WHEN lc IS NOT NULL AND rc IS NOT NULL THEN CAST(1.0 AS DOUBLE) ELSE CAST({one} AS DOUBLE) END AS lw,
             coalesce(rc, 0) * CASE WHEN lc IS NOT NULL AND rc IS NOT NULL THEN CAST(1.0 AS DOUBLE) ELSE CAST({one} AS DOUBLE) END AS rw FROM b),
s AS (SELECT lid, rid, sum(lw * rw) AS dot, sum(lw * lw) AS ll, sum(rw * rw) AS rr FROM w GROUP BY lid, rid)""",
                   """SELECT p.lid AS doc_id, p.rid AS item_id,
       round(CASE WHEN s.ll > 0 AND s.rr > 0 THEN s.dot / (sqrt(s.ll) * sqrt(s.rr)) ELSE 0.0 END, 4) AS score
FROM pairs p LEFT JOIN s ON s.lid = p.lid AND s.rid = p.rid""")


@register("pair_similarity", _pair_sql())
def pair_similarity(spark, sf_dir):
    """Cosine with the vectorizer refitted on each (resume, job) pair alone, 4 decimals."""
    tr = tfidf.term_table(_docs(spark, sf_dir), "doc_id", "text", dedup=False)
    tj = tfidf.term_table(_jobs(spark, sf_dir), "item_id", "text", dedup=False)
    sim = tfidf.pair_similarity(_paired(spark, sf_dir), tr, tj, digits=4)
    return sim.select(F.col("lid").alias("doc_id"), F.col("rid").alias("item_id"), "score")
