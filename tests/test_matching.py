import math

import numpy as np

from conftest import SMALL
from vitae.operators import tfidf
from vitae.sources.tables import table


def test_pair_scope_golden(spark):
    # texts cleaned by deletion: commas vanish, so only "script" is shared
    r = spark.createDataFrame([(1, "Python,Machine Learning,java,java script")], "id long, t string")
    j = spark.createDataFrame([(2, "java,java script, Data Science")], "id long, t string")
    tr = tfidf.term_table(r, "id", "t", "delete", dedup=False)
    tj = tfidf.term_table(j, "id", "t", "delete", dedup=False)
    pairs = spark.createDataFrame([(1, 2)], "lid long, rid long")
    assert tfidf.pair_similarity(pairs, tr, tj).first()["score"] == 0.1708


def test_pair_scope_empty_is_zero(spark):
    r = spark.createDataFrame([(1, "!!")], "id long, t string")
    j = spark.createDataFrame([(2, "")], "id long, t string")
    pairs = spark.createDataFrame([(1, 2)], "lid long, rid long")
    got = tfidf.pair_similarity(pairs, tfidf.term_table(r, "id", "t", dedup=False),
                                tfidf.term_table(j, "id", "t", dedup=False)).first()["score"]
    assert got == 0.0


def _numpy_best(docs, jobs):
    import re
    def clean(t):
        return re.sub(r"^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$", "", re.sub(r"[^a-z \t\n\r\f\x0b]", "", t.lower()))
    def first_ids(rows):
        seen = {}
        for i, t in sorted(rows):
            seen.setdefault(clean(t), i)
        return sorted((i, t) for t, i in seen.items())
    R, J = first_ids(docs), first_ids(jobs)
    toks = [[w for w in re.split(r"[ \t\n\r\f\x0b]+", t) if len(w) >= 2] for _, t in R + J]
    vocab = sorted({w for ts in toks for w in ts})
    index = {w: k for k, w in enumerate(vocab)}
    X = np.zeros((len(toks), len(vocab)))
    for r, ts in enumerate(toks):
        for w in ts:
            X[r, index[w]] += 1
    n = len(toks)
    df = (X > 0).sum(axis=0)
    X = X * (np.log((1 + n) / (1 + df)) + 1)
    norms = np.linalg.norm(X, axis=1, keepdims=True)
    X = np.divide(X, norms, out=np.zeros_like(X), where=norms > 0)
    S = np.round(X[:len(R)] @ X[len(R):].T, 6)
    out = {}
    for a, (rid, _) in enumerate(R):
        b = int(np.argmax(S[a]))  # first maximum = smallest job id
        out[rid] = (J[b][0], float(S[a, b]))
    return out


def test_best_match_against_numpy(spark):
    docs = table(spark, SMALL, "documents", "doc_id", "text")
    jobs = table(spark, SMALL, "benchmark", "item_id", "text")
    want = _numpy_best([tuple(r) for r in docs.collect()], [tuple(r) for r in jobs.collect()])
    got = {r.resume_id: (r.job_id, r.match_score) for r in tfidf.best_match(docs, jobs).collect()}
    assert set(got) == set(want)
    for k, (j, s) in want.items():
        assert got[k][0] == j and math.isclose(got[k][1], s, abs_tol=1e-6)


def test_salted_shuffle_path_equals_broadcast(spark):
    docs = table(spark, SMALL, "documents", "doc_id", "text")
    jobs = table(spark, SMALL, "benchmark", "item_id", "text")
    a = {tuple(r) for r in tfidf.best_match(docs, jobs).collect()}
    b = {tuple(r) for r in tfidf.best_match(docs, jobs, limit=0).collect()}
    assert a == b


def test_self_similarity_is_one(spark):
    d = spark.createDataFrame([(1, "alpha beta beta gamma")], "id long, t string")
    tt = tfidf.term_table(d, "id", "t")
    v = tfidf.fit_idf(tt, materialize_result=False)
    w = tfidf.weights(tt, v)
    dots = tfidf.dot_products(w, w).first()
    assert math.isclose(dots["dot"], 1.0)
