"""Best match: terms counted in a text's own row, only common terms shuffled, few texts against many without pairs on the network."""

import math
import re

from test_impact import corpus
from vitae.operators import impact, tfidf
from vitae.session import materialize


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffles(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", re.sub(r"#\d+L?", "", _plan(df)))


def _sides(spark, n_left, n_right):
    left, right = (spark.createDataFrame(x, "id long, t string") for x in (
        corpus(1, n_left) + [(1000, "zz zz"), (1001, "")], corpus(2, n_right) + [(9000, ""), (9001, "wa wb wc")]))
    tr, tj = (materialize(tfidf.term_table(x, "id", "t"), "tt") for x in (left, right))
    return tr, tj, tfidf.fit_idf(tr, tj)


def test_few_texts_meet_many_without_a_shuffle_of_pairs(spark):
    tr, tj, vocab = _sides(spark, 12, 500)
    wr, wj = (materialize(tfidf.weights(x, vocab), "w") for x in (tr, tj))
    best = impact.best_scores(wr, wj, 6)
    assert not any("lid" in keys and "rid" in keys for keys in _shuffles(best))
    full = {}
    for r in tfidf.dot_products(wr, wj).collect():
        full.setdefault(r.lid, []).append((-round(r.dot, 6), r.rid))
    got = {r.lid: (-r.score, r.rid) for r in best.collect()}
    assert got == {k: min(v) for k, v in full.items()}


def test_left_out_parts_are_met_the_cheaper_way(spark):
    tr, tj, vocab = _sides(spark, 200, 150)
    wr, wj = (materialize(tfidf.weights(x, vocab), "w") for x in (tr, tj))
    pairs, left_out, index = (materialize(x, "t") for x in impact.candidates(wr, wj, 6))
    every = materialize(wr.select("id").distinct().selectExpr("id AS lid").crossJoin(
        wj.select("id").distinct().selectExpr("id AS rid")), "pairs")
    for some, first in ((pairs.limit(3), "rid"), (every, "term")):  # few pairs meet their parts, many the index's blocks
        got = {(r.lid, r.rid): r.p for r in impact._rest(some.select("lid", "rid"), left_out, index).groupBy("lid", "rid")
               .agg({"partial": "sum"}).toDF("lid", "rid", "p").collect()}
        want = {(r.lid, r.rid): r.p for r in some.select("lid", "rid").join(left_out, "lid").join(index, ["rid", "term", "block"])
                .selectExpr("lid", "rid", "lw * rw AS p").groupBy("lid", "rid").agg({"p": "sum"}).toDF("lid", "rid", "p").collect()}
        assert want and got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    many = {(r.lid, r.rid, r.score) for r in impact.best_scores(wr, wj, 6, limit=0).collect()}
    assert many == {(r.lid, r.rid, r.score) for r in impact.best_scores(wr, wj, 6).collect()}


def test_term_table_counts_one_copy_and_shuffles_texts_not_terms(spark):
    rows = [(2, "bb aa aa"), (1, "bb aa aa"), (None, "bb aa aa"), (None, "cc x cc"), (3, None), (5, ""), (4, "x y"), (6, "!?")]
    docs = spark.createDataFrame(rows, "id long, t string")
    table = tfidf.term_table(docs, "id", "t")
    got = sorted(map(tuple, table.collect()), key=str)
    # a text of one-letter words is a text of its own; those that clean to nothing are one
    assert got == sorted([(1, "aa", 2), (1, "bb", 1), (None, "cc", 2), (3, None, 0), (5, None, 0), (4, None, 0)], key=str)
    assert set(_shuffles(table)) == {"_digest"}


def test_weights_of_wanted_terms_keep_the_length_over_all(spark):
    tt = spark.createDataFrame([(1, "aa", 2), (1, "bb", 1), (None, "aa", 1), (None, "cc", 4), (2, "cc", 1), (2, "aa", 3),
                                (2, "aa", 3), (3, None, 0)], "id long, term string, cnt long")
    other = spark.createDataFrame([(7, "aa", 1), (7, "bb", 1), (7, "zz", 1)], "id long, term string, cnt long")
    vocab = tfidf.fit_idf(tt, other)
    only = other.select("term").distinct()
    got = tfidf.weights(tt, vocab, only=only)
    key = lambda r: (r.id is None, r.id or 0, r.term, r.w)
    want = sorted(tfidf.weights(tt, vocab).join(only, "term", "left_semi").select("id", "term", "w").collect(), key=key)
    rows = sorted(got.collect(), key=key)
    assert [(r.id, r.term) for r in rows] == [(r.id, r.term) for r in want]
    assert all(math.isclose(a.w, b.w, abs_tol=1e-12) for a, b in zip(rows, want))


def test_stored_rows_give_match_and_representatives(spark):
    rows = [(i, t) for i, t in corpus(5, 40)] + [(100, corpus(5, 40)[3][1]), (101, None), (102, None), (103, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    jobs = spark.createDataFrame(corpus(6, 15), "item_id long, text string")
    stored = materialize(tfidf.text_rows(docs, "doc_id", "text"), "rows")
    assert {tuple(r) for r in tfidf.best_match(docs, jobs, rows_r=stored).collect()} == {
        tuple(r) for r in tfidf.best_match(docs, jobs).collect()}
    reps = {tuple(r) for r in tfidf.representatives_of(stored).collect()}
    assert reps == {tuple(r) for r in tfidf.representatives(docs, "doc_id", "text").collect()}
    assert (100, 3) in reps and (102, 101) in reps and (103, 103) in reps and len(reps) == len(rows)
