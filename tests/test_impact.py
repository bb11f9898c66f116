"""Pruned best match and split joins against brute force, and how much work they leave out."""

import math
import random

from pyspark.sql import functions as F

from conftest import SMALL
from test_matching import _numpy_best
from vitae.operators import impact, skew, tfidf
from vitae.session import materialize
from vitae.sources.tables import table


def corpus(seed, n, topics=40, common=25):
    """Texts of a few rare words of one topic each among many common ones."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: "".join(letters[(k * p + q) % 26] for p, q in ((1, 0), (3, 1), (7, 2), (11, 5)))
    out = []
    for i in range(n):
        t = rng.randrange(topics)
        rare = [f"{word(t)}{letters[rng.randrange(6)]}" for _ in range(6)]
        out.append((i, " ".join(rare + [f"w{letters[rng.randrange(common)]}" for _ in range(30)])))
    return out


def test_pruned_equals_numpy(spark):
    docs = table(spark, SMALL, "documents", "doc_id", "text")
    jobs = table(spark, SMALL, "benchmark", "item_id", "text")
    want = _numpy_best([tuple(r) for r in docs.collect()], [tuple(r) for r in jobs.collect()])
    got = {r.resume_id: (r.job_id, r.match_score) for r in tfidf.best_match(docs, jobs, pruned=True).collect()}
    assert set(got) == set(want)
    for k, (j, s) in want.items():
        assert got[k][0] == j and math.isclose(got[k][1], s, abs_tol=1e-6)


def test_common_words_leave_most_pairs_out(spark):
    rows, jobs = corpus(1, 600), corpus(2, 300)
    rows += [(1000, rows[0][1]), (1001, "zz zz"), (1002, ""), (1003, None), (-7, "wa wb wc")]
    jobs += [(900, jobs[3][1]), (901, "")]  # a copy, and a text without a word
    left, right = (spark.createDataFrame(x, "id long, t string") for x in (rows, jobs))
    tr, tj = (materialize(tfidf.term_table(x, "id", "t"), "tt") for x in (left, right))
    vocab = tfidf.fit_idf(tr, tj)
    wr, wj = (materialize(tfidf.weights(x, vocab), "w") for x in (tr, tj))
    full = tfidf.dot_products(wr, wj).count()
    pairs, left_out, _ = impact.candidates(wr, wj, 6)
    kept = pairs.count()
    assert left_out.count() > 0 and full > 0.95 * 600 * 300 and kept < full / 10
    direct = {tuple(r) for r in tfidf.best_match_from_terms(tr, tj, vocab, pruned=False).collect()}
    pruned = {tuple(r) for r in tfidf.best_match_from_terms(tr, tj, vocab, pruned=True).collect()}
    assert direct == pruned and len(pruned) == len({r.id for r in tr.select("id").collect()})


def test_ties_go_to_the_smallest_id_for_any_long(spark):
    left = spark.createDataFrame([(1, "ab cd"), (2, "xx")], "id long, t string")
    right = spark.createDataFrame([(2**62, "ab cd ee"), (-2**62, "ab cd ff"), (5, "qq")], "id long, t string")
    for pruned in (True, False):
        got = {r.resume_id: r.job_id for r in tfidf.best_match(left, right, id_col_r="id", text_col_r="t", id_col_j="id",
                                                              text_col_j="t", pruned=pruned).collect()}
        assert got == {1: -2**62, 2: -2**62}


def test_split_join_equals_join(spark):
    big = spark.range(0, 4000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id") % 900).alias("k"), F.col("id").alias("v"))
    small = spark.range(0, 800).select((F.col("id") % 400).alias("k"), F.col("id").alias("u"))
    heavy = skew.heavy_cells(big, ["k"], 16)
    cell = spark.range(7, 8).select(skew._cell(["id"])).first()[0]
    assert heavy[cell] >= 6 and len(heavy) <= 16
    for how in ("inner", "left"):
        want = sorted(map(str, big.join(small, "k", how).collect()))
        assert sorted(map(str, skew.join_split(big, small, ["k"], how, 16).collect())) == want
    spread = big.withColumn("_part", F.pmod(F.xxhash64("k", "v"), F.lit(heavy[cell])))
    sizes = [r["count"] for r in spread.where("k = 7").groupBy("_part").count().collect()]
    assert max(sizes) < 2 * 1500 / heavy[cell] and skew.heavy_cells(small, ["k"], 8) == {}


def test_split_join_of_nothing(spark):
    none = spark.range(0).select(F.col("id").alias("k"))
    assert skew.heavy_cells(none, ["k"]) == {} and skew.join_split(none, none.withColumn("u", F.lit(1)), ["k"]).count() == 0


def test_pairs_of_a_hot_job_equal_plain_sums(spark):
    from vitae.operators.tfidf import pair_similarity, rowwise_cosine
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    left = [(i, w, rng.randrange(1, 4)) for i in range(300) for w in rng.sample(words, 6)]
    right = [(j, w, rng.randrange(1, 4)) for j in range(30) for w in rng.sample(words, 9)]
    pairs = [(i, 7) for i in range(300)] + [(5, j) for j in range(30) if j != 7] + [(i, i % 30) for i in range(300) if i % 30 != 7 and i != 5]
    tl, tr = (spark.createDataFrame(x, "id long, term string, cnt long") for x in (left, right))
    pp = spark.createDataFrame(pairs + [(999, 7), (3, 999)], "lid long, rid long").repartition(6)
    dealt, copies = skew.split(pp, tr.select(F.col("id").alias("rid"), "term"), ["rid"], "_p", 16)
    sizes = [r["count"] for r in dealt.groupBy("rid", "_p").count().collect()]
    assert max(sizes) < 2.5 * len(pairs) / 16 and copies.where("rid = 7").select("_p").distinct().count() > 4
    weights = [t.select("id", "term", F.col("cnt").cast("double").alias("w")) for t in (tl, tr)]
    got = {(r.lid, r.rid): r.score for r in rowwise_cosine(pp, *weights, digits=None).collect()}
    lw, rw = ({}, {})
    for table_, rows in ((lw, left), (rw, right)):
        for i, w, c in rows:
            table_.setdefault(i, {})[w] = c
    want = {(i, j): float(sum(c * rw.get(j, {}).get(w, 0) for w, c in lw.get(i, {}).items())) for i, j in [*pairs, (999, 7), (3, 999)]}
    assert got == want
    alone = {(r.lid, r.rid): r.score for r in pair_similarity(pp, tl, tr, digits=None).collect()}
    k = 1 + math.log(1.5)
    for (i, j), dot in want.items():
        a, b = lw.get(i, {}), rw.get(j, {})
        n = math.sqrt(sum((c * (1 if w in b else k)) ** 2 for w, c in a.items()) * sum((c * (1 if w in a else k)) ** 2 for w, c in b.items()))
        assert math.isclose(alone[i, j], dot / n if n else 0.0, abs_tol=1e-12)
