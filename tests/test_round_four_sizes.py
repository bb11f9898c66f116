"""Findings of FINDINGS_r04.md on screening, training and extraction at size."""

import re

import pytest

from conftest import SMALL
from vitae.operators import extract as X
from vitae.operators import screening as SC
from vitae.operators import strict
from vitae.plans import q_screening as Q
from vitae.session import materialize


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _under(plan, name):
    """The lines below each node ``name`` of a plan."""
    lines, out = plan.split("\n"), []
    depth = [m.start() if (m := re.search("[A-Za-z]", x)) else 0 for x in lines]
    for k, line in enumerate(lines):
        if name in line:
            for n in range(k + 1, len(lines)):
                if depth[n] <= depth[k]:
                    break
                out.append(lines[n])
    return "\n".join(out)


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ["screen_top10", "screen_ranked"])
def test_only_kept_pairs_meet_the_profiles(spark, monkeypatch, name):
    """Findings 5 and 7: what is ranked, sorted and stored holds keys and numbers; the rows are those of the wide way."""
    plans, write = {}, Q.materialize

    def seen(df, table):
        plans[table] = _plan(df)
        return write(df, table)

    monkeypatch.setattr(Q, "materialize", seen)
    got = _rows(getattr(Q, name)(spark, SMALL))
    assert "rank" in plans["kept-pairs"] and not re.search(r"email|phone|certifications|skills#", plans["kept-pairs"])
    monkeypatch.setattr(SC, "unique_profiles", lambda cands, jobs: False)
    assert got == _rows(getattr(Q, name)(spark, SMALL))


def test_ids_with_several_rows_are_told(spark):
    one = spark.createDataFrame([(1,), (None,), (None,)], "resume_id long")
    two = spark.createDataFrame([(1,), (2,), (2,)], "job_id long")
    assert not SC.unique_profiles(one, two) and SC.unique_profiles(one, two.distinct())


def test_texts_are_never_broadcast(spark):
    """Finding 8: a few entries go to the texts, however small the files of the texts look."""
    docs = materialize(spark.createDataFrame([(1, "hot blue bolt"), (2, "gear"), (3, None)], "id long, text string"), "docs")
    vocabulary = spark.createDataFrame([("blue bolt",), ("gear",)], "skill string")
    found = X.detect_skills(docs, vocabulary, "id", "text")
    plan = _plan(found)
    assert "ExistingRDD" in _under(plan, "BroadcastExchange") and "Generate" not in _under(plan, "BroadcastExchange")
    assert {r.id: r.skills for r in found.collect()} == {1: ["blue bolt"], 2: ["gear"], 3: []}
    boosts = strict.boosts(docs, spark.createDataFrame([("gear", 2.6)], "skill string, weight double"))
    assert "Generate" not in _under(_plan(boosts), "BroadcastExchange")
    assert "BroadcastExchange" not in _plan(strict.distinct_texts(docs))
    assert [(r.id, r.term, r.cnt) for r in boosts.collect()] == [(2, "gear", 5)]


def test_profiles_of_distinct_documents_are_worked_out_row_by_row(spark, monkeypatch):
    """Finding 6: few entries stand in the plan, and no document is shuffled; the rows are those of the joins."""
    text = ("Ann\nSkills\nblue bolt, Gear\nCertifications\n- Brand 13 Certified - Acme Board, 1996\nExperience\n"
            "Gear Engineer\nAcme Corp\n1996 - 1997\n\nBolt Engineer\nAcme Corp\n1998 - 1999")
    docs = materialize(spark.createDataFrame([(1, text), (2, "gear, gearbox"), (3, None), (4, ""), (None, "gear")],
                                             "doc_id long, text string"), "docs")
    vocabulary = spark.createDataFrame([("blue bolt",), ("gear",), ("blue",), (None,)], "skill string")
    found = X.parse_profiles(docs, vocabulary)
    assert "Exchange" not in _plan(found)
    rows = {r.doc_id: r for r in found.collect()}
    assert {k: r.skills for k, r in rows.items()} == {1: ["blue", "blue bolt", "gear"], 2: ["gear"], 3: [], 4: []}
    assert [j.duration for j in rows[1].work_experience if j.duration] == ["1998 - 1999", "1996 - 1997"]
    monkeypatch.setattr(X, "FEW_ENTRIES", 0)
    assert _rows(found) == _rows(X.parse_profiles(docs, vocabulary))
    twice = docs.unionByName(docs)
    assert X.parse_profiles(twice, vocabulary).where("doc_id = 2").count() == 4


def test_features_meet_each_pair_once(spark, monkeypatch):
    """Findings 3 and 4: features are worked out with two joins of the pairs; the rows are those of the wide rows."""
    from vitae.plans import q_features
    feats = q_features._feats(spark, SMALL)
    pairs = re.sub(r"#\d+L?", "", _plan(feats))
    assert "degree" not in pairs and not re.search(r"hashpartitioning\(resume_id, job_id", pairs)
    got = _rows(feats)
    monkeypatch.setattr(q_features, "unique_profiles", lambda cands, jobs: False)
    assert got == _rows(q_features._feats(spark, SMALL))


def test_training_ranks_rows_once(spark, monkeypatch):
    """Findings 3 and 4: the folds stand in the split's order, the curve is made once, a Newton step reads blocks."""
    from vitae.operators import metrics as M
    from vitae.operators import model as MD
    from vitae.operators import prefix
    rows = [(f"{i}:1", *[((i * k) % 97) / 97 for k in (3, 5, 7, 11, 13)], int((i * 31) % 100 < 30)) for i in range(600)]
    feats = spark.createDataFrame(rows, "row_id string, skill_similarity double, education_score double, certification_count double, "
                                        "experience_score double, keyword_match double, label int")
    calls, rank = [], M.rank_within
    monkeypatch.setattr(M, "rank_within", lambda df, *a, **k: calls.append(df) or rank(df, *a, **k))
    runs, running = [], M.running_sums
    monkeypatch.setattr(M, "running_sums", lambda *a: runs.append(a) or running(*a))
    fitted, summary = MD.train_full(feats, "row_id")
    assert len(calls) == 2 and len(runs) == 2  # the split, the smaller class; the test rows' curve, the folds' curves
    split = M.stratified_split(feats, "row_id", "label", 0.2, 42, keep_rank=True)
    folds = {r.row_id: r.fold for r in M.folds(feats, "row_id", "label").collect()}
    assert folds == {r.row_id: r.fold for r in M.folds(split, "row_id", "label", ranked=True).collect()}
    assert summary["cv_ap_mean"] == MD.cross_validated_ap(feats, "row_id", MD.FT.FEATURES, "label", "custom",
                                                          (summary["n_train"] - 144, 144))[1] and fitted.coefficients
