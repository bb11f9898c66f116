"""Strict skill texts by joins against the rules applied one after the other."""

import re

from pyspark.sql import functions as F

from vitae.operators import screening as SC
from vitae.operators import strict

RULES = {"js": "javascript", "ml": "machine-learning", "machine": "auto", "ui": "ui-designer", "materialui": "material-ui",
         "py": "Python", "python": "py3 $1 \\n", "aa": "bb", "bb": "cc", "cc": "aa", "nothing": "nothing", "x": "", "designer": "x y"}
WEIGHTS = {"javascript": 1.7, "Auto-learning": 2.0, "blue bolt": 1.0, "bolt": 0.4, "cc dd": 2.5, "a": 3.0, "x y": 1.5}


def rewrite(text):
    for synonym, standard in RULES.items():
        text = re.sub(r"\b" + re.escape(synonym) + r"\b", lambda _: standard, text, flags=re.IGNORECASE)
    return text


def counts(text):
    extra = [s for s, w in WEIGHTS.items() if re.search(r"\b" + re.escape(s.lower()) + r"\b", text.lower()) for _ in range(int(w * 2))]
    out = {}
    for w in re.findall(r"\w+", " ".join([text, *extra]).lower()):
        if len(w) >= 2:
            out[w] = out.get(w, 0) + 1
    return out


def test_closing_applies_every_rule_in_order(spark):
    got = {r.term: r.standard for r in strict.closed_synonyms(strict.rules_table(spark, RULES)).collect()}
    assert got == {k: rewrite(k) for k in RULES if rewrite(k) != k}
    two = strict.closed_synonyms(strict.rules_table(spark, {"materialui": "material-ui", "ui": "ui-designer"})).collect()
    assert {tuple(r) for r in two} == {("materialui", "material-ui-designer"), ("ui", "ui-designer")}


def test_texts_and_counts_equal_plain_python(spark):
    lists = {1: ["JS", "ML"], 2: ["Blue-Bolt", "bolt", "py"], 3: [], 4: None, 5: ["aa", "dd"], 6: ["bb dd", "x"], 7: ["materialui", "c++"],
             8: ["JS", "ML"], 9: ["nothing"], 10: ["a"]}
    rows = spark.createDataFrame(list(lists.items()), "rid long, skills array<string>")
    texts = strict.strict_texts(rows, "rid", F.col("skills"), RULES)
    got = {r.id: r.text for r in texts.collect()}

    def cleaned(skills):
        return re.sub(r"[^a-z]+", " ", " ".join(skills or []).lower()).strip(" ")

    want = {k: rewrite(cleaned(v)) for k, v in lists.items()}
    assert got == want
    terms = {}
    for r in strict.strict_terms(texts, WEIGHTS).collect():
        terms.setdefault(r.id, {})
        if r.term is not None:
            terms[r.id][r.term] = r.cnt
    assert terms == {k: counts(t) for k, t in want.items()}
    kept = {r.id for r in strict.distinct_texts(texts).collect()}
    assert 1 in kept and 8 not in kept and len(kept) == len(set(want.values()))


def test_no_rules_no_weights_and_tables_as_given(spark):
    rows = spark.createDataFrame([(1, ["b", "AA"])], "rid long, skills array<string>")
    texts = strict.strict_texts(rows, "rid", F.col("skills"), {})
    assert texts.first().text == "b aa" and [tuple(r) for r in strict.strict_terms(texts, {}).collect()] == [(1, "aa", 1)]
    rules = spark.createDataFrame([(0, "aa", "zz")], "ord long, synonym string, standard string")
    weights = spark.createDataFrame([("zz", 1.0)], "skill string, weight double")
    texts = strict.strict_texts(rows, "rid", F.col("skills"), rules)
    assert [tuple(r) for r in strict.strict_terms(texts, weights).collect()] == [(1, "zz", 3)]


def test_a_large_dictionary(spark):
    rules = spark.range(30000).select(F.col("id").alias("ord"), F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789",
                                      "abcdefghij")).alias("synonym"), F.lit("same").alias("standard"))
    rows = spark.createDataFrame([(1, ["wbc", "other", "wcjjjj"])], "rid long, skills array<string>")
    assert strict.strict_texts(rows, "rid", F.col("skills"), rules).first().text == "same other same"


def test_strict_mode_scores(spark):
    cands = spark.createDataFrame([(1, "n", "e", None, ["js"], [], "", 0)],
                                  "resume_id long, name string, email string, phone string, skills array<string>, "
                                  "certifications array<string>, degree string, experience_days long")
    jobs = spark.createDataFrame([(7, ["JavaScript"], []), (8, ["bolt"], [])], "job_id long, skills array<string>, certifications array<string>")
    pairs = spark.createDataFrame([(1, 7), (1, 8)], "resume_id long, job_id long")
    vocab = SC.fit_strict_vocabulary(cands, jobs, RULES, WEIGHTS)
    pkg = SC.ModelPackage(-3.0, (6.0,), vocabulary=vocab, synonyms=RULES, skill_weights=WEIGHTS)
    got = {r.job_id: (r.score, r.prediction, r.email, r.phone) for r in SC.screen(pairs, cands, jobs, "strict_skills", pkg).collect()}
    assert got == {7: (1.0, True, "e", None), 8: (0.0, False, "e", None)}
    out = {r.job_id: r for r in SC.report_rows(SC.screen(pairs, cands, jobs, "strict_skills", pkg)).collect()}
    assert out[7].phone == "N/A" and out[7].email == "e" and out[7].score == "100.0%" and out[8].probability.endswith("%")
