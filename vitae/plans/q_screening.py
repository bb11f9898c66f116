"""Registered queries: screening applications in the skills and full modes, and reports.

The model package used here is an example with fixed coefficients (the
reference ships no fitted model), so that its SQL form can recompute the same
probabilities; vocabulary and scaler are fitted from the tables as training
would store them.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from vitae.functions import dictionaries as D
from vitae.operators import features as FT
from vitae.operators import screening as SC
from vitae.plans.catalog import register
from vitae.plans.sql import WS, clean
from vitae.plans.sql_views import VIEWS, keyword_sql, sql_str
from vitae.session import materialize, release
from vitae.sources import views as V

# The example model packages (intercept, coefficients).
CASUAL_SKILLS_MODEL = (-3.0, (12.0,))
FULL_STRICT_MODEL = (-1.0, (2.0, 0.5, 0.3, 0.4, 1.5))
FULL_CASUAL_MODEL = (-1.5, (1.6, 0.4, 0.1, 0.5, 2.0))
FULL = {"strict_full": (FULL_STRICT_MODEL, D.WEIGHTS_STRICT, D.DECISION_THRESHOLD_STRICT),
        "casual_full": (FULL_CASUAL_MODEL, D.WEIGHTS_CASUAL, D.DECISION_THRESHOLD_CASUAL)}


def _inputs(spark, sf_dir):
    # stored: vocabulary, term table and pairs all read the candidates
    cands = materialize(V.candidate_profiles(spark, sf_dir), "candidates")
    release(spark)
    return V.applications(spark, sf_dir), cands, V.job_postings(spark, sf_dir)


def _scored(spark, sf_dir, mode="strict_full"):
    """(scored pairs, function that gives results of stored ones); where an id has several rows, results and None."""
    pairs, cands, jobs = _inputs(spark, sf_dir)
    vocab = SC.fit_full_vocabulary(cands)
    unique = SC.unique_profiles(cands, jobs)
    feats = materialize((SC.full_pairs if unique else SC.full_features)(pairs, cands, jobs, vocab), "full_features")
    (b0, coefs), _, _ = FULL[mode]
    pkg = SC.ModelPackage(b0, coefs, vocabulary=vocab, scaler=SC.fit_full_scaler(feats))
    release(spark)
    if not unique:
        return SC.score_full(feats, pkg, mode), None
    return SC.score_pairs(feats, pkg, mode), lambda pairs, also: SC.with_results(pairs, cands, jobs, pkg, mode, also)


def full_results(spark, sf_dir, mode="strict_full", keep=None, also=()):
    """Results of the scored pairs that ``keep(pairs, *columns needed)`` leaves, with the columns ``also`` that it adds;
    only these meet the profiles."""
    scored, results = _scored(spark, sf_dir, mode)
    if results is None:
        return keep(scored, "*") if keep else scored
    kept = scored
    if keep:
        kept = keep(scored, "resume_id", "job_id", "score", *SC.PAIR_FEATURES)
        kept = materialize(kept.select("resume_id", "job_id", *SC.PAIR_FEATURES, *also), "kept-pairs")
        release(spark)
    return results(kept, also)


def _sigmoid_sql(terms: list[str], b0: float, coefs) -> str:
    z = f"{float(b0)}"
    for t, b in zip(terms, coefs):
        z = f"({z} + ({t}) * {float(b)})"
    return f"1.0 / (1.0 + exp(-{z}))"


# ---------------------------------------------------------- casual skills ---

def _casual_sql() -> str:
    b0, coefs = CASUAL_SKILLS_MODEL
    rt = clean("array_to_string(coalesce(c.skills, []), ' ')", "delete")
    jt = clean("array_to_string(coalesce(j.skills_required, []), ' ')", "delete")
    one = f"(1.0 + {math.log(1.5)!r})"
    return f"""WITH {VIEWS},
cs_c AS (SELECT c.resume_id AS id, {rt} AS t FROM cand c),
cs_j AS (SELECT j.job_id AS id, {jt} AS t FROM jobs j),
cs_ctf AS (SELECT id, term, count(*) AS cnt FROM (SELECT id, unnest(regexp_split_to_array(t, '{WS}+')) AS term
           FROM cs_c) s WHERE length(term) >= 2 GROUP BY id, term),
cs_jtf AS (SELECT id, term, count(*) AS cnt FROM (SELECT id, unnest(regexp_split_to_array(t, '{WS}+')) AS term
           FROM cs_j) s WHERE length(term) >= 2 GROUP BY id, term),
cs_l AS (SELECT a.resume_id, a.job_id, t.term, t.cnt FROM apps a JOIN cs_ctf t ON t.id = a.resume_id),
cs_r AS (SELECT a.resume_id, a.job_id, t.term, t.cnt FROM apps a JOIN cs_jtf t ON t.id = a.job_id),
cs_b AS (SELECT coalesce(l.resume_id, r.resume_id) AS resume_id, coalesce(l.job_id, r.job_id) AS job_id,
                l.cnt AS lc, r.cnt AS rc
         FROM cs_l l FULL OUTER JOIN cs_r r
           ON l.resume_id = r.resume_id AND l.job_id = r.job_id AND l.term = r.term),
cs_w AS (SELECT resume_id, job_id,
                coalesce(lc, 0) * CASE WHEN lc IS NOT NULL AND rc IS NOT NULL THEN CAST(1.0 AS DOUBLE) ELSE CAST({one} AS DOUBLE) END AS lw,
                coalesce(rc, 0) * CASE WHEN lc IS NOT NULL AND rc IS NOT NULL THEN CAST(1.0 AS DOUBLE) ELSE CAST({one} AS DOUBLE) END AS rw
         FROM cs_b),
cs_s AS (SELECT resume_id, job_id, sum(lw * rw) AS dot, sum(lw * lw) AS ll, sum(rw * rw) AS rr
         FROM cs_w GROUP BY resume_id, job_id),
cs_sc AS (SELECT a.resume_id, a.job_id,
                 CASE WHEN s.ll > 0 AND s.rr > 0 THEN s.dot / (sqrt(s.ll) * sqrt(s.rr)) ELSE 0.0 END AS raw
          FROM apps a LEFT JOIN cs_s s ON s.resume_id = a.resume_id AND s.job_id = a.job_id),
cs_p AS (SELECT x.resume_id, x.job_id, c.name, c.email, c.phone, coalesce(c.skills, []) AS rs, coalesce(j.skills_required, []) AS js,
                round(coalesce(x.raw, 0.0), 4) AS score, {_sigmoid_sql(['coalesce(x.raw, 0.0)'], b0, coefs)} AS prob
         FROM cs_sc x JOIN cand c ON c.resume_id = x.resume_id JOIN jobs j ON j.job_id = x.job_id)
SELECT resume_id, job_id, name AS file_name, email, phone, score, prob > 0.5 AS prediction, round(prob, 6) AS probability,
       list_filter(rs, lambda s: list_contains(js, s)) AS matched_skills,
       list_filter(js, lambda s: NOT list_contains(rs, s)) AS missing_skills,
       CAST([] AS VARCHAR[]) AS matched_certifications, CAST([] AS VARCHAR[]) AS missing_certifications,
       'casual_skills' AS model_used, 0.0 AS skill_similarity, 0.0 AS education_score,
       0 AS certification_count, 0.0 AS experience_score, 0.0 AS keyword_match
FROM cs_p"""


@register("screen_casual_skills", _casual_sql())
def screen_casual_skills(spark, sf_dir):
    """Casual skills screening of every application."""
    pairs, cands, jobs = _inputs(spark, sf_dir)
    b0, coefs = CASUAL_SKILLS_MODEL
    return SC.screen(pairs, cands, jobs.select("job_id", "skills", "certifications"),
                     "casual_skills", SC.ModelPackage(b0, coefs))


# ---------------------------------------------------------- strict skills ---

# The example strict package (rules in order, weights, intercept, coefficient).
STRICT_SYNONYMS = {"hot": "heated", "cold": "cooled-metal", "gizmo": "gadget", "heated": "heated-metal",
                   "gadget": "smart-gadget", "old": "used", "metal": "alloy"}
STRICT_WEIGHTS = {"heated-alloy": 2.0, "smart-gadget": 1.5, "bolt": 1.7, "gear": 2.6, "blue bolt": 1.0, "alloy": 0.6,
                  "red": 0.4, "used": 1.2}
STRICT_SKILLS_MODEL = (-2.5, (9.0,))


def _strict_text_sql(skills: str) -> str:
    """The reference's order of steps on whole texts: every rule in turn, then the repeats appended."""
    text = clean(f"array_to_string(coalesce({skills}, []), ' ')", "space")
    for synonym, standard in STRICT_SYNONYMS.items():
        text = f"regexp_replace({text}, '\\b{synonym}\\b', '{standard}', 'g')"
    return text


def _strict_ctes() -> str:
    def terms(side: str, key: str, source: str, skills: str) -> str:
        boost = " || ".join(f"CASE WHEN regexp_matches(t, '\\b{s}\\b') THEN repeat(' {s}', {int(w * 2)}) ELSE '' END"
                            for s, w in STRICT_WEIGHTS.items())
        return f"""
st_{side}0 AS (SELECT {key} AS id, {_strict_text_sql(skills)} AS t FROM {source}),
st_{side} AS (SELECT id, t || {boost} AS t FROM st_{side}0),
st_{side}tf AS (SELECT id, term, count(*) AS cnt FROM (SELECT id, unnest(regexp_extract_all(t, '\\w+')) AS term FROM st_{side}) s
             WHERE length(term) >= 2 GROUP BY id, term),
st_{side}d AS (SELECT min(id) AS id FROM st_{side} GROUP BY t)"""

    b0, coefs = STRICT_SKILLS_MODEL
    return f"""{VIEWS},{terms('c', 'resume_id', 'cand', 'skills')},{terms('j', 'job_id', 'jobs', 'skills_required')},
st_n AS (SELECT CAST((SELECT count(*) FROM st_cd) + (SELECT count(*) FROM st_jd) AS DOUBLE) AS n),
st_vocab AS (SELECT term, ln((1 + (SELECT n FROM st_n)) / (count(*) + 1.0)) + 1 AS idf FROM (
    SELECT term FROM st_ctf JOIN st_cd USING (id) UNION ALL SELECT term FROM st_jtf JOIN st_jd USING (id)) u GROUP BY term),
st_cw0 AS (SELECT id, term, cnt * idf AS w FROM st_ctf JOIN st_vocab USING (term)),
st_cw AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM st_cw0),
st_jw0 AS (SELECT id, term, cnt * idf AS w FROM st_jtf JOIN st_vocab USING (term)),
st_jw AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM st_jw0),
st_dot AS (SELECT a.resume_id, a.job_id, sum(r.w * j.w) AS dot FROM apps a
           JOIN st_cw r ON r.id = a.resume_id JOIN st_jw j ON j.id = a.job_id AND j.term = r.term
           GROUP BY a.resume_id, a.job_id),
st_p AS (SELECT a.resume_id, a.job_id, c.name, c.email, c.phone, coalesce(c.skills, []) AS rs,
                coalesce(j.skills_required, []) AS js, round(coalesce(d.dot, 0.0), 4) AS score
         FROM apps a JOIN cand c ON c.resume_id = a.resume_id JOIN jobs j ON j.job_id = a.job_id
         LEFT JOIN st_dot d ON d.resume_id = a.resume_id AND d.job_id = a.job_id),
st_q AS (SELECT *, {_sigmoid_sql(['score'], b0, coefs)} AS prob FROM st_p)"""


@register("screen_strict_skills", f"""WITH {_strict_ctes()}
SELECT resume_id, job_id, name AS file_name, email, phone, score, prob > 0.5 AS prediction, round(prob, 6) AS probability,
       list_filter(rs, lambda s: list_contains(js, s)) AS matched_skills,
       list_filter(js, lambda s: NOT list_contains(rs, s)) AS missing_skills,
       CAST([] AS VARCHAR[]) AS matched_certifications, CAST([] AS VARCHAR[]) AS missing_certifications,
       'strict_skills' AS model_used, 0.0 AS skill_similarity, 0.0 AS education_score,
       0 AS certification_count, 0.0 AS experience_score, 0.0 AS keyword_match FROM st_q""")
def screen_strict_skills(spark, sf_dir):
    """Strict skills screening of every application."""
    pairs, cands, jobs = _inputs(spark, sf_dir)
    b0, coefs = STRICT_SKILLS_MODEL
    vocab = SC.fit_strict_vocabulary(cands, jobs, STRICT_SYNONYMS, STRICT_WEIGHTS)
    return SC.screen(pairs, cands, jobs, "strict_skills", SC.ModelPackage(
        b0, coefs, vocabulary=vocab, synonyms=STRICT_SYNONYMS, skill_weights=STRICT_WEIGHTS))


# ------------------------------------------------------------- full modes ---

def _full_ctes(mode: str = "strict_full") -> str:
    (b0, coefs), weights, threshold = FULL[mode]
    w = [float(x) for x in weights]
    lower_strip = "lambda x: regexp_replace(lower(x), '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g')"
    edu_vals = ", ".join(f"({sql_str(t)}, {float(l)})" for t, l in D.DEGREE_LEVELS_SERVING.items())
    feats = FT.FEATURES
    scaled = [f"(r.{c} - st.{c}_m) / st.{c}_s" for c in feats]
    stats = ", ".join(f"avg({c}) AS {c}_m, CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1.0 "
                      f"ELSE stddev_pop({c}) END AS {c}_s" for c in feats)
    return f"""{VIEWS},
fs_c AS (SELECT resume_id AS id, name, email, phone, skills AS r_skills, certifications AS r_certs, degree, experience_days,
                array_to_string(list_transform(coalesce(skills, []), {lower_strip}), ' ') AS t FROM cand),
fs_j AS (SELECT job_id AS id, skills_required AS j_skills, job_certifications AS j_certs,
                array_to_string(list_transform(coalesce(skills_required, []), {lower_strip}), ' ') AS t FROM jobs),
fs_ctf AS (SELECT id, term, count(*) AS cnt FROM (SELECT id, unnest(regexp_extract_all(t, '\\w+')) AS term
           FROM fs_c) s WHERE length(term) >= 2 GROUP BY id, term),
fs_jtf AS (SELECT id, term, count(*) AS cnt FROM (SELECT id, unnest(regexp_extract_all(t, '\\w+')) AS term
           FROM fs_j) s WHERE length(term) >= 2 GROUP BY id, term),
fs_vocab AS (SELECT term, ln((1 + (SELECT CAST(count(*) AS DOUBLE) FROM fs_c)) / (count(*) + 1.0)) + 1 AS idf
             FROM fs_ctf GROUP BY term),
fs_cw0 AS (SELECT id, term, cnt * idf AS w FROM fs_ctf JOIN fs_vocab USING (term)),
fs_cw AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM fs_cw0),
fs_jw0 AS (SELECT id, term, cnt * idf AS w FROM fs_jtf JOIN fs_vocab USING (term)),
fs_jw AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM fs_jw0),
fs_dot AS (SELECT a.resume_id, a.job_id, sum(r.w * j.w) AS dot FROM apps a
           JOIN fs_cw r ON r.id = a.resume_id JOIN fs_jw j ON j.id = a.job_id AND j.term = r.term
           GROUP BY a.resume_id, a.job_id),
fs_raw AS (
  SELECT a.resume_id, a.job_id, c.name, c.email, c.phone, c.r_skills, j.j_skills, c.r_certs, j.j_certs,
         coalesce(d.dot, 0.0) AS skill_similarity,
         coalesce((SELECT max(level) FROM (VALUES {edu_vals}) l(term, level)
                   WHERE contains(lower(c.degree), l.term)), 0.0) / 5.0 AS education_score,
         coalesce(len(c.r_certs), 0) / 10.0 AS certification_count,
         least(c.experience_days / 365.0, 20.0) / 20.0 AS experience_score,
         coalesce({keyword_sql('c.t', 'j.t')}, 0.0) AS keyword_match
  FROM apps a JOIN fs_c c ON c.id = a.resume_id JOIN fs_j j ON j.id = a.job_id
  LEFT JOIN fs_dot d ON d.resume_id = a.resume_id AND d.job_id = a.job_id),
fs_st AS (SELECT {stats} FROM fs_raw),
fs_out AS (
  SELECT r.*, {_sigmoid_sql(scaled, b0, coefs)} AS prob,
         r.skill_similarity * {w[0]} + r.education_score * {w[1]} + r.certification_count * {w[2]}
           + r.experience_score * {w[3]} + r.keyword_match * {w[4]} AS score
  FROM fs_raw r, fs_st st),
results AS (
  SELECT resume_id, job_id, name AS file_name, email, phone, round(score, 6) AS score,
         prob >= {threshold} AS prediction, round(prob, 6) AS probability,
         list_filter(coalesce(r_skills, []), lambda s: list_contains(
             list_transform(coalesce(j_skills, []), lambda x: lower(x)), lower(s))) AS matched_skills,
         list_filter(coalesce(j_skills, []), lambda s: NOT list_contains(
             list_transform(coalesce(r_skills, []), lambda x: lower(x)), lower(s))) AS missing_skills,
         list_filter(coalesce(r_certs, []), lambda s: list_contains(coalesce(j_certs, []), s)) AS matched_certifications,
         list_filter(coalesce(j_certs, []), lambda s: NOT list_contains(coalesce(r_certs, []), s))
           AS missing_certifications,
         '{mode}' AS model_used, round(skill_similarity, 6) AS skill_similarity,
         round(education_score * 5, 6) AS education_score,
         CAST(trunc(certification_count * 10) AS INTEGER) AS certification_count,
         round(experience_score * 20, 6) AS experience_score, round(keyword_match, 6) AS keyword_match
  FROM fs_out)"""


@register("screen_full_strict", f"WITH {_full_ctes()}\nSELECT * FROM results")
def screen_full_strict(spark, sf_dir):
    """Full-profile strict screening of every application (M15, M16, M4, M6, M10, B8, B12,
    H7, H21–H24, H26, C6 substring, C7, C8, D7, D25)."""
    return full_results(spark, sf_dir)


@register("screen_casual_full", f"WITH {_full_ctes('casual_full')}\nSELECT * FROM results")
def screen_casual_full(spark, sf_dir):
    """Full-profile casual screening of every application."""
    return full_results(spark, sf_dir, "casual_full")


@register("screen_ranked", f"""WITH {_full_ctes()}
SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, resume_id) AS rank FROM results""")
def screen_ranked(spark, sf_dir):
    """Every applicant with the rank among those of the job."""
    return full_results(spark, sf_dir, keep=lambda scored, *cols: SC.rank_results(scored.select(*cols)), also=("rank",))


@register("screen_top10", f"""WITH {_full_ctes()}
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, resume_id) AS rank
               FROM results) x WHERE rank <= 10""")
def screen_top10(spark, sf_dir):
    """Best 10 applicants per job."""
    return full_results(spark, sf_dir, keep=lambda scored, *cols: SC.top_k(scored.select(*cols), 10).withColumn("rank", F.col("rank").cast("long")),
                        also=("rank",))


@register("screen_report", f"""WITH {_full_ctes()}
SELECT resume_id, job_id,
       CASE WHEN length(coalesce(file_name, 'N/A')) > 30 THEN substr(coalesce(file_name, 'N/A'), 1, 27) || '...'
            ELSE coalesce(file_name, 'N/A') END AS name,
       CASE WHEN length(coalesce(email, 'N/A')) > 30 THEN substr(coalesce(email, 'N/A'), 1, 27) || '...'
            ELSE coalesce(email, 'N/A') END AS email, coalesce(phone, 'N/A') AS phone,
       printf('%.1f%%', round(score * 100, 1)) AS score,
       printf('%.1f%%', round(probability * 100, 1)) AS probability,
       CASE WHEN prediction THEN 'Match' ELSE 'No Match' END AS prediction,
       array_to_string(matched_skills, ', ') AS matched_skills,
       array_to_string(missing_skills, ', ') AS missing_skills
FROM results WHERE prediction""")
def screen_report(spark, sf_dir):
    """Export rows of the positive view."""
    return SC.report_rows(full_results(spark, sf_dir, keep=lambda scored, *cols: SC.filter_results(scored, "positive")))


@register("screen_summary", f"""WITH {_full_ctes()}
SELECT count(*) AS total, count(*) FILTER (WHERE prediction) AS matches,
       CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE prediction) * 100.0 / count(*), 1)
            ELSE 0.0 END AS match_percentage FROM results""")
def screen_summary(spark, sf_dir):
    """Batch summary of a screening run."""
    return SC.batch_summary(_scored(spark, sf_dir)[0])
