"""Structured match features, match scores and standardisation.

Features per (resume, job) row:

* ``skill_similarity`` — TF-IDF cosine of the resume's skill text and the job's,
  vocabulary fitted on the resume side of the rows (M2), computed only for the
  given pairs (C2).
* ``education_score`` — highest degree level found in the degree text / 5 (C6, H22).
* ``certification_count`` — number of certifications / 10, not capped (D25, H23).
* ``experience_score`` — min(years, 20) / 20 (H20, H21).
* ``keyword_match`` — share of the job's distinct words present in the resume's (D7).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitae.functions import dictionaries as D
from vitae.functions.text import clean, keyword_ratio, strip_ws, word_share, words
from vitae.operators import tfidf
from vitae.session import materialize

FEATURES = ["skill_similarity", "education_score", "certification_count",
            "experience_score", "keyword_match"]


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def skills_text(col, mode: str | None = "collapse") -> Column:
    """List of skills → one text: lower + strip each item, join by a space, clean."""
    joined = F.array_join(F.transform(_c(col), lambda s: strip_ws(F.lower(s))), " ")
    return clean(joined, mode) if mode else joined


def rx_escape(term: str) -> str:
    """Escape regex metacharacters (portable across regex engines)."""
    return "".join("\\" + ch if ch in r"\.^$*+?()[]{}|" else ch for ch in term)


def level_patterns(ladder: dict[str, float], whole_word: bool = True) -> list[tuple[float, str]]:
    """One alternation per level, highest first: ``\\b(?:t1|t2|...)\\b``."""
    by_level: dict[float, list[str]] = {}
    for term, level in ladder.items():
        by_level.setdefault(float(level), []).append(rx_escape(term))
    out = []
    for level in sorted(by_level, reverse=True):
        alt = "|".join(sorted(by_level[level], key=len, reverse=True))
        out.append((level, rf"\b(?:{alt})\b" if whole_word else f"(?:{alt})"))
    return out


def education_level(col, ladder: dict[str, float] | None = None, whole_word: bool = True) -> Column:
    """Highest level of any ladder term in the text (0 when none or NULL).

    The ladder is a bounded parameter, compiled into one pattern per level, so
    no join is needed: each row runs a handful of regex searches over a short
    string, inside generated code.
    """
    ladder = ladder if ladder is not None else D.DEGREE_LEVELS_TRAINING
    text = strip_ws(F.lower(_c(col)))
    levels = [F.when(text.rlike(p), F.lit(lv)) for lv, p in level_patterns(ladder, whole_word)]
    return F.coalesce(F.greatest(*levels, F.lit(0.0)) if len(levels) > 1 else levels[0], F.lit(0.0))


def experience_years(starts, ends, formats: list[str] | None = None) -> Column:
    """Σ whole days (end − start) / 365 over zipped date lists; unparsable pairs add 0.

    Negative spans are kept (not clamped), as in the reference.
    """
    fmts = formats or ["yyyy-MM-dd"]

    def parse(s):
        return F.coalesce(*[F.try_to_date(s, f) for f in fmts]) if len(fmts) > 1 \
            else F.try_to_date(s, fmts[0])

    zipped = F.arrays_zip(_c(starts).alias("s"), _c(ends).alias("e"))
    days = F.aggregate(zipped, F.lit(0).cast("long"),
                       lambda acc, x: acc + F.coalesce(F.datediff(parse(x["e"]), parse(x["s"])), F.lit(0)))
    return F.coalesce(days, F.lit(0)).cast("double") / 365.0


def experience_score(years) -> Column:
    return F.least(_c(years), F.lit(float(D.EXPERIENCE_CAP_YEARS))) / float(D.EXPERIENCE_CAP_YEARS)


def certification_score(col) -> Column:
    return F.coalesce(F.size(_c(col)), F.lit(0)).cast("double") / float(D.CERTIFICATION_SCALE)


def match_score(weights=D.WEIGHTS_CASUAL, cols=FEATURES) -> Column:
    """Weighted sum of the five features, evaluated left to right."""
    expr = None
    for c, w in zip(cols, weights):
        term = F.col(c) * F.lit(float(w))
        expr = term if expr is None else expr + term
    return expr


def _texts(rows: DataFrame, key: str, items: str, clean_mode: str | None) -> tuple[DataFrame, bool]:
    """``(id, t, rows)``: each id's text and number of rows; and whether no id has several lists."""
    lists = rows.groupBy(F.col(key).alias("id"), items).agg(F.count(F.lit(1)).alias("rows"))
    found = materialize(lists.groupBy("id").agg(F.first(items).alias(items), F.sum("rows").alias("rows"),
                                                F.count(F.lit(1)).alias("lists"))
                        .select("id", skills_text(items, clean_mode).alias("t"), "rows", "lists"), "texts")
    return found.drop("lists"), (found.agg(F.max("lists")).first()[0] or 1) == 1


def pair_features(pairs: DataFrame, cands: DataFrame, jobs: DataFrame, *, ladder: dict[str, float] | None = None,
                  whole_word: bool = True, clean_mode: str | None = "collapse", weights=D.WEIGHTS_CASUAL,
                  label_threshold: float = D.LABEL_THRESHOLD_FULL, digits: int | None = 6) -> DataFrame:
    """``match_features`` of stored distinct pairs whose candidates (``resume_id, skills, ...``) and jobs
    (``job_id, skills_required``) have one row each.

    What depends on one side alone is worked out once a candidate or job, and a
    pair meets each side once, where all of its features are worked out.
    """
    c = materialize(cands.select(
        F.col("resume_id").alias("id"), skills_text("skills", clean_mode).alias("t"),
        (education_level("degree", ladder, whole_word) / float(D.EDUCATION_SCALE)).alias("education_score"),
        certification_score("certifications").alias("certification_count"),
        experience_score(F.col("experience_days") / 365.0).alias("experience_score")), "texts")
    j = jobs.select(F.col("job_id").alias("id"), skills_text("skills_required", clean_mode).alias("t"))
    tt_r = materialize(tfidf.term_table(c, "id", "t", None, dedup=False), "terms_r")
    tt_j = tfidf.term_table(j, "id", "t", None, dedup=False)
    rows = pairs.groupBy(F.col("resume_id").alias("id")).agg(F.count(F.lit(1)).alias("weight"))
    vocab = tfidf.fit_idf_weighted(tt_r, rows, materialize_result=True)
    left, right = (
        df.withColumn(have, F.array_distinct(words("t"))).drop("t").withColumnRenamed("id", key)
        .join(tfidf.term_maps(tfidf.weights(tt, vocab), key, w).hint("merge"), key, "left")
        for df, tt, key, have, w in ((c, tt_r, "resume_id", "have", "lw"), (j, tt_j, "job_id", "need", "rw")))
    feats = tfidf.pair_rows(pairs, left, right, "resume_id", "job_id").select(
        "resume_id", "job_id", tfidf.map_product("lw", "rw").alias("skill_similarity"), "education_score", "certification_count",
        "experience_score", F.coalesce(word_share("have", "need"), F.lit(0.0)).alias("keyword_match"))
    return _scored(feats, weights, label_threshold, digits)


def match_features(rows: DataFrame, *, ladder: dict[str, float] | None = None,
                   whole_word: bool = True, clean_mode: str | None = "collapse",
                   weights=D.WEIGHTS_CASUAL, label_threshold: float = D.LABEL_THRESHOLD_FULL,
                   digits: int = 6) -> DataFrame:
    """Five features, match score and label per (resume_id, job_id) row.

    ``rows`` carries ``resume_id, job_id, skills, skills_required, certifications,
    degree, experience_days``. The skill vocabulary is fitted on the resume side
    with each row counted once (as when the rows are the fitting corpus).
    """
    rows = rows.select("resume_id", "job_id", "skills", "skills_required", "certifications",
                       "degree", "experience_days")
    # one text per candidate and per job: a list is cleaned once, however many rows carry it
    cands, one_r = _texts(rows, "resume_id", "skills", clean_mode)
    jobs, one_j = _texts(rows, "job_id", "skills_required", clean_mode)
    tt_r = materialize(tfidf.term_table(cands, "id", "t", None, dedup=False), "terms_r")
    tt_j = tfidf.term_table(jobs, "id", "t", None, dedup=False)
    vocab = tfidf.fit_idf_weighted(tt_r, cands.select("id", F.col("rows").alias("weight")), materialize_result=True)
    w_r = tfidf.weights(tt_r, vocab)
    w_j = tfidf.weights(tt_j, vocab)
    pairs = rows.select(F.col("resume_id").alias("lid"), F.col("job_id").alias("rid"))
    own_words = [t.select("id", F.array_distinct(words("t")).alias("words")) for t in (cands, jobs)]
    # an id with several lists has its rows' words compared row by row
    by_id = one_r and one_j
    sim = tfidf.rowwise_cosine(pairs, w_r, w_j, digits=None, words=own_words if by_id else None).withColumnsRenamed(
        {"lid": "resume_id", "rid": "job_id", "score": "skill_similarity", "keywords": "keyword_match"})
    own = rows.select(
        "resume_id", "job_id",
        (education_level("degree", ladder, whole_word) / float(D.EDUCATION_SCALE)).alias("education_score"),
        certification_score("certifications").alias("certification_count"),
        experience_score(F.col("experience_days") / 365.0).alias("experience_score"),
        *([] if by_id else [F.coalesce(keyword_ratio(skills_text("skills", clean_mode), skills_text("skills_required", clean_mode)),
                                       F.lit(0.0)).alias("keyword_match")]))
    return _scored(own.join(sim, ["resume_id", "job_id"]).select("resume_id", "job_id", *FEATURES), weights, label_threshold, digits)


def _scored(feats: DataFrame, weights, label_threshold: float, digits: int | None) -> DataFrame:
    """The features with their match score and label (H24, B7), rounded."""
    feats = feats.withColumn("match_score", match_score(weights))
    feats = feats.withColumn("label", (F.col("match_score") > F.lit(label_threshold)).cast("int"))
    if digits is not None:
        feats = feats.select("resume_id", "job_id",
                             *[F.round(c, digits).alias(c) for c in FEATURES + ["match_score"]],
                             "label")
    return feats


def fit_scaler(df: DataFrame, cols=FEATURES) -> DataFrame:
    """One row of means and population standard deviations (0 → divisor 1) (M6)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return df.agg(*aggs)


def apply_scaler(df: DataFrame, scaler_row, cols=FEATURES, keep=("resume_id", "job_id")) -> DataFrame:
    """Standardise with a fitted scaler row (a ``Row`` collected from ``fit_scaler``)."""
    out = [F.col(k) for k in keep if k in df.columns]
    for c in cols:
        mean = scaler_row[f"{c}__mean"]
        std = scaler_row[f"{c}__std"]
        std = 1.0 if (std is None or std == 0) else std
        out.append(((F.col(c) - F.lit(mean)) / F.lit(std)).alias(c))
    return df.select(*out, *[c for c in df.columns if c not in cols and c not in keep])
