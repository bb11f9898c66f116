"""Screening: score (resume, job) pairs in one of four modes, then shape reports.

Pairs come from an applications table (who applied where), never from a cross
product of all resumes and all jobs; every step is an equi-join on the pair's
keys or a per-row expression.

Modes (M16): ``casual_skills`` (M13), ``strict_skills`` (M14),
``casual_full`` and ``strict_full`` (M15). A :class:`ModelPackage` carries what
training stores: logistic coefficients, the fitted vocabulary, the scaler, and
for the strict skills mode the synonym and weight dictionaries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitae.functions import dictionaries as D
from vitae.functions.text import clean, strip_ws, word_share, words
from vitae.operators import features as FT
from vitae.operators import strict, tfidf
from vitae.operators.metrics import rank_within
from vitae.operators.skew import one_row_an_id, split
from vitae.session import materialize, release

MODES = ("casual_skills", "strict_skills", "casual_full", "strict_full")


@dataclass
class ModelPackage:
    """Stored model: ``intercept`` and ``coefficients`` of a logistic model over
    the mode's features (1 for skills modes, 5 for full modes)."""

    intercept: float
    coefficients: tuple[float, ...]
    vocabulary: tfidf.Vocabulary | None = None
    scaler: dict[str, tuple[float, float]] | None = None
    synonyms: dict[str, str] | DataFrame = field(default_factory=dict)
    skill_weights: dict[str, float] | DataFrame = field(default_factory=dict)
    optimal_threshold: float | None = None


def probability(cols: list, package: ModelPackage) -> Column:
    """Logistic probability of class 1 from stored coefficients."""
    z = F.lit(float(package.intercept))
    for c, b in zip(cols, package.coefficients):
        z = z + (F.col(c) if isinstance(c, str) else c) * F.lit(float(b))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def matched(have, need, ignore_case: bool = False) -> Column:
    """Elements of ``have`` present in ``need``, in ``have``'s order."""
    h = F.col(have) if isinstance(have, str) else have
    n = F.col(need) if isinstance(need, str) else need
    if ignore_case:
        nl = F.transform(n, lambda s: F.lower(s))
        return F.filter(h, lambda s: F.array_contains(nl, F.lower(s)))
    return F.filter(h, lambda s: F.array_contains(n, s))


def missing(have, need, ignore_case: bool = False) -> Column:
    """Elements of ``need`` absent from ``have``, in ``need``'s order."""
    h = F.col(have) if isinstance(have, str) else have
    n = F.col(need) if isinstance(need, str) else need
    if ignore_case:
        hl = F.transform(h, lambda s: F.lower(s))
        return F.filter(n, lambda s: ~F.array_contains(hl, F.lower(s)))
    return F.filter(n, lambda s: ~F.array_contains(h, s))


def _coalesce_arr(col):
    return F.coalesce(F.col(col), F.array().cast("array<string>"))


def _with_profiles(pairs: DataFrame, sim: DataFrame, cands: DataFrame, jobs: DataFrame) -> DataFrame:
    """The pairs with their similarity (``lid, rid`` and the values of ``sim``) and both profiles.

    Narrow rows first: the pairs meet their similarity as keys and numbers, then
    the short lists of the job, and the candidate's long ones last, so that
    these cross no further shuffle.
    """
    c = cands.select("resume_id", "name", "email", "phone", F.col("skills").alias("r_skills"),
                     F.col("certifications").alias("r_certs"), "degree", "experience_days")
    j = jobs.select("job_id", F.col("skills").alias("j_skills"), F.col("certifications").alias("j_certs"))
    sim = sim.withColumnsRenamed({"lid": "resume_id", "rid": "job_id"})
    stored = materialize(pairs.join(sim, ["resume_id", "job_id"]), "scored-pairs")
    # a job that very many apply to, or a candidate of very many applications, is split
    dealt, c = split(stored, c, ["resume_id"], "_cpart")
    dealt, j = split(dealt, j, ["job_id"], "_jpart")
    return dealt.join(j, ["job_id", "_jpart"]).join(c, ["resume_id", "_cpart"]).drop("_cpart", "_jpart")


# ------------------------------------------------------------ skills modes ---

def fit_strict_vocabulary(cands: DataFrame, jobs: DataFrame, synonyms, skill_weights) -> tfidf.Vocabulary:
    """Stored vocabulary for the strict skills mode: idf over the distinct strict texts of both sides."""
    tables = [strict.strict_terms(strict.distinct_texts(strict.strict_texts(df, key, F.col("skills"), synonyms)), skill_weights)
              for df, key in ((cands, "resume_id"), (jobs, "job_id"))]
    return tfidf.fit_idf(*[materialize(t, "strict-terms") for t in tables])


def skill_terms(df: DataFrame, id_col: str, package: ModelPackage, mode: str) -> DataFrame:
    """Term table of one side's skill lists in a skills mode."""
    if mode == "casual_skills":
        text = clean(F.array_join(_coalesce_arr("skills"), " "), "delete").alias("t")
        return tfidf.term_table(df.select(id_col, text), id_col, "t", None, dedup=False)
    # strict: non-letters to spaces, synonyms, weights (skills joined by a space)
    return strict.strict_terms(strict.strict_texts(df, id_col, F.col("skills"), package.synonyms), package.skill_weights)


def skills_results(rows: DataFrame, package: ModelPackage, mode: str) -> DataFrame:
    """Result columns of pairs with both profiles and their similarity ``raw`` in a skills mode."""
    out = rows.withColumn("score", F.round("raw", 4))
    # casual predicts from the unrounded score, strict from the rounded one
    prob = probability(["raw" if mode == "casual_skills" else "score"], package)
    return out.select(
        "resume_id", "job_id", F.col("name").alias("file_name"), "email", "phone", "score",
        (prob > 0.5).alias("prediction"), F.round(prob, 6).alias("probability"),
        matched(_coalesce_arr("r_skills"), _coalesce_arr("j_skills")).alias("matched_skills"),
        missing(_coalesce_arr("r_skills"), _coalesce_arr("j_skills")).alias("missing_skills"),
        F.array().cast("array<string>").alias("matched_certifications"),
        F.array().cast("array<string>").alias("missing_certifications"),
        F.lit(mode).alias("model_used"),
        F.lit(0.0).alias("skill_similarity"), F.lit(0.0).alias("education_score"),
        F.lit(0).alias("certification_count"), F.lit(0.0).alias("experience_score"),
        F.lit(0.0).alias("keyword_match"))


def score_skills(pairs: DataFrame, cands: DataFrame, jobs: DataFrame, package: ModelPackage,
                 mode: str = "casual_skills") -> DataFrame:
    """Skills-only modes (M13, M14): TF-IDF cosine of the two skill texts,
    rounded to 4 decimals, logistic probability of that score, class at 0.5,
    matched and missing skills (case-sensitive)."""
    pairs = materialize(pairs.select("resume_id", "job_id"), "pairs")
    tt_r, tt_j = (skill_terms(df, key, package, mode) for df, key in ((cands, "resume_id"), (jobs, "job_id")))
    pp = pairs.select(F.col("resume_id").alias("lid"), F.col("job_id").alias("rid"))
    if mode == "casual_skills" or package.vocabulary is None:
        sim = tfidf.pair_similarity(pp, tt_r, tt_j, digits=None)
    else:
        wr = tfidf.weights(tt_r, package.vocabulary)
        wj = tfidf.weights(tt_j, package.vocabulary)
        sim = tfidf.rowwise_cosine(pp, wr, wj, digits=None)
    sim = sim.withColumnRenamed("score", "raw")
    return skills_results(_with_profiles(pairs, sim, cands, jobs), package, mode)


# -------------------------------------------------------------- full modes ---

def full_skill_text(col) -> Column:
    """Lower-case and strip each skill, join by a space; punctuation kept (H7)."""
    return F.array_join(F.transform(_coalesce_arr(col), lambda s: strip_ws(F.lower(s))), " ")


def fit_full_vocabulary(cands: DataFrame) -> tfidf.Vocabulary:
    """Stored vocabulary for the full modes: idf over candidate skill texts (M2)."""
    return tfidf.fit_idf(full_terms(cands, "resume_id"))


def full_features(pairs: DataFrame, cands: DataFrame, jobs: DataFrame, vocabulary: tfidf.Vocabulary,
                  ladder: dict[str, float] | None = None, whole_word: bool = False) -> DataFrame:
    """Raw (unscaled) five features per pair for the full modes (M5 at serving)."""
    pairs = materialize(pairs.select("resume_id", "job_id"), "pairs")
    wr, wj = (tfidf.weights(full_terms(df, key), vocabulary) for df, key in ((cands, "resume_id"), (jobs, "job_id")))
    pp = pairs.select(F.col("resume_id").alias("lid"), F.col("job_id").alias("rid"))
    sim = tfidf.rowwise_cosine(pp, wr, wj, digits=None).withColumnRenamed("score", "skill_similarity")
    return profile_features(_with_profiles(pairs, sim, cands, jobs), ladder, whole_word)


def full_terms(df: DataFrame, id_col: str) -> DataFrame:
    """Term table of one side's skill lists in the full modes."""
    return tfidf.term_table(df.select(id_col, full_skill_text("skills").alias("t")), id_col, "t", None, dedup=False, tokens="word")


def profile_features(rows: DataFrame, ladder: dict[str, float] | None = None, whole_word: bool = False) -> DataFrame:
    """The five features of pairs with both profiles and their ``skill_similarity``; row by row."""
    return rows.select(
        "resume_id", "job_id", "name", "email", "phone", "r_skills", "j_skills", "r_certs", "j_certs", "skill_similarity",
        *_own_features(ladder, whole_word, "r_certs"),
        F.coalesce(_keyword(full_skill_text("r_skills"), full_skill_text("j_skills")), F.lit(0.0)).alias("keyword_match"))


def _own_features(ladder: dict[str, float] | None = None, whole_word: bool = False, certifications: str = "certifications") -> list[Column]:
    """The features that a candidate has with every job."""
    ladder = ladder if ladder is not None else D.DEGREE_LEVELS_SERVING
    return [(FT.education_level("degree", ladder, whole_word) / float(D.EDUCATION_SCALE)).alias("education_score"),
            FT.certification_score(certifications).alias("certification_count"),
            FT.experience_score(F.col("experience_days") / 365.0).alias("experience_score")]


def unique_profiles(cands: DataFrame, jobs: DataFrame) -> bool:
    """True when every candidate and every job has one row."""
    return one_row_an_id(cands, "resume_id") and one_row_an_id(jobs, "job_id")


def full_pairs(pairs: DataFrame, cands: DataFrame, jobs: DataFrame, vocabulary: tfidf.Vocabulary,
               ladder: dict[str, float] | None = None, whole_word: bool = False) -> DataFrame:
    """``resume_id, job_id`` and the five raw features of distinct pairs, where ids have one row each (M5 at serving).

    What depends on one side alone is worked out once a candidate or job; a pair
    carries keys and numbers. ``with_results`` adds the profiles to those that are kept.
    """
    pairs = materialize(pairs.select(F.col("resume_id").alias("lid"), F.col("job_id").alias("rid")), "pairs")
    release(pairs.sparkSession)
    left = cands.select(F.col("resume_id").alias("lid"), F.array_distinct(words(full_skill_text("skills"))).alias("have"),
                        *_own_features(ladder, whole_word))
    right = jobs.select(F.col("job_id").alias("rid"), F.array_distinct(words(full_skill_text("skills"))).alias("need"))
    left, right = (df.join(tfidf.term_maps(tfidf.weights(full_terms(side, key), vocabulary), i, w).hint("merge"), i, "left")
                   for df, side, key, i, w in ((left, cands, "resume_id", "lid", "lw"), (right, jobs, "job_id", "rid", "rw")))
    return tfidf.pair_rows(pairs, left, right).select(
        F.col("lid").alias("resume_id"), F.col("rid").alias("job_id"), tfidf.map_product("lw", "rw").alias("skill_similarity"),
        "education_score", "certification_count", "experience_score",
        F.coalesce(word_share("have", "need"), F.lit(0.0)).alias("keyword_match"))


def _keyword(rt, jt):
    from vitae.functions.text import keyword_ratio
    return keyword_ratio(rt, jt)


def fit_full_scaler(feats: DataFrame) -> dict[str, tuple[float, float]]:
    row = FT.fit_scaler(feats).first()
    out = {}
    for c in FT.FEATURES:
        std = row[f"{c}__std"]
        out[c] = (row[f"{c}__mean"], 1.0 if not std else std)
    return out


def score_full(feats: DataFrame, package: ModelPackage, mode: str = "strict_full",
               weights=None, threshold: float | None = None, digits: int = 6) -> DataFrame:
    """Full-profile modes (M15): scale features, logistic probability, decision at
    the mode's threshold (``>=``), weighted match score, matched/missing skills
    (case-insensitive) and certifications, features rescaled for display (H26)."""
    if weights is None:
        weights = D.WEIGHTS_STRICT if mode == "strict_full" else D.WEIGHTS_CASUAL
    if threshold is None:
        threshold = D.DECISION_THRESHOLD_STRICT if mode == "strict_full" else D.DECISION_THRESHOLD_CASUAL
    return _full_results(feats.select("*", *_full_score(package, weights, threshold, digits)), mode, digits)


def _full_score(package: ModelPackage, weights, threshold: float, digits: int = 6) -> list[Column]:
    scaled = [((F.col(c) - F.lit(package.scaler[c][0])) / F.lit(package.scaler[c][1])) for c in FT.FEATURES]
    prob = probability(scaled, package)
    return [F.round(FT.match_score(weights), digits).alias("score"), (prob >= F.lit(float(threshold))).alias("prediction"),
            F.round(prob, digits).alias("probability")]


def score_pairs(feats: DataFrame, package: ModelPackage, mode: str = "strict_full", digits: int = 6) -> DataFrame:
    """``full_pairs`` with their score, prediction and probability (M15); no profile."""
    strict_mode = mode == "strict_full"
    return feats.select("*", *_full_score(package, D.WEIGHTS_STRICT if strict_mode else D.WEIGHTS_CASUAL,
                                          D.DECISION_THRESHOLD_STRICT if strict_mode else D.DECISION_THRESHOLD_CASUAL, digits))


#: The features of a pair that do not come back with its candidate.
PAIR_FEATURES = ("skill_similarity", "keyword_match")


def with_results(pairs: DataFrame, cands: DataFrame, jobs: DataFrame, package: ModelPackage, mode: str = "strict_full",
                 also: tuple = ()) -> DataFrame:
    """Result columns of ``score_full``, and those of ``also``, for stored pairs of ``full_pairs``, of which only the keys and
    ``PAIR_FEATURES`` are read: the profiles, with the other features, meet these pairs, and no others."""
    c = cands.select("resume_id", "name", "email", "phone", F.col("skills").alias("r_skills"), F.col("certifications").alias("r_certs"),
                     *_own_features())
    j = jobs.select("job_id", F.col("skills").alias("j_skills"), F.col("certifications").alias("j_certs"))
    rows = tfidf.pair_rows(pairs.select("resume_id", "job_id", *PAIR_FEATURES, *also), c, j, "resume_id", "job_id")
    return _full_results(score_pairs(rows, package, mode), mode, also=also)


def _full_results(rows: DataFrame, mode: str, digits: int = 6, also: tuple = ()) -> DataFrame:
    """Result columns of scored pairs with both profiles."""
    return rows.select(
        "resume_id", "job_id", F.col("name").alias("file_name"), "email", "phone", "score", "prediction", "probability",
        matched(_coalesce_arr("r_skills"), _coalesce_arr("j_skills"), True).alias("matched_skills"),
        missing(_coalesce_arr("r_skills"), _coalesce_arr("j_skills"), True).alias("missing_skills"),
        matched(_coalesce_arr("r_certs"), _coalesce_arr("j_certs")).alias("matched_certifications"),
        missing(_coalesce_arr("r_certs"), _coalesce_arr("j_certs")).alias("missing_certifications"),
        F.lit(mode).alias("model_used"),
        F.round("skill_similarity", digits).alias("skill_similarity"),
        F.round(F.col("education_score") * 5, digits).alias("education_score"),
        (F.col("certification_count") * 10).cast("int").alias("certification_count"),
        F.round(F.col("experience_score") * 20, digits).alias("experience_score"),
        F.round("keyword_match", digits).alias("keyword_match"), *also)


def screen(pairs: DataFrame, cands: DataFrame, jobs: DataFrame, mode: str,
           package: ModelPackage) -> DataFrame:
    """Score every pair in the chosen mode (M16). Unknown modes raise."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; choose one of {MODES}")
    if mode.endswith("_skills"):
        return score_skills(pairs, cands, jobs, package, mode)
    feats = full_features(pairs, cands, jobs, package.vocabulary)
    return score_full(feats, package, mode)


# ----------------------------------------------------------------- reports ---

def rank_results(results: DataFrame, by: str = "job_id") -> DataFrame:
    """Results with their rank per job, best score first, then smallest resume id.

    A distributed range sort: a job with very many applicants spreads over
    several tasks instead of one.
    """
    ranked = rank_within(results, by, F.struct((-F.col("score")).alias("s"), F.col("resume_id")))
    return ranked.withColumn("rank", F.col("rank") + 1)


def top_k(results: DataFrame, k: int = 10, by: str = "job_id") -> DataFrame:
    """Best ``k`` results per job (E7). ``row_number() <= k`` lets Spark keep a
    per-task top-k before the shuffle, so a hot job ships at most k rows per task."""
    w = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col("resume_id"))
    return results.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def filter_results(results: DataFrame, view: str = "all") -> DataFrame:
    """Report filter: ``all``, ``positive`` (predicted match) or ``negative``."""
    if view == "all":
        return results
    if view == "positive":
        return results.where(F.col("prediction"))
    if view == "negative":
        return results.where(~F.col("prediction"))
    raise ValueError(f"unknown view {view!r}")


def report_rows(results: DataFrame) -> DataFrame:
    """Export rows: ``N/A`` for what is missing, Match/No Match, ``x.x%`` scores and
    probabilities, joined lists, long names and addresses truncated to 27 characters + ``...`` (B9, B10)."""
    from vitae.functions.text import truncate_cell
    # rounded as whole tenths of a percent: a score's half is a half only after both factors
    def pct(col):
        return F.format_string("%.1f%%", F.round(F.col(col) * 100 * 10) / 10).alias(col)

    return results.select(
        "resume_id", "job_id",
        truncate_cell(F.coalesce(F.col("file_name"), F.lit("N/A"))).alias("name"),
        truncate_cell(F.coalesce(F.col("email"), F.lit("N/A"))).alias("email"),
        F.coalesce(F.col("phone"), F.lit("N/A")).alias("phone"), pct("score"), pct("probability"),
        F.when(F.col("prediction"), F.lit("Match")).otherwise(F.lit("No Match")).alias("prediction"),
        F.array_join(F.coalesce("matched_skills", F.array().cast("array<string>")), ", ").alias("matched_skills"),
        F.array_join(F.coalesce("missing_skills", F.array().cast("array<string>")), ", ").alias("missing_skills"))


def batch_summary(results: DataFrame) -> DataFrame:
    """Results, predicted matches and the match percentage to one decimal."""
    return results.agg(F.count(F.lit(1)).alias("total"),
                       F.count_if(F.col("prediction")).alias("matches")).select(
        "total", "matches",
        F.when(F.col("total") > 0, F.round(F.col("matches") * 100.0 / F.col("total"), 1))
        .otherwise(F.lit(0.0)).alias("match_percentage"))
