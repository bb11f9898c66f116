"""Registered queries: job preference documents and certification summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitae.functions.text import role_slug
from vitae.operators import jobs as J
from vitae.plans import sql as S
from vitae.plans.catalog import register
from vitae.plans.sql_views import VIEWS, sql_str
from vitae.sources import views as V
from vitae.sources.tables import table


def job_preferences(spark, sf_dir):
    """Job preference documents derived from parts: one role from the part type
    (none when the size is a multiple of 7), the name's words as skills (none
    when the size is a multiple of 11), fresher when the size is below 10, and
    ``size mod 5`` years of experience."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size")
    role = F.struct(role_slug("p_type").alias("value"), F.col("p_type").alias("label"))
    return p.select(
        F.col("p_partkey").alias("job_id"),
        F.when(F.col("p_size") % 7 == 0, F.array().cast("array<struct<value:string,label:string>>"))
        .otherwise(F.array(role)).alias("jobRoles"),
        F.when(F.col("p_size") % 11 == 0, F.array().cast("array<string>"))
        .otherwise(F.split("p_name", " ")).alias("skills"),
        (F.col("p_size") < 10).alias("isFresher"),
        (F.col("p_size") % 5).cast("double").alias("yearsExperience"))


_PREFS_SQL = f"""prefs AS (
  SELECT p_partkey AS job_id,
         CASE WHEN p_size % 7 = 0 THEN [] ELSE
           [regexp_replace(lower({S.strip_ws('p_type')}), '{S.WS}+', '-', 'g')] END AS role_values,
         CASE WHEN p_size % 11 = 0 THEN [] ELSE string_split(p_name, ' ') END AS skills,
         p_size < 10 AS is_fresher, CAST(p_size % 5 AS DOUBLE) AS years_experience
  FROM part)"""


@register("job_simplify", f"""WITH {_PREFS_SQL}
SELECT job_id, list_sort(list_distinct(list_concat(role_values, skills))) AS skills, is_fresher, years_experience
FROM prefs""")
def job_simplify(spark, sf_dir):
    """Simplified jobs: role values and skills merged, distinct."""
    return J.simplify_jobs(job_preferences(spark, sf_dir))


@register("job_validate", f"""WITH {_PREFS_SQL}
SELECT job_id, CASE WHEN len(role_values) = 0 THEN {sql_str(J.NO_ROLE)}
                    WHEN len(skills) = 0 THEN {sql_str(J.NO_SKILL)}
                    WHEN NOT is_fresher AND (years_experience IS NULL OR years_experience <= 0)
                      THEN {sql_str(J.NO_YEARS)} END AS error
FROM prefs""")
def job_validate(spark, sf_dir):
    """First failing validation rule per job document."""
    prefs = job_preferences(spark, sf_dir)
    return prefs.select("job_id", J.validate_jobs(prefs).alias("error"))


@register("certification_flags", f"""WITH {VIEWS}
SELECT resume_id, list_transform(coalesce(certifications, []), lambda c: coalesce(nullif({S.strip_ws('c')}, ''),
         {sql_str(J.UNNAMED)})) AS cert_names,
       len(coalesce(certifications, [])) > 0 AS has_certifications FROM cand""")
def certification_flags(spark, sf_dir):
    """Certifications normalised to records, with the has-certifications flag."""
    prof = J.normalise_certifications(V.candidate_profiles(spark, sf_dir))
    return prof.select("resume_id", F.transform("certifications", lambda c: c["name"]).alias("cert_names"),
                       "has_certifications")


@register("certification_summary", f"""WITH {VIEWS}
SELECT count(*) AS total_files, count(*) FILTER (WHERE len(coalesce(certifications, [])) > 0) AS total_with_certs,
       CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE len(coalesce(certifications, [])) > 0)
            * 100.0 / count(*), 1) ELSE 0.0 END AS cert_percentage FROM cand""")
def certification_summary(spark, sf_dir):
    """Profiles, profiles with certifications, percentage."""
    return J.certification_summary(J.normalise_certifications(V.candidate_profiles(spark, sf_dir)))
