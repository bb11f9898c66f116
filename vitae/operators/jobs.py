"""Job preference documents: simplify and validate (B4, B5, E11), and the
certification normaliser and batch summary of parsed profiles (B13, D8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitae.functions.text import strip_ws

# Validation messages, in the order the rules are tried.
NO_ROLE = "Please select at least one job role."
NO_SKILL = "Please add at least one required skill."
NO_YEARS = "Please specify years of experience or select 'Fresher'."
UNNAMED = "Unnamed Certification"


def simplify_jobs(jobs: DataFrame) -> DataFrame:
    """Skills = distinct(role values ∪ skills), sorted (the reference's set order is arbitrary)."""
    skills = F.array_sort(F.array_distinct(F.concat(
        F.transform(F.coalesce("jobRoles", F.array().cast("array<struct<value:string,label:string>>")),
                    lambda r: r["value"]),
        F.coalesce("skills", F.array().cast("array<string>")))))
    return jobs.select("job_id", skills.alias("skills"), F.col("isFresher").alias("is_fresher"),
                       F.col("yearsExperience").cast("double").alias("years_experience"))


def validate_jobs(jobs: DataFrame) -> Column:
    """First failing rule: no role; no skill; not a fresher and years ≤ 0 or missing."""
    years = F.col("yearsExperience").cast("double")
    return (F.when(F.coalesce(F.size("jobRoles"), F.lit(0)) <= 0, F.lit(NO_ROLE))
            .when(F.coalesce(F.size("skills"), F.lit(0)) <= 0, F.lit(NO_SKILL))
            .when(~F.coalesce(F.col("isFresher"), F.lit(False)) & (years.isNull() | (years <= 0)),
                  F.lit(NO_YEARS)))


def normalise_certifications(profiles: DataFrame, col: str = "certifications") -> DataFrame:
    """Certification names to ``{name, provider, cert_number}`` structs, empty names
    defaulted, plus ``has_certifications`` (B13)."""
    certs = F.transform(F.coalesce(F.col(col), F.array().cast("array<string>")),
                        lambda c: F.struct(F.coalesce(F.nullif(strip_ws(c), F.lit("")), F.lit(UNNAMED)).alias("name"),
                                           F.lit(None).cast("string").alias("provider"),
                                           F.lit(None).cast("string").alias("cert_number")))
    return profiles.withColumn("certifications", certs).withColumn(
        "has_certifications", F.size("certifications") > 0)


def certification_summary(profiles: DataFrame) -> DataFrame:
    """Profiles, profiles with a certification, and their percentage to 1 decimal."""
    return profiles.agg(F.count(F.lit(1)).alias("total_files"),
                        F.count_if(F.col("has_certifications")).alias("total_with_certs")).select(
        "total_files", "total_with_certs",
        F.when(F.col("total_files") > 0,
               F.round(F.col("total_with_certs") * 100.0 / F.col("total_files"), 1))
        .otherwise(F.lit(0.0)).alias("cert_percentage"))
