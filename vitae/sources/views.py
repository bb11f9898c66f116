"""Structured profiles derived from the order tables, built at query time.

* ``candidate_profiles``: one row per customer — e-mail and phone as in the resume
  text, skills (words of part names that stand on at least a fifth of the lines
  of all the customer's orders; with ``whole_skills``, as ``match_features`` and
  ``feature_describe`` have it, on any of them), earned certifications (distinct brands of small parts, ``p_size < 10``, in all
  orders), a degree from the market segment, and total days of finished work
  (per order with status ``F``: last shipment minus order date).
* ``job_postings``: one row per part — required skills are the words of its name,
  the required certification its brand.
* ``applications``: every (customer, part) pair that appears in an order line;
  the pairs to screen, so no resume is ever crossed with every job.
* ``resume_documents``: one sectioned resume text per order (bounded: the lines
  of one order), for the extraction operators.

All groupings are bounded: sets of part-name words and brands are limited by
their vocabularies, sums are partial aggregates, and a document holds one
order's lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitae.session import materialize, release
from vitae.sources.tables import table

# Market segment -> degree text.
SEGMENT_DEGREES = {
    "BUILDING": "Bachelor of Science",
    "MACHINERY": "Master of Arts",
    "HOUSEHOLD": "High School",
    "FURNITURE": "Associate Degree",
}

# Fixed value: a word is a skill if one in so many of a customer's order lines names it.
SKILL_LINES = 5


def _degree(col) -> F.Column:
    expr = F.lit("")
    for seg, deg in reversed(list(SEGMENT_DEGREES.items())):
        expr = F.when(col == seg, F.lit(deg)).otherwise(expr)
    return expr


def _email(name: str) -> F.Column:
    return F.concat(F.lower(F.regexp_replace(name, "#", ".")), F.lit("@example.com"))


def _phone(key: str) -> F.Column:
    return F.concat(F.lit("555-"), F.lpad((F.col(key) % 1000).cast("string"), 3, "0"), F.lit("-"),
                    F.lpad((F.col(key) % 10000).cast("string"), 4, "0"))


def candidate_profiles(spark: SparkSession, sf_dir: str, whole_skills: bool = False) -> DataFrame:
    """One row per customer; with ``whole_skills`` every word of the customer's lines is a skill."""
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_shipdate")
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size")

    lines = (orders.join(li, F.col("l_orderkey") == F.col("o_orderkey"))
             .join(part, F.col("l_partkey") == F.col("p_partkey")))
    # counts per customer and word, then per customer: both partial sums; a word is counted once a line
    n_lines = lines.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    words = (lines.select("o_custkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("w"))
             .groupBy("o_custkey", "w").agg(F.count(F.lit(1)).alias("c")))
    if not whole_skills:
        words = words.join(n_lines, "o_custkey").where(F.col("c") * SKILL_LINES >= F.col("n"))
    skills = words.groupBy("o_custkey").agg(F.array_sort(F.collect_list("w")).alias("skills"))
    certs = (lines.where(F.col("p_size") < 10)
             .groupBy("o_custkey").agg(F.array_sort(F.collect_set("p_brand")).alias("certifications")))
    finished = (orders.where(F.col("o_orderstatus") == "F")
                .join(li, F.col("l_orderkey") == F.col("o_orderkey"))
                .groupBy("o_orderkey", "o_custkey", "o_orderdate")
                .agg(F.max("l_shipdate").alias("last_ship"))
                .groupBy("o_custkey")
                .agg(F.sum(F.datediff(F.to_date("last_ship"), F.to_date("o_orderdate")))
                     .cast("long").alias("experience_days"),
                     F.count(F.lit(1)).alias("n_jobs")))
    return (cust.join(skills, F.col("c_custkey") == skills.o_custkey, "left").drop("o_custkey")
            .join(certs, F.col("c_custkey") == certs.o_custkey, "left").drop("o_custkey")
            .join(finished, F.col("c_custkey") == finished.o_custkey, "left").drop("o_custkey")
            .select(F.col("c_custkey").alias("resume_id"), F.col("c_name").alias("name"),
                    _email("c_name").alias("email"), _phone("c_custkey").alias("phone"), "skills", "certifications", _degree(F.col("c_mktsegment")).alias("degree"),
                    F.coalesce("experience_days", F.lit(0)).cast("long").alias("experience_days")))


def job_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    return part.select(F.col("p_partkey").alias("job_id"), F.col("p_name").alias("title"),
                       F.split("p_name", " ").alias("skills"),
                       F.array("p_brand").alias("certifications"))


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey")
    return (orders.join(li, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("o_custkey").alias("resume_id"), F.col("l_partkey").alias("job_id"))
            .distinct())


def training_rows(spark: SparkSession, sf_dir: str, whole_skills: bool = False) -> DataFrame:
    """Application rows carrying both profiles; rows lacking either skill list dropped (B1).

    Profiles and rows are stored once: what follows reads them many times.
    """
    c = materialize(candidate_profiles(spark, sf_dir, whole_skills), "candidates").dropna(subset=["skills"])
    j = job_postings(spark, sf_dir).select("job_id", F.col("skills").alias("skills_required"),
                                           F.col("certifications").alias("job_certifications")).dropna(subset=["skills_required"])
    # the short lists of the jobs first: the profiles' long ones then cross no shuffle
    rows = applications(spark, sf_dir).join(j, "job_id").join(c, "resume_id").select(
        "job_id", *c.columns, "skills_required", "job_certifications")
    return materialize(rows, "training-rows")


def training_sides(spark: SparkSession, sf_dir: str, whole_skills: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, candidates, jobs): ``training_rows`` before the profiles are joined to the pairs, which are stored as keys (B1)."""
    c = materialize(candidate_profiles(spark, sf_dir, whole_skills), "candidates").dropna(subset=["skills"])
    release(spark)
    j = job_postings(spark, sf_dir).select("job_id", F.col("skills").alias("skills_required")).dropna(subset=["skills_required"])
    pairs = applications(spark, sf_dir)
    for side, key in ((j, "job_id"), (c, "resume_id")):
        pairs = pairs.join(side.select(key).hint("merge"), key, "left_semi")
    pairs = materialize(pairs.select("resume_id", "job_id"), "training-pairs")
    release(spark)
    return pairs, c, j


def resume_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sectioned resume text per order: ``doc_id, resume_id, text``.

    Lines: name; ``Email: ...``; ``Phone: 555-ddd-dddd``; ``Skills`` + the
    order's part-name words (sorted, comma separated); ``Certifications`` + one
    line per brand of a small part, ``- Brand N Certified - Acme Board, <year>``;
    ``Experience`` + one block per order line (by line number), blank-line
    separated: ``<Word> Engineer``, ``Acme Corp``, ``<ship year> - <ship year + 1>``.
    """
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size")
    lines = (li.join(part, F.col("l_partkey") == F.col("p_partkey"))
             .join(orders, F.col("l_orderkey") == F.col("o_orderkey")))
    ship_year = F.year("l_shipdate")
    last = F.element_at(F.split("p_name", " "), -1)
    block = F.concat_ws("\n",
                        F.concat(F.upper(F.substring(last, 1, 1)), F.lower(F.substr(last, F.lit(2))),
                                 F.lit(" Engineer")),
                        F.lit("Acme Corp"),
                        F.concat(ship_year.cast("string"), F.lit(" - "), (ship_year + 1).cast("string")))
    cert_line = F.when(F.col("p_size") < 10, F.concat(
        F.lit("- "), F.regexp_replace("p_brand", "#", " "), F.lit(" Certified - Acme Board, "),
        F.year("o_orderdate").cast("string")))
    per_order = lines.groupBy("o_orderkey", "o_custkey").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("p_name", " "))))).alias("words"),
        F.array_sort(F.collect_set(cert_line)).alias("cert_lines"),
        F.array_sort(F.collect_list(F.struct("l_linenumber", block.alias("b")))).alias("blocks"))
    c = cust.select("c_custkey", "c_name")
    doc = per_order.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("resume_id"),
        F.concat_ws("\n",
                    F.col("c_name"),
                    F.concat(F.lit("Email: "), _email("c_name")),
                    F.concat(F.lit("Phone: "), _phone("c_custkey")),
                    F.lit("Skills"),
                    F.array_join("words", ", "),
                    F.lit("Certifications"),
                    F.array_join("cert_lines", "\n"),
                    F.lit("Experience"),
                    F.array_join(F.transform("blocks", lambda s: s["b"]), "\n\n")).alias("text"))
    return doc
