"""Any long id in best match, files without a batch, sizes past the largest unit."""

from pyspark.sql import functions as F

from vitae.functions.text import human_size
from vitae.operators.intake import validate_intake
from vitae.operators.tfidf import best_match


def test_best_match_takes_any_long_id(spark):
    resumes = spark.createDataFrame([(1, "spark sql tuning"), (2, "welding steel frames")], "rid long, rtext string")
    ids = [2**43 + 5, -7, -2**63, 2**63 - 1]
    jobs = spark.createDataFrame(
        [(ids[0], "spark sql tuning"), (ids[1], "welding steel frames"), (ids[2], "baking bread"),
         (ids[3], "spark sql tuning")], "jid long, jtext string")
    got = {r.resume_id: (r.job_id, round(r.match_score, 5)) for r in
           best_match(resumes, jobs, id_col_r="rid", text_col_r="rtext", id_col_j="jid", text_col_j="jtext").collect()}
    assert got == {1: (2**43 + 5, 1.0), 2: (-7, 1.0)}


def test_files_without_a_batch_are_one_batch(spark):
    files = spark.createDataFrame([("a.pdf", 10, 1), ("b.pdf", 10, None), ("c.pdf", 10, None)],
                                  "filename string, size long, batch_id long")
    got = validate_intake(files, max_batch=15).collect()
    assert sorted((r.filename, r.status) for r in got) == [
        ("a.pdf", "processed"), ("b.pdf", "rejected"), ("c.pdf", "rejected")]


def test_sizes_past_the_largest_unit(spark):
    got = spark.range(1).select(human_size(F.lit(1024**4)).alias("a"), human_size(F.lit(5 * 1024**4)).alias("b")).first()
    assert got == ("1024 GB", "5120 GB")
