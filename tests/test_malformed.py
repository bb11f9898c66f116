"""Input that cannot be read keeps its row and says why; listings, files and guards around it."""

import json
import os

from pyspark.sql import functions as F

from vitae.operators import extract as X
from vitae.operators import features as FT
from vitae.operators import intake as IN
from vitae.operators import jobs as J
from vitae.operators import model as MD
from vitae.sources import io


def test_csv_rows_with_too_few_or_too_many_fields(spark, tmp_path):
    (tmp_path / "c.csv").write_text('skills,skills_required,more\n"[\'a\', \'b\']","line\nbreak",x\nonly\nd,e,f,g\n,"[\'x\']",y\n"p","q",\n')
    rows = io.read_corpus_checked(spark, str(tmp_path), ["skills", "skills_required"]).collect()
    assert len(rows) == 5
    assert [r.error for r in rows] == [None, io.MALFORMED_ROW, io.MALFORMED_ROW, None, None]
    assert rows[0].skills_required == "line\nbreak" and rows[1].skills == "only"
    assert {r.skills for r in io.read_corpus(spark, str(tmp_path), ["skills", "skills_required"]).collect()} == {"['a', 'b']", "p"}
    io.read_corpus(spark, str(tmp_path), ["skills", "skills_required"]).write.parquet(f"{tmp_path}/out/p")
    again = io.read_corpus_checked(spark, f"{tmp_path}/out/p", ["skills"], "parquet")
    assert again.where("error IS NULL").count() == 2


def test_broken_job_documents_keep_their_row(spark, tmp_path):
    good = {"jobRoles": [{"value": "v", "label": "l"}], "skills": ["python"], "isFresher": True, "yearsExperience": "x", "timestamp": "?"}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text('{"jobRoles": [{"value"')
    (tmp_path / "c.json").write_text("")
    rows = {r.error: r for r in io.read_jobs(spark, str(tmp_path)).collect()}
    assert io.read_jobs(spark, str(tmp_path)).count() == 3 and rows[None].skills == ["python"] and rows[None].yearsExperience is None
    bad = rows[io.MALFORMED_DOCUMENT]
    assert bad.skills is None and bad.job_id != rows[None].job_id
    jobs = io.read_jobs(spark, str(tmp_path))
    assert J.simplify_jobs(jobs).count() == 3 and jobs.where("error IS NOT NULL").select(J.validate_jobs(jobs)).first()[0] == J.NO_ROLE
    io.save_preferences(jobs.where("error IS NULL").select("jobRoles", "skills", "isFresher"), f"{tmp_path}/saved")
    assert spark.read.json(f"{tmp_path}/saved").first()["skills"] == ["python"]


def test_unreadable_resumes_reach_the_profiles_as_errors(spark, tmp_path):
    for name, content in {"a.txt": "Ann\nann@x.org\nknows java".encode(), "b.txt": b"caf\xe9 \xff\xfe", "c.txt": b"", "d.txt": "é\x00".encode()}.items():
        (tmp_path / name).write_bytes(content)
    texts = io.read_resume_text(spark, str(tmp_path))
    got = {r.file_name: (r.text, r.error) for r in texts.collect()}
    assert got == {"a.txt": ("Ann\nann@x.org\nknows java", None), "b.txt": (None, io.NOT_TEXT), "c.txt": (None, io.NO_TEXT), "d.txt": ("é\x00", None)}
    vocab = spark.createDataFrame([("java",)], "skill string")
    profiles = {r.doc_id: r for r in X.parse_profiles(texts, vocab, "file_name", error_col="error").collect()}
    assert profiles["a.txt"].status == "processed" and profiles["a.txt"].skills == ["java"] and profiles["a.txt"].email == "ann@x.org"
    for name, error in (("b.txt", io.NOT_TEXT), ("c.txt", io.NO_TEXT)):
        r = profiles[name]
        assert (r.status, r.error, r.text_length, r.email, r.skills, r.certifications, r.work_experience) == ("parse_error", error, None, None, [], [], [])
    files = spark.createDataFrame([("a.pdf", "processed"), ("b.pdf", "processed"), ("c.exe", "rejected")], "filename string, status string")
    checked = IN.parsed(files.withColumn("error", F.when(F.col("filename") != "a.pdf", "broken")).withColumn("batch_id", F.lit(1)))
    assert {r.filename: r.status for r in checked.collect()} == {"a.pdf": "processed", "b.pdf": "parse_error", "c.exe": "rejected"}
    assert tuple(IN.intake_counts(checked).first()) == (1, 1, 2, True)


def test_profiles_without_an_error_column(spark):
    docs = spark.createDataFrame([(1, "java"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: (r.status, r.error) for r in X.parse_profiles(docs, spark.createDataFrame([("java",)], "skill string")).collect()}
    assert got == {1: ("processed", None), 2: ("parse_error", "no text"), 3: ("parse_error", "no text")}


def test_manifest_lists_allowed_files(spark, tmp_path):
    os.makedirs(tmp_path / "sub.pdf")
    for name in ("a.PDF", "b.docx", "c.exe", "noext", "sub.pdf/d.doc"):
        (tmp_path / name).write_bytes(b"12345")
    got = {r.filename: r.size for r in IN.intake_manifest(spark, str(tmp_path)).collect()}
    assert got == {"a.PDF": 5, "b.docx": 5, "d.doc": 5}


def test_too_few_positives_write_a_review_instead_of_a_model(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), *([0.1] * 5), 0.2, int(i == 0)) for i in range(12)],
                                 ["row_id", *FT.FEATURES, "match_score", "label"])
    fitted, summary = MD.train_full(rows, review_path=f"{tmp_path}/review")
    assert fitted is None and summary["guard"] == "skip" and spark.read.option("header", "true").csv(f"{tmp_path}/review").count() == 12
    many = spark.range(30).select((F.col("id") < F.lit(5)).cast("int").alias("label"))
    assert MD.guard(many, "label") == ("warn", 5) and MD.guard(many.withColumn("label", F.lit(1)), "label") == ("fit", 30)


def test_experience_years(spark):
    rows = [(["2020-01-01", "x"], ["2021-01-01", "2022-01-01"]), (["2021-01-01"], ["2020-01-01"]), (None, None), ([], [])]
    df = spark.createDataFrame(rows, "s array<string>, e array<string>")
    assert [r[0] for r in df.select(FT.experience_years("s", "e")).collect()] == [366 / 365, -366 / 365, 0.0, 0.0]
