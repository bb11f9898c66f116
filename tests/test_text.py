import math

from pyspark.sql import functions as F

from vitae.functions import text as TX
from vitae.operators import extract as X
from vitae.operators import features as FT
from vitae.operators import jobs as J
from vitae.operators import metrics as M


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_clean_variants(spark):
    assert one(spark, TX.clean(F.col("x"), "delete"), "CI/CD") == "cicd"
    assert one(spark, TX.clean(F.col("x"), "space"), "CI/CD") == "ci cd"
    assert one(spark, TX.clean(F.col("x"), "collapse"), "  A  b\n\nc ") == "a b c"


def test_parse_list(spark):
    assert one(spark, TX.parse_list(F.col("x")), "['a', 'b']") == ["a", "b"]
    assert one(spark, TX.parse_list(F.col("x")), '["C++", \'Java\']') == ["C++", "Java"]
    assert one(spark, TX.parse_list(F.col("x")), "plain text") == ["plain text"]


def test_sample_and_slug(spark):
    assert one(spark, TX.text_sample(F.col("x"), 3), "abcdef") == "abc..."
    assert one(spark, TX.text_sample(F.col("x"), 3), "abc") == "abc"
    assert one(spark, TX.role_slug(F.col("x")), "  Data   Scientist ") == "data-scientist"
    assert one(spark, TX.truncate_cell(F.col("x")), "x" * 31) == "x" * 27 + "..."


def test_human_size(spark):
    assert one(spark, TX.human_size(F.col("x")), 0, "x long") == "0 Bytes"
    assert one(spark, TX.human_size(F.col("x")), 1536, "x long") == "1.5 KB"
    assert one(spark, TX.human_size(F.col("x")), 1024 * 1024, "x long") == "1 MB"


def test_phone_and_email(spark):
    assert one(spark, X.first_phone(F.col("x")), "call +44 20 7946 0958") == "+44 20"
    assert one(spark, X.first_phone(F.col("x")), "(555) 123-4567") == "(555) 123-4567"
    assert one(spark, X.first_email(F.col("x")), "mail a.b@c.org or x@y.io") == "a.b@c.org"
    assert one(spark, X.first_email(F.col("x")), "none") is None


def test_keyword_ratio(spark):
    df = spark.createDataFrame([("a b c", "b c d e"), ("a", "")], "h string, n string")
    got = [r[0] for r in df.select(TX.keyword_ratio("h", "n")).collect()]
    assert got == [0.5, 0.0]


def test_experience_years(spark):
    df = spark.createDataFrame([(["2020-01-01", "bad"], ["2021-01-01", "2022-01-01"])],
                               "s array<string>, e array<string>")
    got = df.select(FT.experience_years("s", "e")).first()[0]
    assert math.isclose(got, 366 / 365)


def test_education_whole_word_vs_substring(spark):
    df = spark.createDataFrame([("Diploma",), ("Master of Arts",), ("",)], "d string")
    whole = [r[0] for r in df.select(FT.education_level("d")).collect()]
    sub = [r[0] for r in df.select(FT.education_level("d", __import__(
        "vitae.functions.dictionaries", fromlist=["x"]).DEGREE_LEVELS_SERVING, whole_word=False)).collect()]
    assert whole == [2.0, 4.0, 0.0]
    assert sub[0] == 4.0  # "diploma" contains "ma": the substring rule's misfire


def test_label_and_decision_boundaries(spark):
    df = spark.createDataFrame([(0.18,)], "s double")
    assert df.select(M.label("s", 0.18)).first()[0] == 0
    assert df.select(M.decide("s", 0.18)).first()[0] == 1


def test_match_score_golden(spark):
    # education 4/5, certifications 2/10, experience 5/20, keywords 1/5 -> 0.2275 + 0.35 sim
    df = spark.createDataFrame([(0.0, 0.8, 0.2, 0.25, 0.2), (1.0, 0.8, 0.2, 0.25, 0.2)],
                               ",".join(f"{c} double" for c in FT.FEATURES))
    got = [r[0] for r in df.select(FT.match_score()).collect()]
    assert math.isclose(got[0], 0.2275) and math.isclose(got[1], 0.2275 + 0.35)


def test_job_simplify_and_validate(spark):
    doc = [([("software-engineer", "Software Engineer"), ("data-scientist", "Data Scientist")],
            ["node", "python", "java", "kotlin"], True, "0")]
    df = spark.createDataFrame(doc, "jobRoles array<struct<value:string,label:string>>, skills array<string>, "
                                    "isFresher boolean, yearsExperience string").withColumn("job_id", F.lit(1))
    assert J.simplify_jobs(df).first()["skills"] == ["data-scientist", "java", "kotlin", "node", "python",
                                                      "software-engineer"]
    assert df.select(J.validate_jobs(df)).first()[0] is None
    bad = df.withColumn("isFresher", F.lit(False))
    assert bad.select(J.validate_jobs(bad)).first()[0] == J.NO_YEARS
