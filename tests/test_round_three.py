"""Faults of the third round, each on rows made here."""

from datetime import datetime

import duckdb
import pytest

import __spark_entry__
from oracle_compare import compare
from vitae.sources import views as V
from vitae.sources.tables import TABLES


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """One customer whose six order lines name six parts of different words, and one with a single line."""
    at = str(tmp_path_factory.mktemp("shop"))
    day = datetime(1998, 1, 1)
    made = {
        "customer": ([(1, "Customer#1", "BUILDING"), (2, "Customer#2", "MACHINERY")],
                     "c_custkey long, c_name string, c_mktsegment string"),
        "orders": ([(1, 1, "F", day), (2, 2, "O", day)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp"),
        "lineitem": ([(1, k, k, day) for k in range(1, 7)] + [(2, 1, 1, day)],
                     "l_orderkey long, l_partkey long, l_linenumber int, l_shipdate timestamp"),
        "part": ([(k, f"{a} {b}", f"Brand#{k}", k * 3) for k, (a, b) in enumerate(
            zip(["hot", "cold", "old", "new", "red", "blue"], ["ring", "bolt", "plate", "nut", "gear", "pipe"]), 1)],
                 "p_partkey long, p_name string, p_brand string, p_size int")}
    for name in TABLES:
        rows, schema = made.get(name, ([], "nothing string"))
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


def _duck(at):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", ["match_features", "feature_describe"])
def test_features_use_every_word_of_a_customer(spark, shop, name):
    got = compare(spark, _duck(shop), shop, name, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name])
    assert got["status"] in ("OK", "APPROX"), got
    assert len(V.training_rows(spark, shop, whole_skills=True).where("resume_id = 1").first()["skills"]) == 12
    if name == "match_features":
        assert got["spark_rows"] == 7  # no word stands on a fifth of the first customer's lines: six rows were lost


def test_a_histogram_works_its_values_out_once(spark):
    from pyspark.sql import functions as F
    from vitae.operators import metrics as M
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(x):
        seen.add(1)
        return float(x)

    got = M.histogram(spark.range(100).select(value("id").alias("v")), "v", 10).collect()
    assert sorted((r["bin"], r["n"]) for r in got) == [(b, 10) for b in range(10)]
    assert seen.value == 100  # the range and the counts each worked out all values


def test_a_pair_stays_one_row_until_its_score(spark):
    from vitae.operators import tfidf
    weights = spark.createDataFrame([(1, f"t{k}", 0.1) for k in range(100)], "id long, term string, w double")
    pairs = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 1)], "lid long, rid long")
    got = tfidf.rowwise_cosine(pairs, weights, weights)
    assert sorted(((r["lid"] or 0, r["rid"], r["score"]) for r in got.collect())) == [
        (0, 1, 0.0), (1, 1, 2.0), (1, 1, 2.0), (1, 2, 0.0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "term#" not in plan.split("Aggregate", 1)[1].split("Join", 1)[0]  # no join by term behind the sums


def test_lists_that_differ_under_one_id_are_compared_row_by_row(spark):
    from vitae.operators import features as FT
    rows = spark.createDataFrame(
        [(1, 7, ["go", "sql"], ["go", "c"], [], "", 365), (1, 8, ["java"], ["java"], [], "", 365)],
        "resume_id long, job_id long, skills array<string>, skills_required array<string>, certifications array<string>, "
        "degree string, experience_days long")
    got = {r["job_id"]: r["keyword_match"] for r in FT.match_features(rows).collect()}
    assert got == {7: 0.5, 8: 1.0}


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_classifiers_learn_from_every_labelled_document(spark, name):
    import importlib
    model = importlib.import_module(f"vitae.llm.{name}")
    column = "toxic" if name == "toxicity" else "quality"
    docs = spark.createDataFrame([(i, "PLAIN!! TEXT!! " * 9 if i % 2 else "some quiet words of prose " * 9) for i in range(400)],
                                 "doc_id long, text string").repartition(3)
    labels = docs.selectExpr("doc_id", f"cast(doc_id % 2 as int) as {column}")
    kind = model.fit.__defaults__
    assert not hasattr(model, "SAMPLE_ROWS")
    one, many = model.fit(docs, labels), model.fit(docs, labels, rows=50)
    for m in (one, many):  # four hundred labels, shards of fifty: as before, a bound of fifty rows dropped the others
        import pyarrow as pa
        p = m.scorer()(pa.array(["PLAIN!! TEXT!! " * 9, "some quiet words of prose " * 9]))
        assert p[0] > 0.5 > p[1]
    from vitae.llm.samples import labelled_documents
    got = labelled_documents(docs, labels, column, *kind[1:3], 50).collect()
    from zlib import crc32
    assert sorted(r["doc_id"] for r in got) == [i for i in range(400) if crc32(str(i).encode()) % kind[1] != kind[2]]
    assert len({r["shard"] for r in got}) > 3


def test_scores_are_worked_out_once_for_all_their_readers(spark):
    from conftest import SMALL
    from vitae.plans.q_metrics import scored
    files = scored(spark, SMALL).inputFiles()
    assert files and all("/tables/scored-" in f for f in files)


def test_strings_of_runs_begin_where_entries_can(spark):
    from vitae.operators import extract as X
    docs = spark.createDataFrame([(1, "We use C, .NET and big data; a.net too"), (2, ""), (3, None), (4, "go")], "doc_id long, text string")
    vocab = spark.createDataFrame([("big data",), (".net",), ("go",), ("c",), ("data; a",), ("net",), (" and ",), ("!",)], "skill string")
    got = {r["doc_id"]: r["skills"] for r in X.detect_skills(docs, vocab).collect()}
    assert got == {1: [" and ", ".net", "big data", "c", "data; a", "net"], 2: [], 3: [], 4: ["go"]}
