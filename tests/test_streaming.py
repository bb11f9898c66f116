import os

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from vitae.operators import intake as IN
from vitae.operators import screening as SC
from vitae.plans import q_screening as Q
from vitae.session import materialize
from vitae.sources import views as V
from vitae.streaming import live


def _pages(spark):
    return spark.read.parquet(f"{SMALL}/pages.parquet").select(
        F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("filename"),
        F.octet_length("html").cast("long").alias("size"))


def _run(spark, base, **limits):
    schema = "filename string, size long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    q = live.intake_counts_stream(stream, f"{base}/counts", f"{base}/ck", **limits)
    q.awaitTermination()
    return {r.status: r["count"] for r in live.read_counts(spark, f"{base}/counts").collect()}


def test_intake_counts_go_on_after_a_stop_and_a_retried_epoch(spark, tmp_path):
    base = str(tmp_path)
    pages = _pages(spark)
    limits = {"extensions": ["com", "org"], "max_file": 8192}

    def batch(n):
        rows = pages if n == 2 else pages.limit(30)
        checked = IN.validate_intake(rows.withColumn("batch_id", F.lit(0)), extensions=["com", "org"], max_file=8192, max_batch=1 << 40)
        return {r.status: r["count"] for r in checked.groupBy("status").count().collect()}

    assert live.read_counts(spark, f"{base}/counts") is None
    first, rest = pages.limit(30), pages.offset(30)
    first.repartition(3).write.parquet(f"{base}/in")
    assert _run(spark, base, **limits) == batch(1)
    rest.repartition(2).write.mode("append").parquet(f"{base}/in")
    assert _run(spark, base, **limits) == batch(2)  # a new query with the old checkpoint
    # an epoch whose commit was lost is run again and writes the same version
    commits = sorted((int(n), n) for n in os.listdir(f"{base}/ck/commits") if n.isdigit())
    os.remove(f"{base}/ck/commits/{commits[-1][1]}")
    crc = f"{base}/ck/commits/.{commits[-1][1]}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert _run(spark, base, **limits) == batch(2)
    assert _run(spark, base, **limits) == batch(2)  # nothing new


def test_null_keys_are_counted(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), (None, 1), (None, 1), ("a", None), ("b", 2)], "k string, n int")
    rows.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.running_counts(stream, ["k", "n"], f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = {tuple(r) for r in live.read_counts(spark, f"{tmp_path}/out").collect()}
    assert got == {("a", None, 2), (None, 1, 2), ("b", 2, 1)}


@pytest.fixture(scope="module")
def sides(spark):
    return (V.applications(spark, SMALL), materialize(V.candidate_profiles(spark, SMALL), "c"), V.job_postings(spark, SMALL))


def _package(mode, apps, cands, jobs):
    if mode == "casual_skills":
        return SC.ModelPackage(*Q.CASUAL_SKILLS_MODEL)
    if mode == "strict_skills":
        vocab = SC.fit_strict_vocabulary(cands, jobs, Q.STRICT_SYNONYMS, Q.STRICT_WEIGHTS)
        return SC.ModelPackage(*Q.STRICT_SKILLS_MODEL, vocabulary=vocab, synonyms=Q.STRICT_SYNONYMS, skill_weights=Q.STRICT_WEIGHTS)
    vocab = SC.fit_full_vocabulary(cands)
    scaler = SC.fit_full_scaler(SC.full_features(apps, cands, jobs, vocab))
    return SC.ModelPackage(*Q.FULL[mode][0], vocabulary=vocab, scaler=scaler)


@pytest.mark.parametrize("mode", SC.MODES)
def test_screen_stream_equals_batch(spark, tmp_path, sides, mode):
    apps, cands, jobs = sides
    apps.repartition(3).write.parquet(f"{tmp_path}/apps")
    pkg = _package(mode, apps, cands, jobs)
    live.store_profiles(cands, jobs, pkg, mode, f"{tmp_path}/profiles", folders=8)
    stream = spark.readStream.schema(apps.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/apps")
    q = live.screen_stream(stream, f"{tmp_path}/profiles", pkg, mode, f"{tmp_path}/out", f"{tmp_path}/ck", folders=8)
    q.awaitTermination()
    got, want = spark.read.parquet(f"{tmp_path}/out").drop("epoch"), SC.screen(apps, cands, jobs, mode, pkg)
    assert sorted(got.columns) == sorted(want.columns)
    cols = want.columns
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_a_micro_batch_reads_only_its_folders_and_no_terms(spark, tmp_path, sides):
    apps, cands, jobs = sides
    mode = "strict_full"
    pkg = _package(mode, apps, cands, jobs)
    live.store_profiles(cands, jobs, pkg, mode, f"{tmp_path}/p", folders=16)
    one = spark.createDataFrame([tuple(apps.first())], apps.schema)
    out = live.screen_batch(one, f"{tmp_path}/p", pkg, mode, folders=16)
    plan = out._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    read = live._stored(one, f"{tmp_path}/p", "cands", 16)
    files = {f.split("folder=")[1].split("/")[0] for f in read.inputFiles()}
    assert out.count() == 1 and "PartitionFilters" in read._jdf.queryExecution().executedPlan().toString()
    assert read.count() < cands.count() / 4 and len(files) >= 1
    with pytest.raises(ValueError):
        live.store_profiles(cands, jobs, pkg, "other", f"{tmp_path}/q")
