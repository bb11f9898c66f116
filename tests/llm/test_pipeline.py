"""The pipeline's stages over a small corpus, and the guard around the subpackage."""

import collections
import itertools
import math
import random

import pyarrow as pa

import corpus_pipeline
import __spark_entry__
from vitae.llm import near_dedup, toxicity
from vitae.llm.tokenizing import Encoder
from vitae.llm.words import texts_of
from vitae.session import materialize

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = source = spark.read.parquet(f"{DIR}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{DIR}/labels.parquet").where("toxic = 1").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = seen[name] = materialize(stage(spark, docs, DIR), "test-stage")
        if name != "packing":
            assert docs.columns == source.columns
    count = {k: v.count() for k, v in seen.items()}
    assert source.count() - len(toxic) * 2 <= count["toxicity"] <= source.count()
    texts = seen["exact dedup"].select("text")
    assert texts.distinct().count() == count["exact dedup"] == seen["toxicity"].select("text").distinct().count()
    assert 0 < count["near dedup"] <= count["exact dedup"]
    assert seen["mixing"].select("doc_id").distinct().join(seen["near dedup"], "doc_id", "left_anti").count() == 0
    pieces = seen["packing"].selectExpr("sum(length) as n", "count(distinct doc_id) as d").first()
    assert pieces.d == seen["mixing"].select("doc_id").distinct().count() and pieces.n > 0


def near_classes(texts):
    """Smallest row of each row's class, by comparing all pairs of weighted shingles."""
    sets = []
    for x in texts:
        _, h, n = near_dedup.shingles(texts_of(pa.array([x])))
        sets.append(dict(zip(h.tolist(), n.tolist())))
    df = collections.Counter(c for s in sets for c in {h >> 44 for h in s})
    idf = lambda h: 1 + 0.25 * max(math.log((1 + len(sets)) / (1 + df[h >> 44])), 0) / math.log(1 + len(sets))
    sets = [{h: n * idf(h) for h, n in s.items()} for s in sets]
    label = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i], sets[j]
        common = sum(min(a[h], b[h]) for h in a.keys() & b.keys())
        if common and common >= 0.8 * (sum(a.values()) + sum(b.values()) - common) - 1e-9:
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    return label


def test_run_against_brute_force(spark, tmp_path, monkeypatch):
    """Each stage's rows in run(), against plain Python over the rows of the stage before."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "ti", "re", "ou", "st", "el"]) for _ in range(3))
    base = [word() for _ in range(200)]
    docs = [(200 - i, " ".join(word() for _ in range(rng.randint(20, 120))), f"s{i % 3}") for i in range(60)]
    docs += [(i, " ".join([*base[:i % 190], "changed", *base[i % 190 + 1:]]), "s1") for i in range(320, 300, -1)]
    docs += [(500 - i, docs[i][1], "s0") for i in range(12)]
    schema = "doc_id long, text string, source string"
    spark.createDataFrame(docs, schema).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(d[0], int(d[0] % 2), int(d[0] % 9 == 0)) for d in docs]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {}
    def keep(df, name):
        kept[name] = materialize(df, name)
        return kept[name]
    monkeypatch.setattr(corpus_pipeline, "materialize", keep)
    last = corpus_pipeline.run(spark, str(tmp_path))
    rows = {k: [tuple(r) for r in v.collect()] for k, v in kept.items() if k != "stage-packing"}
    source = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.fit(source, spark.read.parquet(str(tmp_path / "labels.parquet")))
    p = model.scorer()(pa.array([d[1] for d in docs]))
    assert sorted(rows["stage-toxicity"]) == sorted(d for d, x in zip(docs, p) if x < 0.5)
    best = {}
    for d in sorted(rows["stage-toxicity"]):
        best.setdefault(d[1], d)
    assert sorted(rows["stage-exact-dedup"]) == sorted(best.values())
    at = sorted(best.values())
    label = near_classes([d[1] for d in at])
    assert len(set(label)) < len(at)
    assert sorted(rows["stage-near-dedup"]) == [at[i] for i in sorted(set(label))]
    near, mixed = rows["stage-near-dedup"], rows["stage-mixing"]
    size = collections.Counter()
    for d in near:
        size[d[2]] += len(d[1].split())
    weight = dict(zip(sorted(size), [5, 2, 1]))
    target, open_, left = {}, set(size), float(sum(size.values()))
    while open_:
        rate = left / sum(weight[x] for x in open_)
        full = {x for x in open_ if 3 * size[x] < rate * weight[x]}
        for x in full or open_:
            target[x] = 3.0 * size[x] if full else rate * weight[x]
            left -= target[x] if full else 0
        open_ -= full or open_
    assert set(mixed) <= set(near)
    for x in size:
        taken = sum(len(d[1].split()) for d in mixed if d[2] == x)
        assert abs(taken - target[x]) <= max(len(d[1].split()) for d in near if d[2] == x)
    e, got, used = Encoder("byte_bpe_50k.json", True), collections.Counter(), collections.defaultdict(list)
    for r in last.collect():
        got[r.doc_id, r.start, bytes(r.ids)] += 1
        used[r.sequence_id].append((r.offset, r.length))
    for d, n in collections.Counter(mixed).items():
        mine = sorted((k[1], k[2], c) for k, c in got.items() if k[0] == d[0])
        assert sum(len(b) * c for _, b, c in mine) == n * len(e.ids(d[1]) + b"\x01\0\0\0")
        whole = e.ids(d[1]) + b"\x01\0\0\0"
        assert all(whole[4 * a:4 * a + len(b)] == b for a, b, _ in mine)
    assert {k[0] for k in got} == {d[0] for d in mixed}
    for v in used.values():
        assert [o for o, _ in sorted(v)] == [0, *itertools.accumulate(n for _, n in sorted(v))][:-1]


def test_every_query_is_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= names
