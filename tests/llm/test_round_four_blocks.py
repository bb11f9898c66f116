"""Findings of FINDINGS_r04.md on the corpus operators."""

import numpy as np

from vitae.llm import embedding_dedup


def test_embedding_blocks_meet_without_a_shuffle(spark, monkeypatch):
    """Finding 1: pairs of blocks are read from the stored blocks, and links are the same in any blocks."""
    rng = np.random.default_rng(21)
    centres = np.repeat(rng.standard_normal((40, 16)), 25, 0)
    m = np.concatenate([centres + 0.05 * rng.standard_normal(centres.shape), rng.standard_normal((200, 16))]).astype(np.float32)
    m = np.concatenate([m, m[:100]])
    data = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(5000, [1.0, 2.0]), (5001, [2.0, 4.0]), (5002, None)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    plans, write = {}, embedding_dedup.materialize

    def seen(df, name, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name, **options)

    monkeypatch.setattr(embedding_dedup, "materialize", seen)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64 * 16 * 4)  # 64 vectors a block
    monkeypatch.setattr(embedding_dedup, "FOLD", 50)
    got = {r.vec_id: r for r in embedding_dedup.report(rows).collect()}
    assert "CartesianProduct" in plans["emb-found"] and "Exchange" not in plans["emb-found"]
    u = embedding_dedup._units(m)
    near = u @ u.T >= 0.9
    low = np.arange(len(m))
    for _ in range(30):
        low = np.array([low[x].min() for x in near])
    assert [got[i].n_links for i in range(len(m))] == (near.sum(1) - 1).tolist()
    assert [got[i].component_id for i in range(len(m))] == low.tolist()
    assert (got[5000].n_links, got[5001].component_id, got[5002].n_links) == (1, 5000, 0)
