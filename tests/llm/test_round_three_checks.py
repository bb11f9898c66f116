"""Links leave a block of near copies, not its pairs; pieces share the library's calls; ranges are broadcast."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitae.llm import lm_scoring, near_dedup, token_output, tokenizing
from vitae.llm.tokenizing import Encoder

ODD = ["a", "B", "é", "é", "\n", "\n\n", " ", "  ", "\t", "\r", "\x1c", " ", "　", ",", "%%", "12", "'s", "'",
       "<|endoftext|>", "<|", "<|endoftext|", ">", "İ", "ß", "Σ", "क़", "word", "Foo.", "x\ny", "́", "\U0001F600", "¨"]


def block(texts):
    """A block whose nodes all agree in every sample and are each a class of their own."""
    n = len(texts)
    sig = np.arange(near_dedup.HASHES + near_dedup.MORE, dtype=np.int32).tolist()
    return pa.table({"bucket": [1] * n, "p": [0] * n, "q": [0] * n, "side": [0] * n, "band": [0] * n, "node": list(range(n)),
                     "block": [0] * n, "comp": list(range(n)), "sig": pa.array([sig] * n, pa.list_(pa.int32())), "text": texts})


def test_a_block_gives_fewer_links_than_nodes():
    weights = SimpleNamespace(value=np.zeros(1 << near_dedup.CELL_BITS, np.float32))
    base = " ".join(f"w{i}" for i in range(100))
    alike, other = [f"{base} end{i}" for i in range(30)], [" ".join(f"v{k}x{i}" for i in range(50)) for k in range(20)]
    rows = block(alike + other)
    assert near_dedup._meet(rows).num_rows == 50 * 49 // 2
    got = near_dedup._joining(weights, 0.8)(rows).to_pylist()
    assert len(got) == 29 and all(r["b"] < 30 for r in got)
    reached = {0}
    for _ in range(30):
        reached |= {x for r in got if reached & {r["a"], r["b"]} for x in (r["a"], r["b"])}
    assert reached == set(range(30))


def test_groups_that_the_heads_leave_open_are_joined(spark, monkeypatch):
    """With one head a bucket and one node a part, the blocks alone must join the chain of each group."""
    monkeypatch.setattr(near_dedup, "HEADS", 1)
    monkeypatch.setattr(near_dedup, "PART", 1)
    rng = random.Random(8)
    rows = []
    for g in range(3):
        words = [f"g{g}w{rng.randrange(10**6)}" for _ in range(300)]
        for i in range(12):  # each differs from the next by one word of 300 more
            words = list(words)
            words[rng.randrange(300)] = f"new{g}x{i}"
            rows.append((100 * g + i, " ".join(words)))
    got = near_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i // 100 * 100 for i, _ in rows}


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_joined_pieces_give_the_librarys_ids(name, spaced):
    rng, e = random.Random(3), Encoder(name, spaced)
    texts = ["".join(rng.choice(ODD) + " " * (rng.random() < 0.3) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += [" ".join(f"word{i}ing" for i in range(500)), "İ, İ,", ""]
    for a in range(0, len(texts), 50):
        part = [t if a % 100 else t.replace("<|", "") for t in texts[a:a + 50]]
        assert e.encode(part) == [e.ids(t) for t in part]


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_the_library_gets_many_words_at_once(name, spaced):
    e, texts = Encoder(name, spaced), []
    model = e.model
    e.model = SimpleNamespace(encode=model.encode, encode_batch_fast=lambda t, **k: texts.extend(t) or model.encode_batch_fast(t, **k))
    words = ["".join(random.Random(i).choices("aeiounrst", k=9)) for i in range(2000)]
    want = e.ids(" ".join(words))
    assert e.encode([" ".join(words)]) == [want] and len(texts) < 100


def test_token_lists_are_not_shuffled_for_their_starts(spark, tmp_path):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), "id").alias("text"))
    path = token_output.write(docs, str(tmp_path / "tokens"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = token_output.read(spark, path)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_grams_are_counted_without_a_place_for_each():
    """A place in the distinct keys and a weight for each key of an id took 25 MB here."""
    rng = np.random.default_rng(4)
    ids = [rng.integers(0, 300, 100).astype("<u2") for _ in range(2000)]
    grams, train = lm_scoring.Grams(ids, 50257), rng.random(2000) < 0.9
    tracemalloc.start()
    one, n = grams.counted(train)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    key = np.concatenate([grams.pair, grams.triple, grams.context[grams.led]])
    doc = np.concatenate([grams.doc, grams.doc, grams.doc[grams.led]])
    want, back = np.unique(key, return_inverse=True)
    assert (one == want).all() and (n == np.bincount(back, train[doc], minlength=len(want))).all()
    assert most < 15e6, most


def test_workers_give_up_their_encoder_after_the_encoding():
    tokenizing.encoder("byte_bpe_50k.json", True)
    assert list(lm_scoring.lean(lambda batches: iter(batches))([1])) == [1]
    assert not tokenizing._ENCODERS
