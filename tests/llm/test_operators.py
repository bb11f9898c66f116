"""Each operator against brute force on small rows, and its defined results for odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitae.llm import (blocks, components, embedding_dedup, exact_dedup, lm_scoring, mixing, near_dedup, packing,
                       quality, substring_dedup, token_output, toxicity)
from vitae.llm.tokenizing import Encoder
from vitae.llm.words import WordHash, texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, block string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "ti", "re", "ou", "él", "st"]) for _ in range(rng.randint(1, 4)))
                    for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, a shared passage, nulls in every column, a repeated row, an empty and a long text."""
    rng = random.Random(3)
    passage, base = prose(rng, 60), prose(rng, 300).split()
    out = [(i, prose(rng, rng.randint(3, 200)), "en", f"s{i % 4}", 1, "x", "y") for i in range(40)]
    for i in range(40, 48):
        near = list(base)
        near[rng.randrange(300)] = "changed"
        out.append((i, " ".join(near), "en", "s0", 1, "x", None))
    out += [(i, f"{prose(rng, 20)} {passage}\n{prose(rng, 5)}", None, None, None, None, None) for i in range(48, 52)]
    out += [(52, None, None, "s1", None, None, None), (53, "", "en", "s1", 0, "x", "y"), (54, out[3][1], "en", "s9", 1, "x", "y")]
    out += [out[5], out[5], (None, prose(rng, 12), None, "s2", None, None, None), (55, prose(rng, 9000), "de", "s2", 5, "", "")]
    out += [(56, " a\t\tb\x0bc  d   e \n\n f  ", "en", "s3", 1, "x", "y")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    ids = [r[0] for r in rows if r[0] is not None]
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in ids] + [(None, 1, 1), (3, None, None)],
                                 "doc_id long, quality int, toxic int")


def test_words_and_hashes():
    texts = ["a b\x0bc\n", None, "", "\t x\xa0y zé ", "A" * 5000 + " b"]
    t = texts_of(pa.array(texts))
    got = [bytes(t.buf[s:e]).decode() for s, e in zip(t.starts, t.ends)]
    assert got == [w for x in texts for w in WORD.findall(x or "")] and t.n_words.tolist() == [3, 0, 0, 2, 2]
    h = WordHash(1)(t.buf, t.starts, t.ends)
    assert len(set(h.tolist())) == len(set(got)) and h[1] == h[-1]


@pytest.mark.parametrize("model", [toxicity, quality])
def test_classifiers_score_every_row(spark, docs, none, labels, rows, model):
    got = model.score_documents(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out for r in got if r.doc_id is None)
    assert model.score_documents(none, labels).count() == 0
    assert model.score_documents(docs, labels.limit(0)).count() == len(rows)


@pytest.mark.parametrize("model", [toxicity, quality])
def test_classifiers_without_labels_or_with_one_class(spark, docs, labels, rows, model):
    column = "toxic" if model is toxicity else "quality"
    none = model.score_documents(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and all(0 <= r.score <= 1 for r in none)
    if model is quality:
        assert {r.score for r in none} == {0.5}
        assert quality.statistics(texts_of(pa.array(["a b"]))).shape == (1, quality.DENSE + quality.SHAPES)
    for side in (0, 1):
        one = labels.withColumn(column, F.lit(side)).where("doc_id is not null")
        got = model.score_documents(docs, one).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        if model is quality:
            assert {r.predicted for r in got} == {side}


CLASHING = ["__row", "__size", "__null", "__before", "__doc", "__tie", "__hash", "__text", "row", "class_id", "doc", "kept"]


@pytest.mark.parametrize("stage", [exact_dedup.deduplicate, near_dedup.deduplicate, mixing.mix])
def test_columns_with_clashing_names_pass_through(spark, docs, stage):
    plain = docs.select("doc_id", "text", "source").where("doc_id < 12")
    more = plain.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id")).alias(c) for c in CLASHING])
    got = stage(more)
    assert got.columns == more.columns
    found = got.collect()
    assert sorted(str((r.doc_id, r.text, r.source)) for r in found) == sorted(
        str(tuple(r[c] for c in ("doc_id", "text", "source"))) for r in stage(plain).select("doc_id", "text", "source").collect())
    assert found and all(r[c] == f"{c}:{r.doc_id}" for r in found for c in CLASHING)


def test_toxicity_learns_words():
    rng = random.Random(1)
    texts = [prose(rng, 40) + (" awful mean thing" if i % 4 == 0 else "") for i in range(600)]
    y = np.array([float(i % 4 == 0) for i in range(600)])
    p = toxicity.train(pa.array(texts[:400]), y[:400]).scorer()(pa.array(texts[400:]))
    assert ((p >= 0.5) == (y[400:] == 1)).mean() > 0.97


def test_quality_learns_preferences():
    rng = random.Random(2)
    texts = [prose(rng, 60) if i % 3 else " ".join(w.upper() + "!!" for w in prose(rng, 60).split()) for i in range(300)]
    y = np.array([int(i % 3 > 0) for i in range(300)])
    stats = quality._all_statistics(pa.array(texts))
    p = quality.train(stats[:200], y[:200]).scorer()(pa.array(texts[200:]))
    assert ((p >= 0.5) == (y[200:] == 1)).mean() > 0.97


def removed(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for k in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_difference_cover():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(
        range(substring_dedup.PERIOD))


def test_words_of_thue_morse_letters_do_not_collide(spark):
    """Two words of 1024 letters whose polynomials modulo 2**64 are equal."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    t = texts_of(pa.array([f"{one} {two} {one.upper()}"]))
    for seed in (303, 304, 606):
        h = WordHash(seed)(t.buf, t.starts, t.ends)
        low = WordHash(seed, lower=True)(t.buf, t.starts, t.ends)
        assert len(set(h.tolist())) == 3 and low[0] == low[2] != low[1]
    rest = " ".join(f"w{i}" for i in range(34))
    frame = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{two} {rest}")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.report(frame).collect()}
    assert got == {1: (35, 0), 2: (35, 35), 3: (35, 35)}


def test_pairs_of_hashes_that_share_their_first():
    one = np.array([1, 1, 1, 2, 5, 5], np.uint64)
    two = np.array([7, 9, 8, 7, 3, 4], np.uint64)
    a = np.array([1, 1, 1, 1, 2, 2, 5, 5, 6, 0], np.uint64)
    b = np.array([7, 8, 9, 6, 7, 8, 4, 5, 4, 7], np.uint64)
    assert substring_dedup._both(one, two, a, b).tolist() == [True, True, True, False, True, False, True, False, False, False]
    none = np.zeros(0, np.uint64)
    assert substring_dedup._both(none, none, a, b).sum() == 0


def test_substring_dedup(docs, none, rows):
    want = sorted((str(r[0]), *x) for r, x in zip(rows, removed([r[1] for r in rows], 35)))
    got = substring_dedup.deduplicate(docs.select("doc_id", "text")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == want
    assert substring_dedup.report(none.select("doc_id", "text")).count() == 0


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(docs, none, rows, keep):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    low = lambda x: -1 if x is None else x
    best = {t: (max if keep == "largest" else min)(ids, key=low) for t, ids in groups.items()}
    got = exact_dedup.report(docs, keep).collect()
    assert sorted((str(r.doc_id), r.text_sha256, str(r.keep_id), r.group_size) for r in got) == sorted(
        (str(r[0]), hashlib.sha256((r[1] or "").encode()).hexdigest(), str(best[r[1] or ""]), len(groups[r[1] or ""]))
        for r in rows)
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.deduplicate(docs, keep)
    assert kept.columns == docs.columns
    assert sorted((low(r.doc_id), r.text or "") for r in kept.collect()) == sorted((low(i), t) for t, i in best.items())
    assert exact_dedup.report(none).count() == exact_dedup.deduplicate(none).count() == 0


def test_mixing(docs, none, rows):
    got = mixing.report(docs).collect()
    assert len(got) == len(rows) and sorted(mixing.report(docs).collect(), key=str) == sorted(got, key=str)
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = dict(zip(names, [5, 2, 1] * 9))
    target, open_, left = {}, set(names), float(sum(size.values()))
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * size[s] < rate * weight[s]}
        for s in full or open_:
            target[s] = 3.0 * size[s] if full else rate * weight[s]
            left -= target[s] if full else 0
        open_ -= full or open_
    by_size = collections.defaultdict(float)
    for r in got:
        by_size[r.source_size, round(r.target, 6)] += r.taken
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    assert {k for k in by_size} == {(size[s], round(target[s], 6)) for s in names}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixing.report(none).count() == mixing.mix(none).count() == 0
    assert sum(len(WORD.findall(r.text or "")) for r in mixed.collect()) == sum(r.taken for r in got)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(150)] + [(7, 7)]
    want = {}
    for a, b in edges:
        want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_near_dedup(docs, none, rows):
    got = near_dedup.report(docs).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(set)
    for r in got:
        by[r.class_id].add(r.doc_id)
    assert {40, 41, 42, 43, 44, 45, 46, 47} <= by[40] and {3, 54} <= by[3]
    assert sum(len(v) > 1 for v in by.values()) == 2 and {48} == by[48]
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert near_dedup.report(none).count() == 0


def test_open_pairs_leave_a_block_well_below_the_threshold():
    """Two nodes of which 225 of 320 samples agree (0.70; at similarity 0.8, 0.001 % have fewer) are compared."""
    rng = np.random.default_rng(13)
    a = rng.integers(0, 2**31, near_dedup.HASHES + near_dedup.MORE).astype(np.int32)
    b = a.copy()
    b[4:4 + len(a) - 225] += 1
    rows = pa.table({"bucket": [9, 9], "p": [0, 0], "q": [0, 0], "side": [0, 0], "band": [0, 0], "node": [5, 3],
                     "block": [1, 2], "comp": [5, 3], "sig": pa.array([a.tolist(), b.tolist()], pa.list_(pa.int32()))})
    assert near_dedup._meet(rows).to_pylist() == [{"a": 3, "b": 5, "block_a": 2, "block_b": 1}]


def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**63, 1000).astype(np.uint64)
    w = rng.integers(1, 4, 1000).astype(np.float32)
    a, b = slice(0, 800), slice(100, 1000)
    sig = [near_dedup.samples(np.array([0, len(h[s])]), h[s], np.log(w[s]))[0] for s in (a, b)]
    true = w[100:800].sum() / w.sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * (true * (1 - true) / near_dedup.HASHES) ** 0.5


def test_embedding_dedup(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 32))
    m = np.concatenate([base, base[:30] + 0.2 * rng.standard_normal((30, 32)), base[:5]]).astype(np.float32)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    odd = [(200, None), (201, [0.0] * 32), (202, [float("nan")] * 32), (203, [None] * 32), (204, []), (205, [1.0, 2.0])]
    got = {r.vec_id: r for r in embedding_dedup.report(
        spark.createDataFrame(data + odd, "vec_id long, embedding array<float>").repartition(3)).collect()}
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    assert [got[i].n_links for i in range(len(m))] == (near.sum(1) - 1).tolist()
    low = np.arange(len(m))
    for _ in range(20):
        low = np.array([low[near[i]].min() for i in range(len(m))])
    assert [got[i].component_id for i in range(len(m))] == low.tolist()
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i, _ in odd)
    assert embedding_dedup.report(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embedding_bound_loses_no_pair():
    """Pairs at the threshold, the code's worst case among them, always pass the bound."""
    rng = np.random.default_rng(11)
    for dim in (2, 3, 8, 64):
        a = embedding_dedup._units(rng.standard_normal((400, dim)))
        code, f = embedding_dedup.encode(a)
        away = embedding_dedup._units(a * f[:, None] - code)  # straight away from the code
        b = 0.9 * a + math.sqrt(1 - 0.81) * embedding_dedup._units(away - (away * a).sum(1, keepdims=True) * a)
        found = {tuple(x) for x in embedding_dedup.candidates(a, b, 0.9).tolist()}
        assert all((i, i) in found for i in range(400))


def test_embedding_dedup_finds_all_pairs_at_the_threshold(spark):
    """3000 separate pairs at cosine 0.9005, in several blocks: none is missed."""
    rng = np.random.default_rng(12)
    a = embedding_dedup._units(rng.standard_normal((3000, 64)))
    e = rng.standard_normal(a.shape)
    e = embedding_dedup._units(e - (e * a).sum(1, keepdims=True) * a)
    m = np.concatenate([a, 0.9005 * a + math.sqrt(1 - 0.9005 ** 2) * e])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.report(rows).collect()}
    assert got == {i: (1, i % 3000) for i in range(6000)}


def test_cached_encoding_equals_the_library():
    texts = ["Plain words, and more. Twice.. a,b. it's.", " lead  two   three\n\nfour \n five  six ", "", " ", "x", "Ünï ÉCOLE. ça va,",
             "é Éa. <|endoftext|> <|ENDOFTEXT|> A.", "tab\tand\r\nreturn .", "I'LL 'S don't. 12.5, 1,000."]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        e = Encoder(name, spaced)
        for _ in range(2):
            assert e.encode(texts) == [e.ids(t) for t in texts]
        rng = random.Random(1)
        odd = ["a", "Zé", "12", ".", ",", "###", "%%%", "'s", "'", "<|", "|>", "_", "e\u0301", "\u0301", "²", "ß", "-", "$", "\t", "\u3000", "漢", "…", "\""]
        mixed = [" ".join("".join(rng.choice(odd) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 30))) for _ in range(400)]
        assert e.encode(mixed) == [e.ids(t) for t in mixed]


def test_encoder_starting_afresh(monkeypatch):
    from vitae.llm import tokenizing
    rng = random.Random(2)
    texts = [prose(rng, 60) + "." for _ in range(80)]
    for most in (50, 400):
        monkeypatch.setattr(tokenizing, "PIECES", most)
        e = Encoder("byte_bpe_50k.json", True)
        for a in range(0, 80, 3):
            assert e.encode(texts[a:a + 3]) == [e.ids(t) for t in texts[a:a + 3]]
            assert len(e.known) <= 2 * most + 200


def test_token_output(docs, none, rows):
    got = token_output.report(docs.select("doc_id", "text")).collect()
    e = Encoder("word_bpe_49k.json", False)
    want = [(str(r[0]), len(b) // 4, zlib.crc32(b)) for r in rows for b in [e.ids(r[1] or "") + b"\x02\0\0\0"]]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    assert token_output.report(none.select("doc_id", "text")).count() == 0


def test_token_files_are_encoded_indexed_and_read_in_part(spark, tmp_path):
    import glob
    import pyarrow.parquet as pq
    rng = random.Random(7)
    texts = [(i, prose(rng, rng.randint(0, 300))) for i in range(3000)]
    path = token_output.write(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), f"{tmp_path}/t")
    kept = None
    for file in sorted(glob.glob(f"{path}/*.parquet")):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            columns = {(c := meta.row_group(g).column(k)).path_in_schema: c for k in range(meta.num_columns)}
            ids = columns["tokens.list.element"]
            assert "RLE_DICTIONARY" in ids.encodings or "PLAIN_DICTIONARY" in ids.encodings
            assert any("DELTA_BINARY_PACKED" in columns[n].encodings or "RLE_DICTIONARY" in columns[n].encodings
                       for n in ("doc_id", "part_start", "n_tokens"))
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
            assert meta.row_group(g).total_byte_size <= 2 * token_output.ROW_GROUP_BYTES
            kept = meta
    assert kept is not None
    n = {r.doc_id: r.n_tokens for r in token_output.counts(spark, path).collect()}
    e = Encoder("word_bpe_49k.json", False)
    want = {i: np.frombuffer(e.ids(t), "<u4").tolist() + [2] for i, t in texts}
    assert n == {i: len(x) for i, x in want.items()}
    some = token_output.documents(spark, path, 1200, 1260)
    assert {r.doc_id: list(r.tokens) for r in some.collect()} == {i: want[i] for i in range(1200, 1261)}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,1200)" in plan and "LessThanOrEqual(doc_id,1260)" in plan
    assert "tokens:array" not in token_output.counts(spark, path)._jdf.queryExecution().executedPlan().toString()


def test_packing(docs, none, rows):
    pieces = packing.pack(docs.select("doc_id", "text")).collect()
    e = Encoder("byte_bpe_50k.json", True)
    # every id of every row lies in exactly one piece: pieces of equal rows are told apart by their number
    have = collections.defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.length > 0
        have[p.doc_id].append((p.start, bytes(p.ids), p.doc_tokens))
    for i, times in collections.Counter(r[0] for r in rows).items():
        text = next(r[1] for r in rows if r[0] == i)
        whole = e.ids(text or "") + b"\x01\0\0\0"
        got = b"".join(b for _, b, _ in sorted(have.pop(i)))
        assert len(got) == times * len(whole)
        if times == 1:
            assert got == whole
    assert not have
    _gapless(pieces)
    joined = packing.sequences(packing.pack(docs.select("doc_id", "text"))).collect()
    assert all(len(r.ids) == 4 * r.length for r in joined) and len(joined) == len({p.sequence_id for p in pieces})
    assert packing.report(none.select("doc_id", "text")).count() == 0


def _gapless(pieces):
    used = collections.defaultdict(list)
    for p in pieces:
        used[p.sequence_id].append((p.offset, p.length))
    for v in used.values():
        total = 0
        for o, n in sorted(v):
            assert o == total
            total += n
        assert total <= 2048 and total & (total - 1) == 0


def test_packing_classes():
    """Pieces of a task against the rules: ids once, gapless, no padding, and each class's fixed count of whole documents."""
    rng = random.Random(6)
    for lengths in ([1], [2048], [2049], [1024, 1024], [700] * 20, [64] * 100, [1] * 5000, [2047, 1] * 30,
                    [rng.choice([1, 5, 60, 300, 1025, 1500, 2048, 5000, 9000]) for _ in range(900)], list(range(1, 700))):
        packer = packing.Packer(2)
        most = 0
        for i, n in enumerate(lengths):
            packer.add(i, np.arange(n, dtype="<u4").tobytes())
            most = max(most, packer.room)
        packer.finish()
        rows = packer.taken()
        place = collections.Counter()
        full = collections.defaultdict(list)
        for doc, start, length, total, seq, offset, ids in rows:
            assert total == lengths[doc] and np.frombuffer(ids, "<u4").tolist() == list(range(start, start + length))
            place.update((doc, start + k) for k in range(length))
            full[seq].append((offset, length, doc))
            assert seq >> 32 == 2
        assert set(place.values()) == {1} and len(place) == sum(lengths)
        sizes = [sum(n for _, n, _ in v) for v in full.values()]
        assert all(s == 2048 or s & (s - 1) == 0 for s in sizes) and sum(s < 2048 for s in sizes) <= 11 and most < 2 * 2048
        for v in full.values():
            assert [o for o, _, _ in sorted(v)] == list(np.cumsum([0, *[n for _, n, _ in sorted(v)]])[:-1])
    packer = packing.Packer(0)
    for i in range(30):
        packer.add(i, bytes(4 * 600))  # class 3: three whole documents, then the room of 248 is filled
    rows = packer.taken()
    by = collections.defaultdict(list)
    for doc, start, length, *_ , seq, offset, _ids in rows:
        by[seq].append((offset, length))
    assert by and all(sorted(v)[:3] == [(0, 600), (600, 600), (1200, 600)] for v in by.values())


def test_lm_score_equals_plain_loops(spark):
    """The score of each document from one position at a time: attention over its window, counts from dictionaries."""
    L = lm_scoring
    rng = random.Random(12)
    texts = [(i, prose(rng, n)) for i, n in enumerate([0, 1, 3, 15, 16, 17, 40, 90, 33, 12, 60, 25])]
    texts += [(i + 20, t) for i, t in texts[5:9]]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    vocabulary, end = 50257, 50256
    got = {r.doc_id: r.score for r in L.score(docs).collect()}
    staged = blocks.stage(docs, "lm", 8 << 20, L.subwords("byte_bpe_50k.json", end)).withColumn("train", ~L.held_out("doc_id", 10, 0))
    c, w = L.fit(staged, vocabulary, end)
    c = c.value
    w = {k: v.astype(float) for k, v in w.items()}
    ids = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in staged.select("doc_id", "ids").collect()}
    train = {r.doc_id for r in staged.where("train").select("doc_id").collect()}
    assert 0 < len(train) < len(ids)
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for i in train:
        lead = ["^", "^", *ids[i]]
        for a, b, x in zip(lead, lead[1:], lead[2:]):
            one[b] += 1
            two[b, x] += 1
            three[a, b, x] += 1
    pair = collections.Counter()
    for (a, b, _), n in three.items():
        pair[a, b] += n

    def model(seq, t):
        """P(id t | the ids before it in its window)."""
        j, start = t // L.STEP, c.start
        before = [start, *[int(c.symbol[x]) for x in seq]]  # symbol before each target
        lo = (j - 1) * L.STEP
        places = [(p, before[lo + p]) for p in range(t - lo + 1) if lo + p >= 0]
        x = {p: w["emb"][s] + w["pos"][p] for p, s in places}
        q = x[t - lo] @ w["q"]
        a = np.array([np.exp(min(q @ (x[p] @ w["k"]) / math.sqrt(L.WIDTH), 60)) for p in x])
        z = sum(share * (x[p] @ w["v"]) for share, p in zip(a / a.sum(), x))
        h = z @ w["o"] + x[t - lo] @ w["r"]
        logits = np.clip(h @ w["u"].T, -80, 80)
        last = dict(places)
        row = c.row[last.get(t - lo - 1, L.PAD), last[t - lo]]
        s = int(c.symbol[seq[t]])
        return (math.exp(c.ln_next(np.array([row]), np.array([s]))[0] + logits[c.cls[s]]) / float(np.exp(logits) @ c.p_class[row]) * math.exp(c.ln_rest[seq[t]]))

    for i, seq in ids.items():
        total, lead = 0.0, ["^", "^", *seq]
        for t, (a, b, x) in enumerate(zip(lead, lead[1:], lead[2:])):
            p = model(seq, t)
            k = (two[b, x] + L.DEPTH * p) / (one[b] + L.DEPTH)
            k = (three[a, b, x] + L.DEPTH * k) / (pair[a, b] + L.DEPTH)
            total += math.log10(L.SHARE * p + (1 - L.SHARE) * k)
        assert math.isclose(total, got[i], rel_tol=1e-3, abs_tol=1e-3), (i, total, got[i])


def test_lm_scoring(docs, none, rows):
    got = lm_scoring.score(docs.select("doc_id", "text")).collect()
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    words = [(r[0], [*WORD.findall((r[1] or "").translate(low)), None]) for r in rows]
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    c = collections.Counter(w for i, t in words if train(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), not train(i), len(t), sum(c[w] > 0 for w in t), n,
                   round(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for i, t in words)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                  for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_scoring.score(none.select("doc_id", "text")).count() == 0


def test_lm_is_a_distribution_and_learns():
    rng = np.random.default_rng(7)
    ids = [np.r_[rng.permutation(np.repeat(rng.choice(60, 3), 20)), 99] for _ in range(300)]
    c = lm_scoring.Counts(np.bincount(np.concatenate(ids), minlength=100).astype(float), 99)
    n = lm_scoring.HEAD + 1
    c.set_bigrams(np.ones(n * n))
    c.set_trigrams(np.zeros(len(c.pairs) * n, np.int64))
    w = {k: x + np.float32(0.1) for k, x in lm_scoring.initial().items()}
    every = [np.array([i], np.int64) for i in range(100)]
    total = (10 ** lm_scoring.model_scores(w, c, every)).sum()
    assert 0.05 < total <= 1.0001  # the rest lies on symbols no id of this small vocabulary has
    w = lm_scoring.initial()
    x, y, _ = lm_scoring.windows([c.symbol[i] for i in ids], c.start)
    before, _ = lm_scoring.gradient(w, c, x, y)
    for seed in range(3):
        w = lm_scoring.learn(w, c, x, y, seed)
    assert lm_scoring.gradient(w, c, x, y)[0] < before - 0.5


def test_lm_counts_every_pair_of_whole_ids(spark):
    """What follows a pair of ids that are no symbols is known, however many pairs are more frequent."""
    rng = np.random.default_rng(8)
    rare = [np.r_[3000, 3001, 3002, 99]] * 2  # behind 1999 more frequent ids: all three share one symbol
    ids = rare + [np.r_[np.arange(100, 2099), np.arange(100, 2099), 99]] * 2 + [np.r_[rng.integers(0, 4000, 50), 99]]
    c = lm_scoring.Counts(np.bincount(np.concatenate(ids), minlength=4000).astype(float), 99)
    assert {c.symbol[3000], c.symbol[3001], c.symbol[3002]} == {lm_scoring.HEAD}
    c.set_bigrams(np.ones((lm_scoring.HEAD + 1) ** 2))
    c.set_trigrams(np.zeros(len(c.pairs) * (lm_scoring.HEAD + 1), np.int64))
    c.times = np.r_[c.unigrams, len(ids)]
    c.times[99] -= len(ids)
    known, times = lm_scoring.Grams(ids, 4000).counted(np.ones(len(ids), bool))
    want = collections.Counter()
    for x in ids:
        e = [4000, 4000, *x[:-1].tolist(), 4001]
        want.update(4002 ** 3 + a * 4002 + b for a, b in zip(e, e[1:]))
        want.update((a * 4002 + b) * 4002 + d for a, b, d in zip(e, e[1:], e[2:]))
    assert dict(zip(known.tolist(), times.tolist())) == want
    w = lm_scoring.initial()

    def score(x):
        return lm_scoring.gram_scores(lm_scoring.model_logs(w, c, [x]), c, lm_scoring.Grams([x], 4000), known, times, 1)[0]

    seen, turned = rare[0], np.r_[3001, 3000, 3002, 99]
    assert score(seen) > score(turned) + 0.5
    assert abs(lm_scoring.model_scores(w, c, [seen]) - lm_scoring.model_scores(w, c, [turned]))[0] < 1e-4


@pytest.mark.parametrize("flush", [7, 50_000])
def test_lm_trains_on_all_windows(spark, monkeypatch, flush):
    """Every id of a long text is a target of the training, with the ids before it, in each round."""
    seen = []

    class Here:  # the rows' function runs in this process
        def __init__(self, rows):
            self.rows, self.sparkSession = rows, spark

        def where(self, _):
            return self

        def select(self, *_):
            return self

        def count(self):
            return len(self.rows)

        def mapInArrow(self, fn, _):
            return list(fn([pa.RecordBatch.from_arrays([pa.array([r.astype("<u2").tobytes() for r in self.rows], pa.binary())], ["ids"])]))

    def summed(batches, kind, size):
        wide = np.float64 if kind is np.float64 else np.int64
        return sum(np.frombuffer(b"".join(x.column(1).to_pylist()), kind).astype(wide) for x in batches)

    def counted(batches, size, kind=np.int64):
        total = np.zeros(size, kind)
        for x in batches:
            np.add.at(total, x.column(0).to_numpy(), x.column(1).to_numpy().astype(kind))
        return total

    monkeypatch.setattr(lm_scoring.blocks, "summed", summed)
    monkeypatch.setattr(lm_scoring.blocks, "counted", counted)
    monkeypatch.setattr(lm_scoring, "FLUSH", flush, raising=False)
    monkeypatch.setattr(lm_scoring, "CONTEXTS", 64)
    monkeypatch.setattr(lm_scoring, "learn", lambda w, c, x, y, seed: seen.append((x, y)) or w)
    rng = np.random.default_rng(10)
    ids = [np.r_[rng.integers(0, 99, n), 99] for n in (400, 5, 31, 0)]
    counts = lm_scoring.fit(Here(ids), 100, 99)[0].value
    want = [lm_scoring.windows([counts.symbol[x] for x in ids], counts.start)[:2]] * lm_scoring.ROUNDS
    assert all(len(x) <= flush for x, _ in seen)
    for k in (0, 1):
        assert np.concatenate([s[k] for s in seen]).tolist() == np.concatenate([w[k] for w in want]).tolist()


def test_grams_are_a_distribution():
    rng = np.random.default_rng(9)
    p = rng.dirichlet(np.ones(50))
    pair, triple = rng.integers(0, 5, 50), rng.integers(0, 3, 50)
    whole = lm_scoring.gram_probability(p, np.full(50, pair.sum()), pair, np.full(50, triple.sum()), triple)
    assert abs(whole.sum() - 1) < 1e-12 and (whole > 0).all()


def test_sums_over_tasks(spark):
    def one(batches):
        n = np.zeros(40_000, np.int64)
        for b in batches:
            n += np.bincount(b.column(0).to_numpy(), minlength=40_000)
        yield blocks.chunks(n)
    got = blocks.summed(spark.range(0, 30_000, 1, 5).mapInArrow(one, blocks.SUMS), np.int64, 40_000)
    assert got.tolist() == [1] * 30_000 + [0] * 10_000
