"""MinHash near-dedup: consistent weighted samples of TF-IDF shingles, banded, verified.

A text's shingles are its runs of five words (a shorter text is one shingle).
A shingle weighs its count times 1 + IDF_SHARE * ln((1+N)/(1+df)) / ln(1+N),
with df counted over all documents in hashed cells; the share keeps a group of
copies from making its own shingles light. Improved consistent weighted
sampling (Ioffe, 2010) draws HASHES samples whose chance to agree is the
weighted Jaccard similarity; BANDS bands of them make the candidates.

Equal texts count as one node. In each bucket every node is compared with
HEADS nodes of that bucket drawn by hash (all of a small bucket). A comparison
first asks that AGREE of the samples agree, which a pair exactly at the
threshold fails with a chance of 0.4 %; a pair links if its weighted Jaccard
similarity, computed from the texts, is at least the threshold.

Nodes of one bucket that are then still in different classes get MORE further
samples, and all their pairs are met in blocks of PART by PART nodes, each
block in a call of its own. There, too, only pairs of which ALL_AGREE of all samples agree are
compared by their texts (five standard deviations below what a pair exactly at the
threshold has: missed with a chance of 0.0001 %, by all 16 bands with 0.02 %), each in the first band it shares,
and not those whose classes links of the block have already joined. Only links leave a block, less than its nodes.

Defined cases: a null or empty text has no shingles and is a class of its own;
equal texts share a class; texts of any length are read whole; repeated rows
and ids are rows of one class, and exactly one row of a class is kept, that
with the smallest id (null before all); an empty table gives no rows; other
columns pass through ``deduplicate``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitae.llm import blocks
from vitae.llm.components import components
from vitae.llm.words import Texts, WordHash, mix, mix_int, released, slices, texts_of
from vitae.session import materialize

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
HASHES = BANDS * ROWS
#: Samples that must agree before two nodes of different classes are compared by their texts.
AGREE = 43
#: Nodes of a bucket, drawn by hash, that all its nodes are compared with.
HEADS = 8
#: Further samples of the nodes that the heads left open, and how many of all samples must agree there.
MORE, ALL_AGREE = 256, 220
#: Nodes on one side of a block of pairs, and bytes of their texts.
PART, PART_BYTES = 512, 16 << 20
CELL_BITS = 20
IDF_SHARE = 0.25
_HASH = WordHash(seed=606)
_U = np.uint64
_SEEDS = np.array([mix_int(1000 + j) | 1 for j in range(HASHES + MORE)], _U)


def _gamma2(n: int) -> np.ndarray:
    """Mid-quantiles of the Gamma(2, 1) distribution."""
    x = np.concatenate([np.geomspace(1e-5, 1e-2, 4000), np.linspace(1e-2, 40, 400_000)])
    return np.interp((np.arange(n) + 0.5) / n, 1 - np.exp(-x) * (1 + x), x)


class _Draws:
    """Tables for the random variables of one (shingle, sample)."""
    made = None

    def __init__(self):
        r = _gamma2(1 << 12)
        self.r, self.inv_r = r.astype(np.float32), (1 / r).astype(np.float32)
        self.ln_c = np.log(_gamma2(1 << 16)).astype(np.float32)


def _draws() -> _Draws:
    if _Draws.made is None:
        _Draws.made = _Draws()
    return _Draws.made


def shingles(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row of each document, hash, count): the distinct shingles, by document, then hash."""
    words = _HASH(t.buf, t.starts, t.ends)
    n = t.n_words
    acc = words.copy()
    mult = _U(0x9E3779B97F4A7C15)
    for k in range(1, SHINGLE):
        acc[:-k or None] *= mult
        acc[:-k or None] += words[k:]
    at = np.arange(len(words)) - np.repeat(t.first[:-1], n)
    size = np.repeat(n, n)
    whole = size < SHINGLE
    if whole.any():  # short texts: one shingle of all their words
        for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
            h = 0
            for w in words[t.first[i]:t.first[i + 1]].tolist():
                h = (h * int(mult) + w) & (2**64 - 1)
            acc[t.first[i]] = h
    use = (at <= size - SHINGLE) | (whole & (at == 0))
    h = mix(acc[use])
    first = np.r_[0, np.cumsum(np.where(n < SHINGLE, np.minimum(n, 1), n - SHINGLE + 1))]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        h[a:b].sort()
    new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    new[first[:-1][np.diff(first) > 0]] = True
    keep = np.flatnonzero(new)
    count = np.diff(np.r_[keep, len(h)])
    return np.searchsorted(keep, first), h[keep], count


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - CELL_BITS)).astype(np.int64)


def samples(first: np.ndarray, h: np.ndarray, ln_weight: np.ndarray,
            seeds: np.ndarray = _SEEDS[:HASHES]) -> np.ndarray:
    """A 32-bit sample of each document for each seed (rows without shingles are zero)."""
    out = np.zeros((len(first) - 1, len(seeds)), np.uint32)
    filled = np.flatnonzero(np.diff(first) > 0)
    d = _draws()
    i = 0
    while i < len(filled):  # documents with about 2**14 shingles in all, so that the arrays stay in cache
        j = i + 1
        lo = first[filled[i]]
        while j < len(filled) and first[filled[j] + 1] - lo <= 1 << 14:
            j += 1
        docs = filled[i:j]
        hi = first[docs[-1] + 1]
        x, lw, starts = h[lo:hi], ln_weight[lo:hi], first[docs] - lo
        n = len(x)
        u, v, key = (np.empty(n, _U) for _ in range(3))
        low, marks = (y.view(np.uint32)[::2] for y in (u, v))
        r, t, beta, z = (np.empty(n, np.float32) for _ in range(4))
        bits = z.view(np.uint32)
        for k, seed in enumerate(seeds):
            np.bitwise_xor(x, seed, out=u)
            u *= _U(0xD6E8FEB86659FD93)
            u ^= np.right_shift(u, _U(32), out=v)
            u *= seed
            u ^= np.right_shift(u, _U(29), out=v)
            np.right_shift(low, np.uint32(12), out=bits)
            np.multiply(bits, np.float32(2.0**-20), out=beta, dtype=np.float32, casting="unsafe")
            ri = np.bitwise_and(u, _U(0xFFF), out=v).view(np.int64)
            np.take(d.inv_r, ri, out=t, mode="clip")
            np.take(d.r, ri, out=r, mode="clip")
            t *= lw
            t += beta
            np.floor(t, out=t)
            np.subtract(t, beta, out=beta)
            beta += np.float32(1)
            r *= beta
            np.take(d.ln_c, np.right_shift(u, _U(48), out=v).view(np.int64), out=z, mode="clip")
            z -= r
            bits ^= (bits.view(np.int32) >> 31).view(np.uint32) | np.uint32(0x80000000)
            np.copyto(key, bits)
            key <<= _U(32)
            np.right_shift(u, _U(20), out=v)
            key |= marks ^ (t.astype(np.int32).view(np.uint32) * np.uint32(2654435761))
            out[docs, k] = np.minimum.reduceat(key, starts).astype(np.uint32)
        i = j
    return out


def cell_weights(staged: DataFrame) -> np.ndarray:
    """ln of the idf factor of every cell, from the document frequencies over all documents.

    Each task counts into a fixed number of cells; the counts of a chunk of
    cells are summed as they stream into a task.
    """
    size = 1 << CELL_BITS

    def count(batches):
        df = np.zeros(size, np.int64)
        docs = 0
        for batch in batches:
            for part in slices(batch, "text"):
                first, h, _ = shingles(texts_of(part.column(0)))
                docs += part.num_rows
                cell = _cells(h)  # ascending in each document
                new = np.r_[True, cell[1:] != cell[:-1]] if len(cell) else np.zeros(0, bool)
                new[first[:-1][np.diff(first) > 0]] = True
                df += np.bincount(cell[new], minlength=size)
        yield blocks.chunks(np.r_[df, docs])

    got = blocks.summed(staged.select("text").mapInArrow(released(count), blocks.SUMS), np.int64, size + 1)
    df, n = got[:size].astype(float), max(int(got[size]), 1)
    return np.log(1 + IDF_SHARE * np.maximum(np.log((1 + n) / (1 + df)), 0) / np.log(1 + n)).astype(np.float32)


def _lists(sig: np.ndarray) -> pa.ListArray:
    n, width = sig.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width),
                                    pa.array(sig.view(np.int32).ravel()))


def _signatures(staged: DataFrame, weights) -> DataFrame:
    def sign(batches):
        table = weights.value
        for batch in batches:
            for part in slices(batch, "text"):
                text = part.column(2)
                t = texts_of(text)
                first, h, n = shingles(t)
                sig = samples(first, h, np.log(n).astype(np.float32) + table[_cells(h)])
                raw, o = t.buf.tobytes(), t.offsets.tolist()
                key = [hashlib.md5(raw[a:b]).digest() for a, b in zip(o[:-1], o[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3), pa.array(key, pa.binary()),
                     _lists(sig), pa.array(np.diff(first) > 0)], ["block", "doc_id", "row", "key", "sig", "filled"])

    return staged.mapInArrow(released(sign), "block long, doc_id long, row long, key binary, sig array<int>, filled boolean")


def _verified(staged: DataFrame, pairs: DataFrame, weights, threshold: float) -> DataFrame:
    """The pairs (a, b, block_a, block_b) whose texts' weighted Jaccard similarity reaches the threshold."""
    wanted = pairs.select(F.col("a").alias("row"), F.col("block_a").alias("block")).unionByName(
        pairs.select(F.col("b").alias("row"), F.col("block_b").alias("block"))).distinct()

    def pick(docs: pa.Table, keys: pa.Table) -> pa.Table:
        return docs.filter(pc.is_in(docs["row"], keys["row"])).select(["row", "text"])

    texts = materialize(blocks.with_keys(staged, wanted, pick, "row long, text string"), "near-texts")
    both = (pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")
            .select("a", "b", "text_a", "text_b"))

    def compare(batches):
        table = weights.value
        last: dict[int, tuple] = {}

        def vector(row, text):
            if row not in last:
                if len(last) > 16:
                    last.clear()
                _, h, n = shingles(texts_of(pa.array([text])))
                last[row] = h, n * np.exp(table[_cells(h)])
            return last[row]

        for batch in batches:
            ok = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns)):
                ok.append(_similar(*vector(a, ta), *vector(b, tb), threshold))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return materialize(both.mapInArrow(released(compare), "a long, b long"), "near-links")


def _linked(staged: DataFrame, pairs: DataFrame, weights, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(links, classes of their nodes) with ``pairs`` verified, those that could change no class left out.

    First each node's pair with the smallest other node is compared, then what
    still joins different classes: a group of copies costs about one comparison a node.
    """
    first = materialize(pairs.groupBy("b").agg(F.min(F.struct("a", "block_a", "block_b")).alias("x"))
                        .select("x.a", "b", "x.block_a", "x.block_b"), "near-first")
    links = _verified(staged, first, weights, threshold)
    comp = materialize(components(links), "near-components")
    of = [comp.select(F.col("node").alias(n), F.col("comp").alias(f"comp_{n}")) for n in "ab"]
    rest = (pairs.join(first.select("a", "b"), ["a", "b"], "left_anti").join(of[0], "a", "left").join(of[1], "b", "left")
            .where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b", "block_a", "block_b"))
    rest = materialize(rest, "near-rest")
    if not rest.isEmpty():
        links = links.unionByName(_verified(staged, rest, weights, threshold))
        comp = materialize(components(links), "near-components")
    return links, comp


def _further(staged: DataFrame, wanted: DataFrame, weights) -> DataFrame:
    """(node, more, text): the further samples of the rows of ``wanted`` (row, block), and their texts."""
    def sign(docs: pa.Table, keys: pa.Table) -> pa.Table:
        table = weights.value
        docs = docs.filter(pc.is_in(docs["row"], keys["row"])).select(["row", "text"]).combine_chunks()
        out = [np.zeros((0, MORE), np.uint32)]
        for batch in docs.to_batches():
            for part in slices(batch, "text"):
                first, h, n = shingles(texts_of(part.column(1)))
                out.append(samples(first, h, np.log(n).astype(np.float32) + table[_cells(h)], _SEEDS[HASHES:]))
        return pa.table({"node": docs["row"], "more": _lists(np.concatenate(out)), "text": docs["text"]})

    return blocks.with_keys(staged, wanted, sign, "node long, more array<int>, text string")


def _meet(rows: pa.Table) -> pa.Table:
    """The pairs of a block's two parts that are in different classes and whose samples agree."""
    rows = rows.combine_chunks()
    p, q, band = (rows[c][0].as_py() for c in ("p", "q", "band"))
    node, block, comp, side = (rows[c].to_numpy() for c in ("node", "block", "comp", "side"))
    sig = rows["sig"].chunk(0).flatten().to_numpy().reshape(len(node), HASHES + MORE)
    a, b = np.flatnonzero(side == p), np.flatnonzero(side == q)
    left, right = np.ascontiguousarray(sig[a].T), np.ascontiguousarray(sig[b].T)
    same = np.zeros((len(a), len(b)), np.int16)
    for x, y in zip(left, right):
        same += x[:, None] == y[None, :]
    i, j = np.nonzero((same >= ALL_AGREE) & (comp[a][:, None] != comp[b][None, :]))
    i, j = a[i], b[j]
    if p == q:
        i, j = i[i < j], j[i < j]
    bands = (sig[i, :HASHES] == sig[j, :HASHES]).reshape(-1, BANDS, ROWS).all(2)
    once = bands.any(1) & (bands.argmax(1) == band)  # each pair leaves one bucket only
    i, j = i[once], j[once]
    low, high = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
    return pa.table({"a": node[low], "b": node[high], "block_a": block[low], "block_b": block[high]})


def _joining(weights, threshold: float):
    """Function from a block's two parts to the links that join classes of their nodes.

    The pairs of ``_meet`` are compared by their texts, but for those that links
    found before in the block have joined: a block gives less links than it has nodes.
    """
    def join(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        pairs = _meet(rows)
        node = rows["node"].to_numpy()
        at = np.argsort(node)
        x, y = (at[np.searchsorted(node[at], pairs[c].to_numpy())].tolist() for c in "ab")
        comp, table = rows["comp"].to_pylist(), weights.value
        vectors: dict[int, tuple] = {}
        up: dict[int, int] = {}
        found = []

        def root(c: int) -> int:
            while c in up:
                c = up[c]
            return c

        def vector(k: int) -> tuple:
            if k not in vectors:
                _, h, n = shingles(texts_of(rows["text"].chunk(0).slice(k, 1)))
                vectors[k] = h, n * np.exp(table[_cells(h)])
            return vectors[k]

        for k, (i, j) in enumerate(zip(x, y)):
            c, d = root(comp[i]), root(comp[j])
            if c != d and _similar(*vector(i), *vector(j), threshold):
                up[max(c, d)] = min(c, d)
                found.append(k)
        return pairs.select(["a", "b"]).take(pa.array(found, pa.int64()))
    return join


def _similar(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray, threshold: float) -> bool:
    """Whether the weighted Jaccard similarity of two texts' shingles reaches the threshold."""
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    common = np.minimum(wa[i], wb[j]).sum()
    return common >= threshold * (wa.sum() + wb.sum() - common) - 1e-9


def _agreeing(one: str, other: str):
    """How many of two nodes' samples agree."""
    return F.size(F.filter(F.zip_with(one, other, lambda x, y: x == y), lambda x: x))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """row, block, doc_id, class_row, class_id, kept of every row of ``docs``, with ``staged`` rows' numbers."""
    spark = docs.sparkSession
    return _classes(blocks.stage(docs, "near"), spark, threshold)


def _classes(staged: DataFrame, spark, threshold: float) -> DataFrame:
    weights = spark.sparkContext.broadcast(cell_weights(staged))
    signed = materialize(_signatures(staged, weights), "near-signatures")
    nodes = materialize(signed.where("filled").groupBy("key").agg(F.min_by(F.struct("row", "block", "sig"), "row").alias("x"))
                        .select("key", F.col("x.row").alias("node"), F.col("x.block").alias("block"),
                                F.col("x.sig").alias("sig")), "near-nodes")
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                                    lambda k: F.xxhash64(F.slice("sig", k * ROWS + 1, ROWS), k)))
    narrow = nodes.select("node", band.alias("band", "bucket"))
    sizes = narrow.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    narrow = narrow.join(sizes.select("bucket"), "bucket", "left_semi")
    # samples follow only to the buckets that two nodes share
    banded = materialize(narrow.join(nodes.select("node", "block", "sig"), "node"), "near-banded")
    heads = materialize(banded.groupBy("bucket").agg(F.array(*[
        F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("x"), F.col("node"), F.col("block"), F.col("sig")))
        for k in range(HEADS)]).alias("heads")), "near-heads")
    met = banded.join(heads, "bucket").select("node", "block", "sig", F.explode(F.array_distinct(F.transform(
        "heads", lambda x: F.struct(x["node"].alias("node"), x["block"].alias("block"), x["sig"].alias("sig"))))).alias("h"))
    met = met.where("node != h.node").where(_agreeing("sig", "h.sig") >= AGREE)
    first = F.col("node") < F.col("h.node")
    pairs = materialize(met.select(
        F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b"),
        F.when(first, F.col("block")).otherwise(F.col("h.block")).alias("block_a"),
        F.when(first, F.col("h.block")).otherwise(F.col("block")).alias("block_b")).distinct(), "near-pairs")
    links, comp = _linked(staged, pairs, weights, threshold)

    placed = banded.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = materialize(placed.groupBy("bucket").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"))
                        .where("c1 != c2").select("bucket"), "near-mixed")
    open_ = materialize(placed.join(mixed, "bucket"), "near-open")
    further = materialize(_further(staged, open_.select(F.col("node").alias("row"), "block").distinct(), weights),
                          "near-further")
    # a part is bounded in nodes and in bytes of text
    parts = open_.select("node", "bucket").join(further.select("node", F.octet_length("text").alias("size")), "node").groupBy(
        "bucket").agg(F.ceil(F.greatest(F.count(F.lit(1)) / PART, F.sum("size") / PART_BYTES)).cast("int").alias("parts"))
    spread = (open_.join(further, "node").join(materialize(parts, "near-parts"), "bucket")
              .withColumn("sig", F.concat("sig", "more"))
              .withColumn("side", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select("bucket", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"),
                      "side", "band", "node", "block", "comp", "sig", "text"))
    more = materialize(spread.groupBy("bucket", "p", "q").applyInArrow(_joining(weights, threshold), "a long, b long"),
                       "near-more")
    if not more.isEmpty():
        comp = materialize(components(links.unionByName(more)), "near-components")

    of_key = nodes.join(comp, "node", "left").select("key", F.coalesce("comp", "node").alias("comp"))
    of_key = materialize(of_key, "near-keys")
    rows = signed.select("row", "block", "doc_id", F.when(F.col("filled"), F.col("key")).alias("key")).join(
        of_key, "key", "left").withColumn("comp", F.coalesce("comp", "row"))
    rows = materialize(rows.select("row", "block", "doc_id", "comp"), "near-rows")
    best = materialize(rows.groupBy("comp").agg(F.min(F.struct("doc_id", "row")).alias("best")), "near-best")
    return rows.join(best, "comp").select("row", "block", "doc_id", F.col("best.doc_id").alias("class_id"),
                                          (F.col("best.row") == F.col("row")).alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest id of its class), kept of every row."""
    return classes(docs.select("doc_id", "text")).select("doc_id", "class_id", "kept")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The row of each class with the smallest id (null before all), with the columns of ``docs``."""
    # the row as one column, out of the way of the names used here
    numbered = materialize(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"),
                                       F.monotonically_increasing_id().alias("row")), "near-docs")
    placed = classes(numbered.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), threshold).select(
        F.col("doc_id").alias("row"), "class_id")
    ids = numbered.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"))
    kept = ids.join(placed, "row").groupBy("class_id").agg(F.min(F.struct("doc_id", "row")).alias("best")).select(
        F.col("best.row").alias("row"))
    return numbered.join(materialize(kept, "near-kept"), "row", "left_semi").select("doc.*")
