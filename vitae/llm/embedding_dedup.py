"""Embedding near-dedup: randomised-rotation binary codes decide what needs an exact cosine.

Unit vectors are rotated at random and kept as one sign bit per dimension with
the code's cosine f with its vector (Gao & Long, RaBitQ, 2024). For a unit
vector b at cosine s with the code of a, the angle of a and b is at least the
difference of their angles with the code, so

    <a, b> <= f * s + sqrt((1 - f^2) (1 - s^2))    (1 where s > f).

Only pairs whose bound reaches the threshold are recomputed, in double precision
from the stored vectors. The bound is proven, so no pair is lost.

Every vector is compared with every vector of its length. The vectors lie in
blocks of about ``BLOCK`` bytes, one row each, stored once, and every pair of blocks
is compared in one call: work grows with the square of the number of
vectors, what is written with their number. The pairs of blocks are a cartesian
product of the stored table with itself, whose tasks read both sides from it; no
table of pairs is made and no block is shuffled. A task keeps a part of the blocks
in memory, of at most as many bytes as one task reads of a file.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; equal vectors link with each other and are
compared once; vectors of different lengths never link; repeated ids count as
separate vectors and share a result row each; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitae.llm.components import components
from vitae.session import materialize

THRESHOLD = 0.9
#: Bytes of the vectors of one block at most; few vectors are dealt to about BLOCKS blocks, of PART vectors at least.
BLOCK, BLOCKS, PART = 4 << 20, 16, 2048
#: Rows and columns compared at once, and the linked pairs after which they are folded into components.
TILE, FOLD = (512, 2048), 1 << 19
#: More than what single precision can be wrong by in a bound.
ROUNDING = 1e-4
_EDGES = "node long, links long, root long"


def _rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _units(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def encode(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs as -1/+1 over the root of the dimension, cosine of each code with its vector)."""
    code = np.where(rotated >= 0, 1.0, -1.0) / math.sqrt(rotated.shape[1])
    return code, (code * rotated).sum(1)


def least_cosines(f: np.ndarray, threshold: float) -> np.ndarray:
    """For codes at cosine ``f`` with their vectors: where the bound of a pair reaches the threshold, from which cosine on."""
    # The bound reaches the threshold exactly where the angle with the code is at most the sum of both angles.
    most = np.arccos(np.minimum(f, 1)) + math.acos(min(threshold, 1))
    return (np.where(most < math.pi, np.cos(most), -2.0) - ROUNDING).astype(np.float32)


def _reached(code: np.ndarray, least: np.ndarray, rotated_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = code @ rotated_b.T
    return np.divmod(np.flatnonzero(s >= least[:, None]), s.shape[1])


def candidates(rotated_a: np.ndarray, rotated_b: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs (i, j) whose inner product's upper bound, worked out from the code of i, reaches the threshold."""
    code, f = encode(rotated_a)
    return np.stack(_reached(code.astype(np.float32), least_cosines(f, threshold), rotated_b.astype(np.float32)), 1)


def folded(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label``, the smallest place known to be linked with each place, after the links (i, j) too."""
    a, b = label[i], label[j]
    while len(a):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            over = label[label]
            if (over == label).all():
                break
            label = over
        a, b = label[a], label[b]
        on = a != b
        a, b = a[on], b[on]
    return label


def linked(unit_a: np.ndarray, unit_b: np.ndarray, same: bool, threshold: float):
    """Arrays (i, j) of the pairs of both sides at the threshold, some at a time; with ``same`` those with i < j."""
    rotation = _rotation(unit_a.shape[1])
    code, f = encode(unit_a @ rotation)
    code, least = code.astype(np.float32), least_cosines(f, threshold)
    turned = (unit_b @ rotation).astype(np.float32)
    rows, columns = TILE
    for x in range(0, len(code), rows):
        for y in range(x // columns * columns if same else 0, len(turned), columns):
            i, j = _reached(code[x:x + rows], least[x:x + rows], turned[y:y + columns])
            i, j = i + x, j + y
            if same:
                on = i < j
                i, j = i[on], j[on]
            for c in range(0, len(i), 8192):
                ii, jj = i[c:c + 8192], j[c:c + 8192]
                ok = np.einsum("ij,ij->i", unit_a[ii], unit_b[jj]) >= threshold
                if ok.any():
                    yield ii[ok], jj[ok]


def _compare(threshold: float):
    def block(row, k):
        node, weight = (np.frombuffer(row[f"{c}_{k}"].as_buffer(), np.int64) for c in ("node", "copies"))
        values = np.frombuffer(row[f"vectors_{k}"].as_buffer(), row["kind"].as_py())
        return node, weight, _units(values.reshape(len(node), -1))

    def compare(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(k)[at] for k, n in enumerate(batch.schema.names)}
                same = row["p"].as_py() == row["q"].as_py()
                node, weight, unit = block(row, "p")
                other, low = unit, 0
                if not same:
                    low = len(node)
                    node_q, weight_q, other = block(row, "q")
                    node, weight = np.r_[node, node_q], np.r_[weight, weight_q]
                order = np.argsort(node)
                rank = np.empty(len(node), np.int64)
                rank[order] = np.arange(len(node))
                links, label, held, pairs = np.zeros(len(node)), np.arange(len(node)), 0, []
                for i, j in linked(unit, other, same, threshold):
                    j = j + low
                    links += np.bincount(i, weight[j], len(node)) + np.bincount(j, weight[i], len(node))
                    i, j = rank[i], rank[j]
                    pairs.append((i, j))
                    held += len(i)
                    if held >= FOLD:
                        label, held, pairs = folded(label, *map(np.concatenate, zip(*pairs))), 0, []
                if pairs:
                    label = folded(label, *map(np.concatenate, zip(*pairs)))
                on = links > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[on]), pa.array(links[on].astype(np.int64)), pa.array(node[order[label[rank[on]]]])],
                    ["node", "links", "root"])
    return compare


def _packed(kind: str, vectors: int):
    """Rows (vector, node, copies) to blocks: vectors of one length as bytes, about as many as ``vectors``, in rows as they come."""
    def block(dim: int, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), *[pa.array([b"".join(x)], pa.binary()) for x in zip(*rows)]],
            ["dim", "vectors", "node", "copies"])

    def pack(batches):
        held: dict = {}  # by length: (vectors, their rows)
        total = 0  # bytes
        for batch in batches:
            column = batch.column(0)
            size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                width = int(dim) * np.dtype(kind).itemsize
                most = max(1, min(vectors, BLOCK // width))
                for a in range(0, len(at), most):
                    some = batch.take(pa.array(at[a:a + most]))
                    n, rows = held.get(int(dim), (0, []))
                    if n + len(some) > most:
                        yield block(int(dim), held.pop(int(dim))[1])
                        total -= n * width
                        n, rows = 0, []
                    rows.append((some.column(0).flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes(),
                                 *[some.column(k).to_numpy().astype(np.int64).tobytes() for k in (1, 2)]))
                    held[int(dim)] = (n + len(some), rows)
                    total += len(some) * width
            if total > 8 * BLOCK:  # vectors of very many lengths
                for dim in list(held):
                    yield block(dim, held.pop(dim)[1])
                total = 0
        for dim, (_, rows) in held.items():
            yield block(dim, rows)
    return pack


def links(vectors: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(rows, found): every row of ``vectors`` with its node, and what each node links to.

    A node is a distinct usable vector, numbered by its smallest row. rows:
    vec_id, node (null if unusable), copies. found: node, links (rows of other
    nodes linked directly), root (a smaller or equal node reachable by links).
    """
    kind, name = ("<f4", "float") if dict(vectors.dtypes)["embedding"] == "array<float>" else ("<f8", "double")
    values = F.col("embedding").cast(f"array<{name}>")
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = (F.size(values) > 0) & ~bad & F.exists(values, lambda x: x != 0)
    rows = materialize(vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"),
        F.when(F.coalesce(usable, F.lit(False)), F.transform(values, lambda x: x + F.lit(0.0).cast(name))).alias("vector")), "emb-rows")
    # Equal vectors have equal texts, and others other ones: a row finds its node by their hash, and no vector travels for it.
    keys = materialize(rows.select("vec_id", "row", F.unhex(F.sha2(F.array_join(F.col("vector").cast("array<string>"), ","), 256))
                                   .alias("key")), "emb-keys")
    nodes = keys.where("key is not null").groupBy("key").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"))
    size = rows.where("vector is not null").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("vector")).alias("values")).first()
    some = max(PART, -(-size["n"] // BLOCKS))
    parts = max(1, -(-size["n"] // some), -(-(size["values"] or 0) * int(kind[2]) // BLOCK))
    # A block is a file, so that a task that reads several holds one of them at a time.
    blocks = materialize(
        rows.where("vector is not null").groupBy("vector").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"))
        .coalesce(parts).mapInArrow(_packed(kind, some), "dim int, vectors binary, node binary, copies binary")
        .withColumn("block", F.monotonically_increasing_id()), "emb-blocks", maxRecordsPerFile=1)
    side = {k: blocks.select(F.col("dim").alias(f"dim_{k}"), F.col("block").alias(k),
                             *[F.col(c).alias(f"{c}_{k}") for c in ("node", "copies", "vectors")]) for k in "pq"}
    met = side["p"].join(side["q"].hint("shuffle_replicate_nl"), (F.col("dim_p") == F.col("dim_q")) & (F.col("p") <= F.col("q")))
    found = materialize(met.withColumn("kind", F.lit(kind)).mapInArrow(_compare(threshold), _EDGES), "emb-found")
    return keys.join(nodes, "key", "left").select("vec_id", "node", "copies"), found


def report(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows, found = links(vectors, threshold)
    rows = materialize(rows, "emb-nodes-of-rows")
    comp = materialize(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "emb-comp")
    total = materialize(found.groupBy("node").agg(F.sum("links").alias("links")), "emb-total")
    place = rows.join(total, "node", "left").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    place = materialize(place, "emb-place")
    low = materialize(place.where("comp is not null").groupBy("comp").agg(F.min("vec_id").alias("low")), "emb-low")
    out = place.join(low, "comp", "left")
    component = F.coalesce("low", "vec_id")
    return out.select("vec_id", F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long")
                      .alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


REPORT_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
      WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (WITH RECURSIVE w(a, b) AS (SELECT a, b FROM l UNION SELECT w.a, l.b FROM w JOIN l ON w.b = l.a)
      SELECT a, least(a, min(b)) AS c FROM w GROUP BY a)
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, coalesce(r.c, e.vec_id) AS component_id,
  e.vec_id = coalesce(r.c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = e.vec_id LEFT JOIN r ON r.a = e.vec_id
"""
