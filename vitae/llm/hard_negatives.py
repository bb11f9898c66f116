"""Hard-negative mining: exact integer scores from Kronecker-packed products.

A vector's components become integers, floor(256 x). To score anchors against
many candidates, the components of several candidates are made non-negative by
a bias and laid side by side as fields of one wide integer per dimension. One
multiplication of an anchor's biased component with that integer multiplies all
the fields, the sum over the dimensions is formed on the wide integers, and the
fields are unpacked and the biases taken out again: exact scores, several for
each multiplication. A field is wide enough that no sum reaches the next one.

The wide integers are the 53 exact integer bits of a double wherever a field fits
in them, so that the multiplications are one matrix product; for larger numbers
they are Python integers that hold ``WIDE`` candidates each.

Anchors are a stated share of the rows; every anchor meets every row of its
length. The rows are dealt into parts of bounded size, each packed once by one
task, and the anchors stream past every part in batches. A first pass finds each
anchor's positives, a second one the negatives in each positive's band of scores;
each part gives the few best rows of an anchor, which meet by anchor.

Defined cases: rows with a null label or vector, an empty vector, or a component
that is null or not finite (also once multiplied) take no part. Vectors of
different lengths never meet. Rows that repeat an id are rows of their own, each
one another's possible positive; a null id comes after all others and is no
anchor. Scores are compared after being moved into a long's range, which only
components beyond 2^26 could leave. Other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitae.session import materialize

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of its positive's score.
LOW, HIGH = 50, 95
#: Bytes of vectors in one part, and rows of a part that parallel work alone does not go below.
PART_BYTES, PART_ROWS = 64 << 20, 2048
#: Anchors and packed columns multiplied at once.
ANCHORS, COLUMNS = 256, 4096
#: Candidates in one Python integer, where a double's 53 bits are too few.
WIDE = 256
_LONG = (-(2**63), 2**63 - 1)


class Packed:
    """Candidates' integer vectors, packed for products with vectors of integers in [low, high]."""

    def __init__(self, vectors: np.ndarray, low: int, high: int):
        self.count, self.dim = vectors.shape
        self.bias = -low
        self.field = max(1, (self.dim * (high - low) ** 2).bit_length())
        self.fields = 53 // self.field
        self.exact = self.fields > 0
        if self.exact:
            lanes = -(-self.count // self.fields)
            whole = np.zeros((lanes * self.fields, self.dim))
            whole[:self.count] = vectors + self.bias
            # candidate j lies in column j % lanes, field j // lanes
            weights = 2.0 ** (self.field * np.arange(self.fields))
            self.columns = np.tensordot(weights, whole.reshape(self.fields, lanes, self.dim), 1).T.copy()
            self.sums = vectors.sum(axis=1).astype(np.int64)
        else:
            whole = [[int(x) + self.bias for x in row] for row in vectors]
            self.columns = [[sum(row[d] << (self.field * k) for k, row in enumerate(whole[at:at + WIDE]))
                             for d in range(self.dim)] for at in range(0, self.count, WIDE)]
            self.sums = [sum(row) - self.bias * self.dim for row in whole]

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products of ``anchors`` with all the candidates, one row an anchor."""
        if not self.exact:
            return np.array([self._wide([int(x) for x in row]) for row in anchors], np.int64).reshape(-1, self.count)
        mask = np.int64((1 << self.field) - 1)
        out = np.empty((len(anchors), self.fields, self.columns.shape[1]), np.int64)
        biased = anchors + self.bias
        for at in range(0, self.columns.shape[1], COLUMNS):
            product = (biased @ self.columns[:, at:at + COLUMNS]).astype(np.int64)
            for k in range(self.fields):
                out[:, k, at:at + COLUMNS] = (product >> np.int64(k * self.field)) & mask
        out = out.reshape(len(anchors), -1)[:, :self.count]
        own = anchors.sum(axis=1).astype(np.int64) * self.bias + self.dim * self.bias * self.bias
        return out - own[:, None] - self.bias * self.sums[None, :]

    def _wide(self, anchor: list[int]) -> list[int]:
        own, mask, out = self.bias * sum(anchor) + self.dim * self.bias**2, (1 << self.field) - 1, []
        for column in self.columns:
            product = sum((a + self.bias) * c for a, c in zip(anchor, column))
            for k in range(min(WIDE, self.count - len(out))):
                score = ((product >> (self.field * k)) & mask) - own - self.bias * self.sums[len(out)]
                out.append(min(max(score, _LONG[0]), _LONG[1]))
        return out


def _integers(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("vector")
    return np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)


class _Part:
    """A part's candidates in order of label, and within a label as ties ask for: by id, null ids last."""

    def __init__(self, batches: list[pa.RecordBatch], low: int, high: int):
        table = pa.Table.from_batches(batches)
        ids, label, row = (table[c].to_numpy() for c in ("id", "label", "row"))
        named = table["named"].to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((row, ids, ~named, label))
        self.ids, self.label, self.row, self.named = ids[order], label[order], row[order], named[order]
        rank = np.empty(len(order), np.int64)
        rank[np.lexsort((self.row, self.ids, ~self.named))] = np.arange(len(order))
        self.rank = rank
        self.vectors = np.concatenate([_integers(b) for b in batches])[order]
        self.low, self.high, self._packed = low, high, {}

    def packed(self, start: int, end: int) -> Packed:
        if (start, end) not in self._packed:
            self._packed[start, end] = Packed(self.vectors[start:end], self.low, self.high)
        return self._packed[start, end]


def _first(anchor: np.ndarray, most: int) -> np.ndarray:
    """Which of the rows, sorted by anchor, are among the first ``most`` of their anchor."""
    at = np.arange(len(anchor))
    new = np.r_[True, anchor[1:] != anchor[:-1]] if len(anchor) else np.zeros(0, bool)
    return at - np.maximum.accumulate(np.where(new, at, 0)) < most


def _positives(part: _Part, rows: pa.RecordBatch, most: int):
    """(anchor's place, positive's place, score, 0) of the best of a part for each anchor."""
    own, label, vectors = rows["row"].to_numpy(), rows["label"].to_numpy(), _integers(rows)
    for kind in np.unique(label):
        start, end = np.searchsorted(part.label, [kind, kind], "left")[0], np.searchsorted(part.label, kind, "right")
        if start == end:
            continue
        anchors, packed = np.flatnonzero(label == kind), part.packed(start, end)
        s = packed.scores(vectors[anchors])
        s[own[anchors][:, None] == part.row[start:end][None, :]] = _LONG[0]
        if end - start > most:
            least = np.partition(s, end - start - most, axis=1)[:, end - start - most]
        else:
            least = np.full(len(anchors), _LONG[0])
        i, j = np.nonzero((s >= least[:, None]) & (own[anchors][:, None] != part.row[start:end][None, :]))
        order = np.lexsort((j, -s[i, j], i))
        i, j = i[order], j[order]
        keep = _first(i, most)
        i, j = i[keep], j[keep]
        yield anchors[i], start + j, s[i, j], np.zeros(len(i), np.int32)


def _negatives(part: _Part, rows: pa.RecordBatch, most: int, band: tuple[int, int]):
    """(anchor's place, negative's place, score, number of the positive) of the best of a part in each band."""
    label, vectors = rows["label"].to_numpy(), _integers(rows)
    scores = rows["scores"].to_pylist()
    width = max(map(len, scores), default=0)
    # 100 n >= 50 p and 100 n <= 95 p over integers; a band that is not there holds nothing
    low = np.array([[-(-band[0] * p // 100) for p in x] + [_LONG[1]] * (width - len(x)) for x in scores], np.int64)
    high = np.array([[band[1] * p // 100 for p in x] + [_LONG[0]] * (width - len(x)) for x in scores], np.int64)
    low, high = low.reshape(len(scores), width), high.reshape(len(scores), width)
    if not width:
        return
    s = part.packed(0, len(part.row)).scores(vectors)
    i, j = np.nonzero((s >= low.min(axis=1)[:, None]) & (s <= high.max(axis=1)[:, None])
                      & (label[:, None] != part.label[None, :]))
    order = np.lexsort((part.rank[j], -s[i, j], i))
    i, j = i[order], j[order]
    score = s[i, j]
    for k in range(width):
        fits = np.flatnonzero((score >= low[i, k]) & (score <= high[i, k]))
        fits = fits[_first(i[fits], most)]
        yield i[fits], j[fits], score[fits], np.full(len(fits), k, np.int32)


_FOUND = "anchor long, place int, score long, row long, id long"


def _search(find, low: int, high: int):
    """A stream of (dim, part, anchors after candidates): each part is packed, then meets its anchors."""
    def run(batches):
        here, pending, part = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("dim", "part", "kind")], axis=1)
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            for start, end in zip(cut, np.r_[cut[1:], len(key)]):
                dim, number, kind = key[start].tolist()
                if here != (dim, number):
                    here, pending, part = (dim, number), [], None
                if kind == 0:
                    pending.append(batch.slice(start, end - start))
                    continue
                if part is None:
                    part, pending = _Part(pending, low, high), []
                for at in range(start, end, ANCHORS):
                    rows = batch.slice(at, min(ANCHORS, end - at))
                    own = rows["row"].to_numpy()
                    for i, j, score, place in find(part, rows):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(own[i]), pa.array(place), pa.array(score), pa.array(part.row[j]),
                             pa.array(part.ids[j], mask=~part.named[j])], ["anchor", "place", "score", "row", "id"])
    return run


def _dealt(rows: DataFrame, anchors: DataFrame, parts: DataFrame) -> DataFrame:
    """Candidates once, anchors once for each part of their length, sorted so that candidates come first."""
    columns = ["dim", "part", "kind", "row", "id", "named", "label", "vector", "scores"]
    none = F.lit(None).cast("array<long>")
    held = (rows.join(parts, "dim").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
            .withColumns({"kind": F.lit(0).cast("long"), "scores": none}).select(columns))
    met = (anchors.join(parts, "dim").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
           .withColumn("kind", F.lit(1).cast("long")).select(columns))
    return held.unionByName(met).repartition("dim", "part").sortWithinPartitions("dim", "part", "kind", "row")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         band: tuple[int, int] = (LOW, HIGH)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and embedding. Rows for which ``is_anchor``
    holds are anchors; their positives are the ``positives`` best other rows of
    their label, a positive's negatives the ``negatives`` best rows of other
    labels whose score lies in ``band`` hundredths of the positive's.
    """
    spark = vectors.sparkSession
    double = F.col("embedding").cast("array<double>")
    bad = F.exists(double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * SCALE) == float("inf")))
    rows = materialize(
        vectors.where(F.col("label").isNotNull() & (F.size(double) > 0) & ~bad).select(
            F.coalesce(F.col("vec_id").cast("long"), F.lit(0).cast("long")).alias("id"),
            F.col("vec_id").isNotNull().alias("named"), F.col("label").cast("long").alias("label"), double.alias("vector"),
            F.size(double).cast("long").alias("dim"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
            F.monotonically_increasing_id().alias("row")), "negative-rows")
    low, high = rows.agg(F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first()
    low, high = (int(np.floor(SCALE * (x or 0.0))) for x in (low, high))
    at_least = F.ceil(F.count(F.lit(1)) * F.col("dim") * 8 / PART_BYTES)
    spread = F.least(F.ceil(F.count(F.lit(1)) / PART_ROWS), F.lit(spark.sparkContext.defaultParallelism))
    parts = rows.groupBy("dim").agg(F.greatest(at_least, spread).cast("long").alias("parts"))
    anchors = rows.where("anchor AND named").withColumn("scores", F.lit(None).cast("array<long>"))

    better = (F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row"))
    found = _dealt(rows, anchors, parts).mapInArrow(
        _search(lambda part, batch: _positives(part, batch, positives), low, high), _FOUND)
    order = Window.partitionBy("anchor").orderBy(*better)
    pairs = materialize(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives).select(
        "anchor", (F.col("n") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
        "negative-positives")

    scores = pairs.groupBy(F.col("anchor").alias("row")).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    anchors = materialize(rows.where("anchor AND named").join(scores, "row"), "negative-anchors")
    found = _dealt(rows, anchors, parts).mapInArrow(
        _search(lambda part, batch: _negatives(part, batch, negatives, band), low, high), _FOUND)
    order = Window.partitionBy("anchor", "place").orderBy(*better)
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    own = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return best.join(pairs, ["anchor", "place"]).join(own, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def report(vectors: DataFrame) -> DataFrame:
    """``mine`` with every fiftieth id as an anchor, labels of every seventh id moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


REPORT_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.r AS ar, b.vec_id AS id, b.r AS br, a.label = b.label AS same,
    list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id NULLS LAST, br) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER w::INTEGER AS rank, n.id AS negative_id,
  p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.ar = p.ar AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.ar, p.br ORDER BY n.score DESC, n.id NULLS LAST, n.br)
QUALIFY row_number() OVER w <= 3
"""
