"""Documents in blocks: how statistics over all documents come back to the texts.

A block is a run of documents of one input partition with a bounded number of
bytes. A step sends each distinct key of a block once, all blocks' keys meet
by key, and what was learned about a key returns to the blocks that hold it. A
text moves never: the blocks lie in a table bucketed by block in the shared
folder, and only keys are shuffled to them. Keys are dealt into parts by their
hash; a block sends a part its keys as one row of bytes, their gaps in ascending
order, and gets back the sums alone, as it knows its keys.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitae.llm.words import mix, slices
from vitae.session import ensure_checkpoint_dir


def stage(docs: DataFrame, name: str, most: int = 4 << 20, ids_of=None) -> DataFrame:
    """(block, doc_id, text, row) of every row: null texts made empty, ``row`` a number of its own.

    Blocks hold about ``most`` bytes of text, or one document. ``ids_of``, a
    function from a list of texts to a list of byte strings, adds a column ``ids``.
    """
    def number(batches):
        base, k, row = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            for part in slices(batch, "text", most):
                columns = [pa.array(np.full(part.num_rows, base + k)), part.column(0), part.column(1),
                           pa.array(base + row + np.arange(part.num_rows))]
                if ids_of:
                    columns.append(pa.array(ids_of(part.column(1).to_pylist()), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)
                k, row = k + 1, row + part.num_rows

    schema = "block long, doc_id long, text string, row long" + ", ids binary" * bool(ids_of)
    names = [c.split()[0] for c in schema.split(", ")]
    spark = docs.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{table}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
     .mapInArrow(number, schema)
     .write.bucketBy(buckets, "block").option("compression", "zstd").option("path", path).saveAsTable(table))
    return spark.table(table)


def with_keys(staged: DataFrame, keys: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(documents, keys)`` on the Arrow tables of each block; blocks without keys get none."""
    return staged.groupBy("block").cogroup(keys.groupBy("block")).applyInArrow(fn, schema)


SUMS = "chunk long, sums binary"


def chunks(array: np.ndarray, size: int = 1 << 14) -> pa.RecordBatch:
    """A task's array of numbers as rows of SUMS."""
    flat = array.ravel()
    at = range(0, len(flat), size)
    return pa.RecordBatch.from_pydict({"chunk": pa.array(range(len(at)), pa.int64()),
                                       "sums": pa.array([flat[k:k + size].tobytes() for k in at], pa.binary())})


def summed(rows: DataFrame, kind, size: int) -> np.ndarray:
    """The sum of all tasks' arrays of ``size`` numbers; each chunk's rows are added up as they arrive.

    Only the total, whose size does not depend on the data, reaches the driver.
    """
    wide = np.float64 if np.dtype(kind).kind == "f" else np.int64

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, b in zip(*(x.to_pylist() for x in batch.columns)):
                sums[c] = sums.get(c, 0) + np.frombuffer(b, kind).astype(wide)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int64()),
                                          "sums": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    got = rows.repartition(16, "chunk").mapInArrow(add, SUMS).orderBy("chunk").collect()
    return np.concatenate([np.frombuffer(r["sums"], wide) for r in got]) if got else np.zeros(size, wide)


COUNTS = "key long, n long"


class Tally:
    """Counts of keys that one task meets, merged whenever ``most`` entries wait."""

    def __init__(self, most: int = 1 << 21):
        self.most, self.held, self.waiting = most, 0, []

    def add(self, keys: np.ndarray) -> None:
        found = np.unique(keys, return_counts=True)
        self.waiting.append(found)
        self.held += len(found[0])
        if self.held > self.most:
            self._merge()

    def _merge(self) -> None:
        keys, n = (np.concatenate(x) for x in zip(*self.waiting))
        one, back = np.unique(keys, return_inverse=True)
        self.waiting = [(one, np.bincount(back, n, minlength=len(one)).astype(np.int64))]
        self.held = 0 if len(one) > self.most // 2 else len(one)  # many different keys: merge less often

    def batch(self) -> pa.RecordBatch:
        if self.waiting:
            self._merge()
        keys, n = self.waiting[0] if self.waiting else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])


def counted(rows: DataFrame, size: int, kind=np.int64, chunks_: int = 64) -> np.ndarray:
    """The counts of keys 0 to ``size`` - 1 over all tasks' rows of COUNTS, as one array.

    Only keys that occur are shuffled, once, dealt by their remainder, and added up where
    they arrive. The array, whose size does not depend on the data, reaches the driver.
    """
    def lay(batches):
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            key, n = (c.to_numpy() for c in batch.columns)
            chunk = key % chunks_
            for c in np.unique(chunk).tolist():
                here = chunk == c
                total = out.setdefault(c, np.zeros(-(-(size - c) // chunks_), kind))
                np.add.at(total, key[here] // chunks_, n[here].astype(kind))
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(out), pa.int64()),
                                          "sums": pa.array([x.tobytes() for x in out.values()], pa.binary())})

    got = rows.repartition(16, F.pmod("key", F.lit(chunks_))).mapInArrow(lay, SUMS).collect()
    total = np.zeros(size, kind)
    for r in got:
        total[r["chunk"]::chunks_] = np.frombuffer(r["sums"], kind)
    return total


KEYS = "part int, block long, size int, gaps binary, more binary, n binary"
TOTALS = "part int, block long, c binary, n long, v long"


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, as few as the largest needs: the upper ones are mostly zero, which compresses well."""
    wide = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return out.view("<u8").ravel()


def part_count(staged: DataFrame) -> int:
    """Into how many parts the keys of all blocks are dealt: a part gets about as many keys as two blocks have."""
    found = staged.select("block").distinct().count()
    return max(int(staged.sparkSession.conf.get("spark.sql.shuffle.partitions")), found // 2)


def dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parts that have some of the keys, order of the keys by part, where each part's begin); a part's keep their order."""
    part = (mix(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    of = part[order]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    return of[first], order, np.r_[first, len(of)]


def sent(block: int, keys: np.ndarray, n: np.ndarray, parts: int, more: np.ndarray | None = None) -> pa.Table:
    """Rows of KEYS: a block's distinct keys, ascending, with how often it uses each; ``more`` tells equal keys apart."""
    part, order, cuts = dealt(keys, parts)
    rows = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    keys = keys.view(np.uint64)
    return pa.table({
        "part": pa.array(part, pa.int32()), "block": pa.array(np.full(len(part), block, np.int64)),
        "size": pa.array(np.diff(cuts), pa.int32()),
        "gaps": pa.array([packed(np.diff(keys[r], prepend=np.uint64(0))) for r in rows], pa.binary()),
        "more": pa.array([b"" if more is None else more[r].astype("<u8").tobytes() for r in rows], pa.binary()),
        "n": pa.array([packed(n[r]) for r in rows], pa.binary())})


def totals(rows: DataFrame) -> DataFrame:
    """Rows of TOTALS: for each row of KEYS the sum of each key's uses in all blocks, in the keys' order.

    A part's first row also has the sum over its keys, and how many are used.
    """
    def meet(table: pa.Table) -> pa.Table:
        gaps, counts = table["gaps"].to_pylist(), table["n"].to_pylist()
        size = table["size"].to_numpy()
        key = np.concatenate([np.cumsum(unpacked(b, k), dtype=np.uint64) for b, k in zip(gaps, size)])
        n = np.concatenate([unpacked(b, k) for b, k in zip(counts, size)]).astype(np.int64)
        more = np.frombuffer(b"".join(table["more"].to_pylist()), "<u8")
        order = np.lexsort((more, key)) if len(more) else np.argsort(key, kind="stable")
        new = np.r_[True, key[order[1:]] != key[order[:-1]]]
        if len(more):
            new[1:] |= more[order[1:]] != more[order[:-1]]
        first = np.flatnonzero(new)
        total = np.add.reduceat(n[order], first)
        c = np.empty(len(n), np.int64)
        c[order] = np.repeat(total, np.diff(np.r_[first, len(n)]))
        lead = np.arange(len(size)) == 0
        return pa.table({
            "part": table["part"], "block": table["block"],
            "c": pa.array([packed(x) for x in np.split(c, np.cumsum(size)[:-1])], pa.binary()),
            "n": pa.array(np.where(lead, total.sum(), 0)), "v": pa.array(np.where(lead, (total > 0).sum(), 0))})

    return rows.groupBy("part").applyInArrow(meet, TOTALS)


def found(keys: np.ndarray, parts: int, part: list[int], c: list[bytes]) -> np.ndarray:
    """The sums of a block's distinct keys, ascending, from its rows of TOTALS."""
    out, data = np.zeros(len(keys), np.int64), dict(zip(part, c))
    which, order, cuts = dealt(keys, parts)
    for p, a, b in zip(which.tolist(), cuts[:-1], cuts[1:]):
        out[order[a:b]] = unpacked(data[p], b - a)
    return out
