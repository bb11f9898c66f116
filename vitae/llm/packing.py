"""Harmonic packing of token documents into sequences of a fixed capacity.

A document's class is the reciprocal of the capacity that it fits: class k holds
lengths above C / (k + 1) and up to C / k of C = 2048. A sequence of class k takes
exactly k documents of that class, whole, and each task fills its own sequences
without looking at any other task. What k documents leave free is filled by the
next document that is no longer than all the room left free so far; only such
documents are cut, to the room of one sequence after the other. A document longer
than a sequence gives full sequences, and its rest is placed like a document.

A sequence is written once it is full, so a task holds at most k documents for each
of C classes and the sequences that wait to be filled, whose free room is
below two sequences in all. At its end what is left is laid end to end and cut into
full sequences, the last into powers of two: no sequence needs padding.

Defined cases: a null text is empty and gives the end id alone; a document
longer than a sequence spans several; rows that repeat are packed each; a null
id stays null; an empty table gives no rows; other columns are not kept.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitae.llm.tokenizing import cut, encoded

CAPACITY = 2048
SCHEMA = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


class Packer:
    """Fills the sequences of one task. Pieces are (doc_id, start, tokens of the document, ids as bytes)."""

    def __init__(self, task: int, capacity: int = CAPACITY):
        self.capacity = capacity
        self.next = task << 32
        self.classes: dict[int, list[tuple]] = {}
        self.waiting: deque[list] = deque()  # [free room, pieces] of sequences that have all their documents
        self.room = 0
        self.out: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            length = len(ids) // 4
            self.out.append((doc, start, length, total, self.next, offset, ids))
            offset += length
        self.next += 1

    def _fill(self, piece: tuple) -> None:
        """Cut a piece to the room left free, which it does not exceed."""
        doc, start, total, ids = piece
        at = 0
        while at < len(ids):
            free, pieces = self.waiting[0]
            part = ids[at:at + 4 * free]
            pieces.append((doc, start + at // 4, total, part))
            at += len(part)
            self.room -= len(part) // 4
            if len(part) == 4 * free:
                self._close(pieces)
                self.waiting.popleft()
            else:
                self.waiting[0][0] -= len(part) // 4

    def add(self, doc, ids: bytes) -> None:
        total, step = len(ids) // 4, 4 * self.capacity
        whole = len(ids) - len(ids) % step
        for at in range(0, whole, step):
            self._close([(doc, at // 4, total, ids[at:at + step])])
        n = (len(ids) - whole) // 4
        if not n:
            return
        piece = (doc, whole // 4, total, ids[whole:])
        if n <= self.room:
            self._fill(piece)
            return
        k = self.capacity // n
        held = self.classes.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            del self.classes[k]
            free = self.capacity - sum(len(p[3]) for p in held) // 4
            if free:
                self.waiting.append([free, held])
                self.room += free
            else:
                self._close(held)

    def finish(self) -> None:
        left = [p for _, pieces in self.waiting for p in pieces] + [p for pieces in self.classes.values() for p in pieces]
        rest = sum(len(p[3]) for p in left) // 4
        pieces, free = [], 0
        for doc, start, total, ids in left:
            at = 0
            while at < len(ids):
                if not free:
                    # full sequences, then the greatest power of two that is left
                    size = free = self.capacity if rest >= self.capacity else 1 << (rest.bit_length() - 1)
                    rest -= size
                part = ids[at:at + 4 * free]
                pieces.append((doc, start + at // 4, total, part))
                at += len(part)
                free -= len(part) // 4
                if not free:
                    self._close(pieces)
                    pieces = []
        self.waiting.clear()
        self.classes.clear()

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", spaced: bool = True, end: int = 1) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit bytes."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.binary()]

    def batch_of(rows):
        columns = list(zip(*rows)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    def fill(batches):
        packer = Packer(TaskContext.get().partitionId())
        for rows, offsets, ids in encoded(batches, tokenizer, spaced, end):
            for doc, b in zip(rows.column(0).to_pylist(), cut(offsets, ids)):
                packer.add(doc, b)
            yield batch_of(packer.taken())
        packer.finish()
        yield batch_of(packer.taken())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(fill, SCHEMA)


def report(docs: DataFrame) -> DataFrame:
    """The pieces with a CRC-32 of their ids instead of the ids."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                             "sequence_id", "offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids, length: each sequence's ids end to end; at most CAPACITY pieces meet in a row."""
    part = F.struct("offset", "ids")
    joined = F.aggregate(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["ids"]),
                         F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    return (pieces.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length")))
