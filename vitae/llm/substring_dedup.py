"""Substring dedup: remove words inside runs of WINDOW words that occur more than once.

Two equal windows at word i of one text and word j of another need not lie on
the same grid. A difference cover D modulo M meets that: for every i and j
some shift below M puts both i + shift and j + shift on positions whose
remainder is in D. So only runs of WINDOW - M + 1 words at those positions,
the anchors, are hashed and counted over all documents, and every repeated
window holds a repeated anchor. Windows around repeated anchors are then
extended to their full length and counted by a 128-bit hash of all their
words; only those that occur twice or more are removed.

Defined cases: null and empty texts have no words and keep none; a text of
fewer than WINDOW words loses nothing; repeated rows are separate documents,
so their windows repeat; windows overlap and may repeat inside one document;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitae.llm import blocks
from vitae.llm.words import Texts, WordHash, rolling, slices, texts_of

WINDOW = 35
#: A difference cover: each remainder modulo PERIOD is a difference of two members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
_A, _B = WordHash(seed=303), WordHash(seed=304)
_MULT, _MULT2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _anchors(t: Texts, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the anchors of a batch of texts."""
    at, h = rolling(words, t.first, window - PERIOD + 1, _MULT)
    inside = at - np.repeat(t.first[:-1], t.n_words)[at] if len(at) else at
    on = np.isin(inside % PERIOD, COVER)
    return at[on], h[on]


def _windows(t: Texts, words: np.ndarray, window: int):
    """(word index, 64-bit hash, another) of all windows."""
    at, one = rolling(words, t.first, window, _MULT)
    _, two = rolling(_B(t.buf, t.starts, t.ends), t.first, window, _MULT2)
    return at, one, two


def _member(sorted_keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is among the keys, and where."""
    if not len(sorted_keys):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    where = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return sorted_keys[where] == values, where


def _both(ones: np.ndarray, twos: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each pair (a, b) is among the pairs (ones, twos), which are sorted by ones."""
    ok, where = _member(ones, a)
    same = np.zeros(len(a), bool)
    while ok.any():  # more than once only where different pairs share their first hash
        same |= ok & (twos[where] == b)
        after = np.minimum(where + 1, len(ones) - 1)
        ok &= ~same & (after > where) & (ones[after] == a)
        where = after
    return same


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _parts(docs: pa.Table):
    """A block's documents in the order of their rows, whatever order they arrive in: places count along it."""
    for batch in docs.sort_by("row").combine_chunks().to_batches():
        yield from slices(batch, "text")


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept_text`` (kept words joined by a space) of every row."""
    staged = blocks.stage(docs, "substring")

    def anchors(batches):
        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                for part in slices(batch.slice(a, b - a), "text"):
                    t = texts_of(part.column(2))
                    h, n = np.unique(_anchors(t, _A(t.buf, t.starts, t.ends), window)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [_long(h), pa.array(np.full(len(h), block[a])), pa.array(n.astype(np.int32))],
                        ["h", "block", "n"])

    seen = staged.mapInArrow(anchors, "h long, block long, n int")
    repeated = seen.withColumn("all", F.sum("n").over(Window.partitionBy("h"))).where("all > 1").select("block", "h").distinct()

    def extend(docs_: pa.Table, keys: pa.Table) -> pa.Table:
        known = np.sort(keys["h"].to_numpy().view(np.uint64)) if keys.num_rows else np.zeros(0, np.uint64)
        ones, twos, places, base = [], [], [], 0
        for part in _parts(docs_) if len(known) else ():
            t = texts_of(part.column(part.schema.get_field_index("text")))
            words = _A(t.buf, t.starts, t.ends)
            at, h = _anchors(t, words, window)
            hit = np.zeros(len(words) + window + 1, np.int64)
            hit[at[_member(known, h)[0]] + 1] = 1
            if hit.any():
                hit = np.cumsum(hit)
                at, one, two = _windows(t, words, window)
                near = hit[at + PERIOD] > hit[at]
                ones.append(one[near])
                twos.append(two[near])
                places.append(base + at[near])
            base += len(words)
        one, two, place = (np.concatenate(x) if x else np.zeros(0, k)
                           for x, k in ((ones, np.uint64), (twos, np.uint64), (places, np.int64)))
        order = np.lexsort((two, one))
        one, two, place = one[order], two[order], place[order]
        first = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.zeros(0, np.int64)
        n = np.diff(np.r_[first, len(one)])
        block = (docs_ if docs_.num_rows else keys)["block"][0].as_py()
        return pa.table({"h": _long(one[first]), "h2": _long(two[first]), "block": pa.array(np.full(len(n), block, np.int64)),
                         "place": pa.array(place[first]), "n": pa.array(n.astype(np.int32))})

    found = blocks.with_keys(staged, repeated, extend, "h long, h2 long, block long, place long, n int")
    # what returns to a block is where in it a repeated window stands, not the window's hashes
    copied = found.withColumn("all", F.sum("n").over(Window.partitionBy("h", "h2"))).where("all > 1").select("block", "place")

    def remove(docs_: pa.Table, keys: pa.Table) -> pa.Table:
        place = np.sort(keys["place"].to_numpy())
        texts, base = [], 0
        ones, twos = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for part in _parts(docs_):
            t = texts_of(part.column(part.schema.get_field_index("text")))
            windows = None
            if len(place):
                windows = at, one, two = _windows(t, _A(t.buf, t.starts, t.ends), window)
                here = place[np.searchsorted(place, base):np.searchsorted(place, base + len(t.starts))] - base
                here = np.searchsorted(at, here)
                ones.append(one[here])
                twos.append(two[here])
            texts.append((part, t, windows))
            base += len(t.starts)
        one, two = np.concatenate(ones), np.concatenate(twos)
        order = np.argsort(one)
        one, two = one[order], two[order]
        ids, n_words, n_removed, kept = [], [], [], []
        for part, t, windows in texts:
            drop = np.zeros(len(t.starts) + 1, np.int64)
            if windows:
                at, a, b = windows
                ok = _both(one, two, a, b)
                np.add.at(drop, at[ok], 1)
                np.add.at(drop, at[ok] + window, -1)
            drop = np.cumsum(drop)[:-1] > 0
            raw = t.buf.tobytes()
            first, gone = t.first.tolist(), np.r_[0, np.cumsum(drop)][t.first]
            stay = np.flatnonzero(~drop)
            cut = np.searchsorted(stay, t.first).tolist()
            starts, ends = t.starts[stay].tolist(), t.ends[stay].tolist()
            for i in range(part.num_rows):
                n_words.append(first[i + 1] - first[i])
                n_removed.append(int(gone[i + 1] - gone[i]))
                kept.append(b" ".join([raw[s:e] for s, e in zip(starts[cut[i]:cut[i + 1]], ends[cut[i]:cut[i + 1]])]))
            ids.append(part.column(part.schema.get_field_index("doc_id")))
        return pa.table({"doc_id": pa.chunked_array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()),
                         "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    return blocks.with_keys(staged, copied, remove, "doc_id long, n_words long, n_removed long, kept_text string")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    return deduplicate(docs).select("doc_id", "n_words", "n_removed",
                                    F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


REPORT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT s.r, s.i, array_to_string(list_slice(d.w, s.i, s.i + 34), ' ') AS x FROM s JOIN d USING (r)),
c AS (SELECT x FROM h GROUP BY x HAVING count(*) > 1),
m AS (SELECT DISTINCT r, i + k AS p FROM (SELECT r, i FROM h JOIN c USING (x)), generate_series(0, 34) AS g(k)),
v AS (SELECT r, doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
k AS (SELECT v.r, count(*) AS kept, string_agg(v.word, ' ' ORDER BY v.p) AS t
      FROM v ANTI JOIN m ON v.r = m.r AND v.p = m.p GROUP BY v.r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.kept, 0))::BIGINT AS n_removed,
  sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
