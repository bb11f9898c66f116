"""Whole texts to token ids with a public tokenizer file, one Arrow batch at a time.

Byte-pair encoding works on pieces of text that never cross white space, so
the ids of a text are those of its pieces in a row. Arrow cuts a batch into
pieces and finds the different ones; each worker keeps the ids of the pieces
it has met, up to a fixed number, and new ones go through the tokenizers
library. Texts in which white space precedes a space are handed to the library
whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vitae.llm.words import release, slices

#: Pieces remembered by a worker; beyond, those not met lately are given up.
PIECES = 600_000
#: Bytes of text cut into pieces at once: a piece is looked up once in them.
PART = 8 << 20
#: Characters that are never merged with a letter before them, nor part of a special token or a contraction.
STOPS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Runs of stops remembered.
STOP_RUNS = 10_000
#: A longer piece is not remembered.
LONGEST = 64
#: Pieces handed to the library in one text.
RUN = 128
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u0400-\u0481\u4e00-\u9fff"
#: Words of letters that stay letters in lower case and composed form.
_PLAIN = re.compile(f"[{_LETTERS}]+").fullmatch


def tokenizer_path(name: str) -> str:
    """A tokenizer file's place: ``name`` itself if it is a path, else that of the public file."""
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    ``spaced``: the vocabulary keeps white space (byte-level with a leading
    space); otherwise white space only separates words.
    """

    def __init__(self, name: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(tokenizer_path(name))
        self.spaced = spaced
        #: Ids of the pieces met since half of PIECES were met, and of those before.
        self.known: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}
        self.stops: dict[str, bytes] = {}
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        #: Per id: its bytes in the text if spaced, else whether it ends a word.
        self.span = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.span[i] = len(token) if spaced else token.endswith("</w>")

    def ids(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def each(self, texts: list[str]) -> list[bytes]:
        """Ids of every text by itself."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that do not change one another; the library gets RUN of them as one text.

        Spaced pieces begin with white space and end without; where each begins is
        known from the bytes of the ids before it. Others are one word each, with one id that ends it.
        """
        runs = [pieces[a:a + RUN] for a in range(0, len(pieces), RUN)]
        out = []
        for a in range(0, len(runs), 64):
            texts = [("" if self.spaced else " ").join(r) for r in runs[a:a + 64]]
            for run, text, e in zip(runs[a:], texts, self.model.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                done = np.cumsum(self.span[ids])
                want = np.cumsum([len(w.encode()) for w in run]) if self.spaced else np.arange(1, len(run) + 1)
                at = np.searchsorted(done, want)
                if len(done) and done[-1] == want[-1] and at[-1] == len(ids) - 1 and (done[at] == want).all():
                    cuts, data = (4 * at + 4).tolist(), ids.tobytes()
                    out += [data[x:y] for x, y in zip([0, *cuts[:-1]], cuts)]
                else:
                    out += self.each(run)
        return out

    def _found(self, pieces: list[str]) -> dict[str, bytes | None]:
        """Ids of pieces; None if the run of white space that one ends in goes on in the next."""
        if self.spaced:
            plain = [w for w in pieces if w and not w[-1].isspace() and "<|" not in w]
            found = dict(zip(plain, self.joined([w if w[0] == "\n" else " " + w for w in plain])))
            found |= {w: self.ids(w if w[0] == "\n" else " " + w) for w in pieces if "<|" in w and not w[-1].isspace()}
            return dict.fromkeys(pieces) | found
        plain = [w for w in pieces if _PLAIN(w)]
        found = dict(zip(plain, self.joined(plain)))
        other = [w for w in pieces if w not in found]
        return found | dict(zip(other, self.each(other)))

    def _pieces(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of different pieces, new ones by the library; those longer than LONGEST are not remembered."""
        found = list(map(self.known.get, pieces, repeat(False)))
        absent = [i for i, b in enumerate(found) if b is False]
        if len(self.known) + len(absent) > PIECES // 2:
            self.known, self.older = {}, self.known
        again = {}
        for i in absent:
            found[i] = b = self.older.get(pieces[i], False)
            if b is not False:
                again[pieces[i]] = b
        absent = [i for i in absent if found[i] is False]
        new = self._found([pieces[i] for i in absent])
        for i in absent:
            found[i] = new[pieces[i]]
        self.known |= again
        self.known.update((w, b) for w, b in new.items() if len(w) <= LONGEST)
        return found

    def _stops(self, runs: list[str]) -> list[bytes]:
        if len(self.stops) + len(runs) > STOP_RUNS:
            self.stops.clear()
        out = []
        for w in runs:
            b = self.stops.get(w)
            if b is None:
                b = self.ids(w)
                if len(w) <= LONGEST:
                    self.stops[w] = b
            out.append(b)
        return out

    def _words(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of different words as lists, and which have none by themselves (see ``_found``)."""
        # A letter and the stops behind it are never merged: their ids are those of the two in a row.
        stem = pc.ascii_rtrim(words, characters=STOPS)
        stem = pc.if_else(pc.match_substring_regex(stem, f"[{_LETTERS}]$"), stem, words)
        size = pc.subtract(pc.binary_length(words), pc.binary_length(stem)).to_numpy().astype(np.int64)
        stem, stops = stem.dictionary_encode(), tails(words, size).dictionary_encode()
        found = self._pieces(stem.dictionary.to_numpy(zero_copy_only=False).tolist())
        none = np.array([b is None for b in found], bool)
        both = lists([b or b"" for b in found] + self._stops(stops.dictionary.to_pylist()))
        at = np.column_stack([stem.indices.to_numpy(), len(found) + stops.indices.to_numpy().astype(np.int64)])
        both = both.take(pa.array(at.ravel()))
        return (pa.LargeListArray.from_arrays(pa.array(both.offsets.to_numpy()[::2]), both.values),
                none[stem.indices.to_numpy()])

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): text i has ids[offsets[i]:offsets[i + 1]]."""
        texts = texts.cast(pa.large_string())
        if self.spaced:
            # A line's end begins a piece, too; it stands there instead of the space.
            lines = pc.replace_substring(pc.replace_substring(texts, "\n", " \n"), "\n \n", "\n\n")
        else:
            # The vocabulary knows lower case only; ASCII capitals may go first, but for special tokens.
            # (Arrow's ascii_lower breaks slices of an array, so it gets a new one.)
            lines = pc.replace_substring(texts, "\n", " ")
            lines = pc.if_else(pc.match_substring(lines, "<|"), lines, pc.ascii_lower(lines))
        parts = pc.split_pattern(lines, " ")
        first, words = parts.offsets.to_numpy().astype(np.int64), parts.flatten().dictionary_encode()
        known, none = self._words(words.dictionary)
        at = words.indices.to_numpy().astype(np.int64)
        if self.spaced and len(texts):
            at, more = self._ends(texts, words.dictionary, first, at, none)
            known = pa.concat_arrays([known, lists(more)])
        got = known.take(pa.array(at))
        return got.offsets.to_numpy()[first], got.values.to_numpy()

    def _ends(self, texts: pa.Array, words: pa.Array, first: np.ndarray, at: np.ndarray,
              none: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Which ids each piece has, where the first piece of a text, after no space, and some last ones have their own.

        A text with a piece that has none by itself goes to the library whole, in place of its first piece.
        """
        last, n = first[1:] - 1, len(texts)
        heads, ends = words.take(pa.array(at[first[:-1]])).to_pylist(), words.take(pa.array(at[last])).to_pylist()
        inner = none[at]
        inner[first[:-1]] = inner[last] = False
        ok = (np.diff(first) > 2) & (np.add.reduceat(inner, first[:-1], dtype=np.int64) == 0)
        ok &= [not h[-1:].isspace() and "<|" not in h + e for h, e in zip(heads, ends)]
        whole, good = np.flatnonzero(~ok), np.flatnonzero(ok)
        lead = np.full(n, b"", object)
        lead[good] = self.each([heads[i] for i in good])
        lead[whole] = self.each(texts.take(pa.array(whole)).to_pylist())
        odd = good[none[at[last[good]]]]
        tail = self.each([w if (w := ends[i])[:1] == "\n" else " " + w for i in odd])
        at = np.where(np.repeat(ok, np.diff(first)), at, len(words))
        at[first[:-1]] = len(words) + 1 + np.arange(n)
        at[last[odd]] = len(words) + 1 + n + np.arange(len(odd))
        return at, [b"", *lead, *tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        offsets, ids = self.arrays(pa.array(texts, pa.large_string()))
        return cut(offsets, ids)


def lists(ids: list[bytes]) -> pa.Array:
    """Little-endian unsigned 32-bit ids as an Arrow array of lists."""
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    return pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)]), pa.array(np.frombuffer(b"".join(ids), "<u4")))


def cut(offsets: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The bytes of each text's ids."""
    data, at = ids.tobytes(), (offsets * ids.itemsize).tolist()
    return [data[a:b] for a, b in zip(at[:-1], at[1:])]


def tails(words: pa.Array, size: np.ndarray) -> pa.Array:
    """The last ``size`` bytes of each word."""
    _, off, data = words.buffers()
    ends = np.frombuffer(off, np.int64)[words.offset + 1:words.offset + 1 + len(words)]
    to = np.r_[0, np.cumsum(size)]
    at = np.repeat(ends - to[1:], size) + np.arange(to[-1])
    data = np.frombuffer(data, np.uint8)[at] if len(at) else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(to), pa.py_buffer(data))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(name: str, spaced: bool) -> Encoder:
    """This worker's encoder; it lives as long as the worker."""
    if (name, spaced) not in _ENCODERS:
        _ENCODERS[name, spaced] = Encoder(name, spaced)
    return _ENCODERS[name, spaced]


def forget() -> None:
    """Give up this worker's encoders, for steps after which no text is encoded."""
    _ENCODERS.clear()


def encoded(batches, name: str, spaced: bool, end: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with the ids of their ``text`` column (see ``arrays``), the end id appended; null is empty."""
    model = encoder(name, spaced)
    for batch in batches:
        for part in slices(batch, "text", PART):
            offsets, ids = model.arrays(part.column(part.schema.get_field_index("text")).fill_null(""))
            yield part, offsets + np.arange(len(offsets)), np.insert(ids, offsets[1:], end)
    release()
