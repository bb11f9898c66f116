"""Conversation structure repair: the cheapest edits to alternating turns, by a persistent audit DP.

A repaired conversation's roles read ``(s?(ua)+)?`` by their initials. Four
states say how far that pattern has come; each row moves every state by the
edits it allows, and each state keeps its cheapest way there. The ways are
linked nodes, one an edit, that share their prefixes: a new way costs one node,
and no audit is ever copied. A node knows some of its ancestors (those 2^k edits
back, for each 2^k that divides its depth, two a node on average) and a rolling
hash of its audit. Ways of equal cost are told apart by a search for their
longest common prefix over hashes of ancestors; a prefix found equal by its
hash is walked back to the node that both ways share, so that a collision
cannot decide.

Letters fix the cost and, as the pattern fixes each kept turn's role, the state.
Two ways of equal cost to one state therefore differ in a letter, neither is a
prefix of the other, and the lesser one stays the lesser whatever follows.

Scale: one shuffle by conversation and one sorted stream. The repaired text is
hashed along each state's way, so no text is held after its row: a task holds
the audit's nodes and a 16-byte digest of each distinct row of the conversation
it is in. The hash and the audit of a conversation are single values over its
rows in order, so its rows pass through one task, however many they are.

Defined cases: a null role or text is one space, as is a null id or turn in what
the damage is drawn from; null ids form one conversation. Rows of one turn
stand by role, then by text, both in byte order. A role whose first character
is none of s, u, a, or that is empty, cannot be kept as it is. A conversation that
loses all its rows gives zeros, an empty audit and the hash of nothing. Other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the edits: what they cost, and what a truncated turn that stays costs.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_SPACES = " \t\n\x0b\f\r"
_STOPS = ".!?"
_MOD, _BASE = (1 << 61) - 1, 1_000_003
_LEGAL = {"su", "ua", "au"}

# States: nothing yet; a system turn; a user turn last; an assistant turn last.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_KEPT = {"s": (_SYSTEM, None, None, None), "u": (_USER, _USER, None, _USER), "a": (None, None, _ASSISTANT, None)}
_TURN = (_USER, _USER, _ASSISTANT, _USER)
_NAMES = {_USER: b"user", _ASSISTANT: b"assistant"}
_ENDS = (_START, _ASSISTANT)


class Way:
    """A node: one edit after the edits of ``back[0]``."""

    __slots__ = ("letter", "depth", "hash", "back")

    def __init__(self, letter: str, before: "Way | None"):
        self.letter = letter
        if before is None:
            self.depth, self.hash, self.back = 0, 0, ()
            return
        self.depth = before.depth + 1
        self.hash = (before.hash * _BASE + ord(letter)) % _MOD
        back, step = [before], 1
        while self.depth % (2 * step) == 0:
            # the ancestor ``step`` back lies at a multiple of ``step``, so it knows its own one
            back.append(back[-1].back[len(back) - 1])
            step *= 2
        self.back = tuple(back)

    def at(self, depth: int) -> "Way":
        node = self
        while node.depth > depth:
            k = min(len(node.back), (node.depth - depth).bit_length()) - 1
            node = node.back[k]
        return node

    def audit(self) -> str:
        letters, node = [], self
        while node.depth:
            letters.append(node.letter)
            node = node.back[0]
        return "".join(reversed(letters))


def _first_difference(a: Way, b: Way) -> tuple[Way, Way] | None:
    """The nodes of the first letter in which two ways of equal depth differ; None for equal audits."""
    if a is b:
        return None
    x, y = a, b
    if x.hash != y.hash:
        k = len(x.back) - 1
        while k >= 0:
            # the prefix 2^k edits shorter: if it differs, the first difference lies in it
            if x.back[k].hash != y.back[k].hash:
                x, y = x.back[k], y.back[k]
                k = len(x.back) - 1
            else:
                k -= 1
        found, x, y = (x, y), x.back[0], y.back[0]
    else:
        found = None
    while x is not y and x.depth:  # equal by hash: only a letter says so for certain
        if x.letter != y.letter:
            found = (x, y)
        x, y = x.back[0], y.back[0]
    return found


def less(a: Way, b: Way) -> bool:
    """Whether a's audit comes before b's in ASCII order."""
    depth = min(a.depth, b.depth)
    found = _first_difference(a.at(depth), b.at(depth))
    return a.depth < b.depth if found is None else found[0].letter < found[1].letter


class _Best:
    """A state's cheapest way: its cost, its node, the hash of the text up to here, and a turn yet to be hashed."""

    __slots__ = ("cost", "way", "text", "turn")

    def __init__(self, cost, way, text, turn=None):
        self.cost, self.way, self.text, self.turn = cost, way, text, turn

    def then(self, cost: int, letter: str, turn=None) -> "_Best":
        return _Best(self.cost + cost, Way(letter, self.way), self.text, turn)

    def before(self, other: "_Best | None") -> bool:
        return other is None or self.cost < other.cost or (self.cost == other.cost and less(self.way, other.way))

    def hashed(self) -> "_Best":
        """With its turn in the hash; the hash of the way it came from stays as it is."""
        if self.turn is not None:
            text = self.text.copy() if self.text else hashlib.sha256()
            if self.text:
                text.update(b"\n")
            for part in (self.turn[0], b":", self.turn[1]):
                text.update(part)
            self.text, self.turn = text, None
        return self


def _inserted(states: list) -> list:
    """The states with turns inserted where that is the cheapest way; two in a row lead as far as any number."""
    for to, sources in ((_USER, (_START, _SYSTEM, _ASSISTANT)), (_ASSISTANT, (_USER,))):
        for source in sources:
            if states[source] is not None:
                way = states[source].then(INSERT, "I", (_NAMES[to], b""))
                if way.before(states[to]):
                    states[to] = way
        if states[to] is not None:
            states[to].hashed()
    return states


class Repair:
    """One conversation, row by row."""

    def __init__(self):
        self.states = _inserted([_Best(0, Way("", None), None), None, None, None])
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.turn = None
        self.last = None
        self.seen = set()

    def add(self, turn, role: str, text: str, blank: bool, truncated: bool) -> None:
        self.rows += 1
        if turn is not None and turn != self.turn:  # rows come by turn
            self.turns, self.turn, self.most = self.turns + 1, turn, turn
            self.least = turn if self.least is None else self.least
        initial = role[:1]
        self.illegal += self.last is not None and self.last + initial not in _LEGAL
        self.last = initial
        role, text = role.encode(), text.encode()
        digest = hashlib.blake2b(len(role).to_bytes(8, "little") + role + text, digest_size=16).digest()
        again = digest in self.seen
        self.seen.add(digest)
        must = blank or again
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += truncated and not must
        self._move(initial, role, text, must, TRUNCATED if truncated and not must else 0)

    def _move(self, initial: str, role: bytes, text: bytes, must: bool, fine: int) -> None:
        kept = _KEPT.get(initial, (None,) * 4)
        new = [None] * 4
        for state, best in enumerate(self.states):
            if best is None:
                continue
            moves = [(state, best.then(DELETE, "D"))]
            if not must:
                if kept[state] is not None:
                    moves.append((kept[state], best.then(KEEP + fine, "K", (role, text))))
                to = _TURN[state]
                if kept[state] != to:
                    moves.append((to, best.then(REROLE + fine, "R", (_NAMES[to], text))))
            for to, way in moves:
                if way.before(new[to]):
                    new[to] = way
        self.states = _inserted([best and best.hashed() for best in new])

    def result(self) -> tuple:
        best = None
        for state in _ENDS:
            if self.states[state] is not None and self.states[state].before(best):
                best = self.states[state]
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        text = best.text or hashlib.sha256()
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, best.cost, best.way.audit(),
                text.hexdigest())


_RESULT = ("conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
           "audit string, repaired_sha256 string")
_NONE = object()
_FLUSH = 4096


def _repaired(kind: pa.DataType):
    def run(batches):
        here, repair, done = _NONE, None, []
        names = [c.split()[0] for c in _RESULT.format("x").split(", ")]
        types = [kind] + [pa.int64()] * 6 + [pa.string()] * 2

        def out():
            columns = list(zip(*done)) or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            for conv, turn, role, text, dropped, blank, truncated in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != here:
                    if here is not _NONE:
                        done.append((here, *repair.result()))
                        if len(done) >= _FLUSH:
                            yield out()
                            done.clear()
                    here, repair = conv, Repair()
                if not dropped:
                    repair.add(turn, role, text, blank, truncated)
        if here is not _NONE:
            done.append((here, *repair.result()))
        yield out()
    return run


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: the rows after a damage drawn from the id and the turn.

    Of twenty draws, 0 drops the row (it stays as a mark, without text), 1
    empties its text, 2 takes the stops out of it, 3 repeats the row, 4 makes
    its role user.
    """
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    draw = F.crc32(F.encode(F.concat(part[0], F.lit(":"), part[1]), "UTF-8")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), draw.alias("draw")).select(
        "conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw").isin(0, 1), "").when(F.col("draw") == 2, F.translate("text", _STOPS, ""))
        .otherwise(F.col("text")).alias("text"), (F.col("draw") == 0).alias("dropped"),
        F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    ).drop("copy")


def repair(rows: DataFrame) -> DataFrame:
    """Faults and cheapest repair of each conversation of ``rows`` (conv_id, turn, role, text, dropped).

    Rows marked ``dropped`` only say that their conversation exists. A row's
    first fault counts, of: blank, a repeat of an earlier row's role and text,
    truncated (its last character but white space is no stop).
    """
    body = F.rtrim(F.col("text"), F.lit(_SPACES))
    ended = F.substring("body", -1, 1).isin(*_STOPS)
    kind = dict(rows.dtypes)["conv_id"]
    sorted_rows = (rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "dropped", body.alias("body"))
                   .select("conv_id", "turn", "role", "text", "dropped", (F.col("body") == "").alias("blank"),
                           ((F.col("body") != "") & ~ended).alias("truncated"))
                   .repartition("conv_id")
                   .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text"))
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    if kind not in arrow:
        raise ValueError(f"conv_id is {kind}; known are {', '.join(arrow)}")
    return sorted_rows.mapInArrow(_repaired(arrow[kind]), _RESULT.format(kind))


def report(rows: DataFrame) -> DataFrame:
    """Faults and cheapest repair of each conversation, after ``damage``."""
    return repair(damage(rows))


REPORT_SQL = r"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295::UBIGINT, list_reduce(
      list_prepend(4294967295::UBIGINT, list_transform(string_split(
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::UBIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
                               lambda d, i: xor(d >> 1, (d & 1) * 3988292384::UBIGINT)))) % 20 AS draw
  FROM conversations),
convs AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM base)),
damaged AS (
  SELECT c, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM base JOIN convs ON base.conv_id IS NOT DISTINCT FROM convs.conv_id
  CROSS JOIN (VALUES (0), (1)) copies(k) WHERE draw <> 0 AND (k = 0 OR draw = 3)),
placed AS (
  SELECT *, row_number() OVER o AS i, left(role, 1) AS initial, lag(left(role, 1)) OVER o AS before,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM damaged WINDOW o AS (PARTITION BY c ORDER BY turn NULLS FIRST, role, text)),
told AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again FROM placed),
faults AS (
  SELECT *, body = '' AS blank, body <> '' AND again AS duplicate,
    body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated FROM told),
inserts AS (
  SELECT * FROM (VALUES (0, 0, 0, '', NULL), (1, 1, 0, '', NULL), (2, 2, 0, '', NULL), (3, 3, 0, '', NULL),
    (0, 2, 5, 'I', 'user:'), (1, 2, 5, 'I', 'user:'), (3, 2, 5, 'I', 'user:'), (2, 3, 5, 'I', 'assistant:'),
    (0, 3, 10, 'II', 'user:' || chr(10) || 'assistant:'), (1, 3, 10, 'II', 'user:' || chr(10) || 'assistant:'))
    v(old, new, fee, letters, turns)),
ways(c, i, state, best) AS (
  SELECT c, 0::BIGINT, new, {'cost': fee, 'audit': letters, 'text': turns} FROM convs, inserts WHERE old = 0
  UNION ALL
  SELECT c, i, new, min({'cost': cost + fee, 'audit': audit || letters, 'text': nullif(concat_ws(chr(10), said, turns), '')})
  FROM (
    SELECT w.c, f.i, CASE edit WHEN 'D' THEN state WHEN 'R' THEN CASE WHEN state = 2 THEN 3 ELSE 2 END
        ELSE CASE WHEN initial = 's' AND state = 0 THEN 1 WHEN initial = 'u' AND state <> 2 THEN 2
                  WHEN initial = 'a' AND state = 2 THEN 3 END END AS state,
      best.cost + CASE edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
        + CASE WHEN truncated AND edit <> 'D' THEN 5 ELSE 0 END AS cost,
      best.audit || edit AS audit,
      CASE edit WHEN 'D' THEN best.text WHEN 'K' THEN concat_ws(chr(10), best.text, role || ':' || text)
        ELSE concat_ws(chr(10), best.text, CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END || text) END AS said
    FROM ways w JOIN faults f ON f.c = w.c AND f.i = w.i + 1
    CROSS JOIN (VALUES ('K'), ('R'), ('D')) edits(edit)
    WHERE edit = 'D' OR NOT (blank OR duplicate)) moved
  JOIN inserts ON old = moved.state GROUP BY c, i, new),
ended AS (
  SELECT w.c, min(best) AS best FROM ways w
  WHERE state IN (0, 3) AND i = (SELECT count(*) FROM faults f WHERE f.c = w.c) GROUP BY w.c),
counted AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
    count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
    count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit,
  sha256(coalesce(best.text, '')) AS repaired_sha256
FROM convs JOIN ended USING (c) LEFT JOIN counted USING (c)
"""
