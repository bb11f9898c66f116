"""HTML extraction, conversation repair and hard negatives against brute force, and their defined results for odd rows."""

import hashlib
import html
import itertools
import math
import random
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

from vitae.llm import conversations, hard_negatives, html_extract

PROSE = "It was in the house of the man who had to be there, and they did not know what to do with all of it. "


class Plain(HTMLParser):
    """The text of a page's article by an event parser: out of every block but the ones in ``out``."""

    out = {"nav", "aside", "form", "footer", "noscript", "script", "style"}

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.inside, self.depth, self.raw, self.found = 0, 0, [], []

    def cut(self):
        text = " ".join(html.unescape("".join(self.raw)).split())
        self.found += [text] if text else []
        self.raw = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.raw.append(" ")
        elif tag not in ("b", "a"):
            self.cut()
        self.inside += tag == "article"
        self.depth += tag in self.out

    def handle_endtag(self, tag):
        if tag not in ("b", "a"):
            self.cut()
        self.inside -= tag == "article"
        self.depth -= tag in self.out

    def handle_data(self, data):
        if self.inside and not self.depth:
            self.raw.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def page(rng):
    def words(n):
        return " ".join(rng.choice(["the", "house", "of", "é&amp;x", "a&lt;b", "&#233;t", "is", "qrst"]) for _ in range(n))
    body = [rng.choice([f"<p>{words(rng.randint(1, 60))}</p>", f"<p>{words(9)}<br>{words(3)}<p>{words(2)}", f"<h2>{words(2)}</h2>",
                        f"<aside><p>{words(30)}</p></aside>", f"<form><p>{words(9)}</p></form>", f"<div>{words(5)} <b>{words(2)}</b></div>",
                        "<script>var a='</p>';</script>", "<!-- <p>no</p> -->"]) for _ in range(rng.randint(0, 9))]
    return (f"<!DOCTYPE html><html><head><title>{words(3)}</title><style>p{{}}</style></head><body><nav><ul><li><a href=1>x</a></ul></nav>"
            f"<div class='ad'>{words(20)}</div><article><h1>{words(4)}</h1>{''.join(body)}</article>"
            f"<section id=comments><p>{words(40)}</p></section><footer>&copy; {words(5)}</footer></body></html>")


def test_extraction_equals_an_event_parser(spark):
    rng = random.Random(4)
    rows = [(i, f"u{i}", page(rng)) for i in range(300)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    want = {}
    for i, _, text in rows:
        parser = Plain()
        parser.feed(text)
        want[i] = " ".join(parser.found)
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_extraction_of_odd_pages(spark):
    long = PROSE * 3
    pages = {
        "": "", "just words": "just words", "<p>&amp;amp; &am": "&amp; &am",
        f"<h1>T</h1><p>{long}<p>x<p>{long}<p><a href=1>link</a><p>contact": f"T {long}x {long}".strip(),
        f"<div id=nav><a href=1>A</a></div><div class=content><h2>H</h2><p>{long}</p>tail<div class='ad-box'>Buy</div></div>": f"H {long}tail",
        f"<body class=has-sidebar><main><article><header><h1>T</h1><p>by X</p></header><p>{long}</p><p hidden>no</p>"
        f"<ul><li><a href=1>one</a><li><a href=2>two</a></ul><p>end</p></article><div class=comments><article>{long}</article></div>"
        f"</main><div class=sidebar>{long}</div>": f"T {long}end",
        f"<nav><ul><li><a>x</a><article><p>{long}</p></article>": long.strip(),
        f"<article><p>{long}<script>never closed <p>{long}": long.strip(),
        f"<article><p title=\"open>hm</p><p>A < B and <b>c</b> <a hre": "hm A < B and c",
        "<div>" * 3000 + PROSE: PROSE.strip(), "<article>" + "<p>a</p>" * 20000: " ".join("a" * 20000),
        "<!-- " * 20000: "", "<article><p>a" + "<x" * 50000: "a",
    }
    rows = [(k, None, text, 1) for k, text in enumerate(pages)] + [(None, "u", None, 2), (0, None, "", 3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(html_extract.extract(frame).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert got[0].text == got[1].text == "" and got[-1] == (None, "u", "", 0)
    assert [r.text for r in got[1:-1]] == list(pages.values())
    assert html_extract.extract(frame.limit(0)).count() == 0


# --- conversations ---------------------------------------------------------------------------------------------------

SPACE = " \t\n\x0b\f\r"


def damaged(rows):
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw == 0:
            continue
        text = "" if draw == 1 else "".join(c for c in text if c not in ".!?") if draw == 2 else text
        row = (conv, turn, "user" if draw == 4 else role, text)
        yield from [row, row] if draw == 3 else [row]


def faults(turns):
    seen, found = set(), []
    for _, _, role, text in turns:
        body = text.rstrip(SPACE)
        found.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(turns):
    """Every state's cheapest edits with whole audits and texts, plain strings throughout."""
    def legal(initials):
        import re
        return re.fullmatch(r"(s?(ua)+)?", initials) is not None

    def state(initials):
        return "" if not initials else "s" if initials == "s" else initials[-1]

    best = {"": (0, "", "", ())}
    for (_, _, role, text), fault in [*zip(turns, faults(turns)), ((0, 0, "", ""), None)]:
        for _ in range(3):  # inserts
            for cost, audit, initials, out in list(best.values()):
                new = "a" if initials[-1:] == "u" else "u"
                offer(best, state, (cost + 5, audit + "I", initials + new, (*out, ("assistant:" if new == "a" else "user:"))))
        if fault is None:
            break
        nxt = {}
        for cost, audit, initials, out in best.values():
            offer(nxt, state, (cost + 2, audit + "D", initials, out))
            if fault in ("blank", "duplicate"):
                continue
            fine = 5 * (fault == "truncated")
            follow = role[:1] != "" and ((role[0] == "s" and not initials) or (role[0] == "u" and initials[-1:] != "u")
                                         or (role[0] == "a" and initials[-1:] == "u"))
            if follow:
                offer(nxt, state, (cost + fine, audit + "K", initials + role[0], (*out, f"{role}:{text}")))
            new = "assistant" if initials[-1:] == "u" else "user"
            offer(nxt, state, (cost + 1 + fine, audit + "R", initials + new[0], (*out, f"{new}:{text}")))
        best = nxt
    return min(x for x in best.values() if legal(x[2]))


def offer(best, state, way):
    key = state(way[2])
    if key not in best or way[:2] < best[key][:2]:
        best[key] = way


def expected(rows):
    out = {}
    order = sorted(damaged(rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    for conv in {r[0] for r in rows}:
        turns = [r for r in order if r[0] == conv]
        numbers = [t for _, t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        kind = faults(turns)
        initials = [r[2][:1] for r in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, _, text = cheapest(turns)
        out[conv] = (gaps, kind.count("blank"), kind.count("duplicate"), kind.count("truncated"), illegal, cost, audit,
                     hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def talk(rng, conversations_, odd):
    roles = ["user", "assistant", "system"] + odd * [None, "", "unknown", "tool", "agent", "Érole"]
    texts = ["Yes.", "No!", "why?", "cut", "cut \n", "", " \t\x0b", None, "é.", "\xa0", "a.\x00b"]
    rows = []
    for conv in conversations_:
        n = rng.choice([0, 1, 2, 3, 5, 8, 13, 21])
        for k in range(n):
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[k % 2]
            turn = rng.choice([None, k, k, k, k, k - 1, 5 * k])
            rows.append((conv, turn, role, rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    return rows


COLUMNS = "conv_id long, turn long, role string, text string"


def as_dict(frame):
    got = frame.collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_repair_equals_plain_strings(spark):
    rows = talk(random.Random(8), [None, *range(-5, 400)], True)
    frame = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert as_dict(conversations.report(frame)) == expected(rows)
    assert conversations.report(frame.limit(0)).count() == 0
    more = frame.selectExpr("cast(conv_id as string) conv_id", "turn", "role", "text", "1 copy", "2 dropped", "3 draw", "4 body")
    assert {None if k is None else int(k): v for k, v in as_dict(conversations.report(more)).items()} == expected(rows)


def test_a_long_conversation_and_dropped_ones(spark):
    rng = random.Random(2)
    rows = [(7, k, rng.choice(["user", "assistant"]), f"{rng.randrange(400)}{rng.choice('.!?x')}") for k in range(900)]
    rows += [(c, t, "user", "hi.") for c in range(400) for t in [0] if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got, want = as_dict(conversations.report(spark.createDataFrame(rows, COLUMNS))), expected(rows)
    assert got == want
    gone = [k for k in want if k != 7]
    assert gone and all(got[k] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in gone)


@pytest.mark.parametrize("modulus", [1, 2, 7])
def test_colliding_hashes_decide_nothing(monkeypatch, modulus):
    rng = random.Random(modulus)
    turns = [(0, k, rng.choice(["user", "assistant", "system"]), f"{k}.") for k in range(400)]

    def run():
        repair = conversations.Repair()
        for _, turn, role, text in turns:
            repair.add(turn, role, text, False, False)
        return repair.result()

    want = run()
    monkeypatch.setattr(conversations, "_MOD", modulus)
    assert run() == want


def test_ways_compare_as_strings():
    rng = random.Random(5)
    root = conversations.Way("", None)
    ways = [root]
    for _ in range(600):
        ways.append(conversations.Way(rng.choice("DIK"), rng.choice(ways[-40:])))
    texts = {w: w.audit() for w in ways}
    for _ in range(4000):
        a, b = rng.choice(ways), rng.choice(ways)
        assert conversations.less(a, b) == (texts[a] < texts[b])
        depth = rng.randint(0, a.depth)
        assert a.at(depth).audit() == texts[a][:depth]


# --- hard negatives --------------------------------------------------------------------------------------------------

def mined(rows):
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score by plain loops over Python integers."""
    use = []
    for k, (i, label, vector) in enumerate(rows):
        if label is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        use.append((k, i, label, [math.floor(256 * x) for x in vector]))

    def order(found):
        return sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0, f[2]))

    out = []
    for k, i, label, v in use:
        if i is None or i % 50:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, r, other) for r, j, other, w in use if len(w) == len(v) and r != k]
        for p in order(f for f in scored if f[3] == label)[:5]:
            fits = order(f for f in scored if f[3] != label and 50 * p[0] <= 100 * f[0] <= 95 * p[0])
            out += [(i, p[1], rank, n[1], p[0], n[0]) for rank, n in enumerate(fits[:3], 1)]
    return sorted(out, key=str)


VECTORS = "vec_id long, label int, embedding array<double>, score int, part string, row long"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS).repartition(4)


@pytest.mark.parametrize("scale", [0.4, 3.0, 5e4])
def test_hard_negatives_equal_plain_loops(spark, scale):
    rng = np.random.default_rng(int(scale))
    centres = rng.standard_normal((6, 8)) + 1.0
    rows = [(int(i), int(i % 6), [float(x) for x in scale * (centres[i % 6] + 0.3 * rng.standard_normal(8))]) for i in range(400)]
    rows += [(400 + i, 2, rows[50][2]) for i in range(30)] + [(500 + i, 3, rows[50][2]) for i in range(30)]
    rows += [rows[50], rows[51], (50, 1, rows[70][2]), (None, 2, rows[50][2]), (None, 3, rows[8][2]), (550, None, rows[1][2]),
             (600, 1, None), (650, 1, []), (700, 1, [float("nan")] * 8), (750, 1, [1.0, None] * 4), (800, 1, [float("inf")] * 8),
             (850, 4, [0.5, 0.25]), (851, 4, [0.5, 0.25]), (852, 5, [0.3, 0.2]), (900, 1, [0.0] * 8), (-50, 2, rows[3][2])]
    got = sorted((tuple(r) for r in hard_negatives.report(vectors(spark, rows)).collect()), key=str)
    assert got == mined(rows) and len(got) > 50


def test_hard_negatives_of_no_rows(spark):
    assert hard_negatives.report(vectors(spark, [])).count() == 0
    assert hard_negatives.report(vectors(spark, [(50, None, None), (None, 1, [1.0])])).count() == 0


@pytest.mark.parametrize("top", [1, 9, 300, 2**22, 2**25])
def test_packed_products_are_exact(top):
    rng = np.random.default_rng(top)
    for count, dim in [(1, 1), (7, 64), (600, 5)]:
        a, c = (rng.integers(-top, top + 1, (n, dim)) for n in (5, count))
        packed = hard_negatives.Packed(c.astype(float), -top, top)
        assert (packed.scores(a.astype(float)) == a.astype(object) @ c.T.astype(object)).all()
        assert packed.exact == (packed.field <= 53)


def test_scores_beyond_a_long_are_moved_to_its_end():
    packed = hard_negatives.Packed(np.array([[2.0**40], [-2.0**40], [3.0]]), -2**40, 2**40)
    assert packed.scores(np.array([[2.0**40]])).tolist() == [[2**63 - 1, -2**63, 3 * 2**40]]
