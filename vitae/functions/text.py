"""Column expressions for text: cleaning, tokens, list literals, samples, slugs.

All are native Spark expressions (no Python UDF), so they stay inside
whole-stage code generation. Whitespace is the ASCII set `` \\t\\n\\r\\f\\v``
in every pattern, so results are the same in any regex engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\r\f\x0B]"
WS_RUN = WS + "+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Remove leading and trailing whitespace (all six ASCII kinds)."""
    return F.btrim(_c(col), F.lit(" \t\n\r\f\x0B"))


def collapse_ws(col) -> Column:
    return F.regexp_replace(_c(col), WS_RUN, " ")


def clean(col, mode: str = "delete") -> Column:
    """Normalise free text to lower-case letters and whitespace.

    ``delete``   lower, drop every character that is not a-z or whitespace, strip.
    ``collapse`` as ``delete``, then whitespace runs become one space.
    ``space``    lower, every run of non-letters becomes one space, strip.
    """
    low = F.lower(_c(col))
    if mode == "delete":
        return strip_ws(F.regexp_replace(low, r"[^a-z \t\n\r\f\x0B]", ""))
    if mode == "collapse":
        return strip_ws(collapse_ws(F.regexp_replace(low, r"[^a-z \t\n\r\f\x0B]", "")))
    if mode == "space":
        return strip_ws(F.regexp_replace(low, r"[^a-z]+", " "))
    raise ValueError(f"unknown clean mode {mode!r}; use delete, collapse or space")


def terms(col, min_len: int = 2) -> Column:
    """Tokens of cleaned text: whitespace-separated runs of at least ``min_len`` chars."""
    return F.filter(F.split(_c(col), WS_RUN), lambda t: F.length(t) >= min_len)


def words(col) -> Column:
    """Whitespace tokens (no empties), like Python's ``str.split()``."""
    return F.filter(F.split(_c(col), WS_RUN), lambda t: t != "")


def parse_list(col) -> Column:
    """A string holding a list literal (``"['a', 'b']"``) to ``array<string>``.

    JSON with single quotes allowed; anything that is not a list literal
    becomes a one-element array holding the raw string.
    """
    parsed = F.from_json(_c(col), "array<string>", {"allowSingleQuotes": "true"})
    return F.when(_c(col).isNull(), F.lit(None)).otherwise(
        F.coalesce(parsed, F.array(_c(col))))


def text_sample(col, n: int = 300) -> Column:
    """First ``n`` characters, with ``...`` appended when the text is longer."""
    return F.when(F.length(_c(col)) > n,
                  F.concat(F.substring(_c(col), 1, n), F.lit("..."))).otherwise(_c(col))


def truncate_cell(col, width: int = 30, keep: int = 27) -> Column:
    """Cells longer than ``width`` become the first ``keep`` characters + ``...``."""
    return F.when(F.length(_c(col)) > width,
                  F.concat(F.substring(_c(col), 1, keep), F.lit("..."))).otherwise(_c(col))


def paragraphs(col, min_len: int = 15) -> Column:
    """Blank-line separated paragraphs whose stripped length is at least ``min_len``."""
    parts = F.split(_c(col), r"\n[ \t\n\r\f\x0B]*\n")
    return F.filter(parts, lambda p: F.length(strip_ws(p)) >= min_len)


def role_slug(col) -> Column:
    """Trim, lower-case, whitespace runs to ``-``."""
    return F.regexp_replace(F.lower(strip_ws(_c(col))), WS_RUN, "-")


# Unit names of the human-readable size, base 1024.
SIZE_UNITS = ["Bytes", "KB", "MB", "GB"]


def human_size(col) -> Column:
    """Bytes as ``<value> <unit>``, base 1024, at most 2 decimals, trailing zeros dropped."""
    b = _c(col).cast("double")
    exp = F.least(F.floor(F.log(1024.0, b)).cast("int"), F.lit(len(SIZE_UNITS) - 1))  # the largest unit has no end
    val = F.round(b / F.pow(F.lit(1024.0), exp), 2)
    units = F.array(*[F.lit(u) for u in SIZE_UNITS])
    # 12.50 -> 12.5, 3.00 -> 3 (the value is printed as its shortest decimal)
    shown = F.regexp_replace(F.regexp_replace(F.format_number(val, 2), ",", ""), r"\.?0+$", "")
    return F.when(b == 0, F.lit("0 Bytes")).otherwise(
        F.concat(shown, F.lit(" "), F.element_at(units, exp + 1)))


def word_share(have, need) -> Column:
    """Share of the distinct words ``need`` that are among ``have``; 0 if none needed."""
    n = _c(need)
    return F.when(F.coalesce(F.size(n), F.lit(0)) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(_c(have), n)).cast("double") / F.size(n))


def keyword_ratio(have, need) -> Column:
    """|distinct words(have) ∩ distinct words(need)| / |distinct words(need)|, 0 if none needed."""
    return word_share(F.array_distinct(words(have)), F.array_distinct(words(need)))
