"""Building blocks for the SQL equivalents of the registered queries.

Standard SQL as DuckDB runs it over the input tables; used as an independent
check of the Spark plans (a second engine computing the same answer).
"""

from __future__ import annotations

WS = r"[ \t\n\r\f\x0B]"


def strip_ws(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def clean(expr: str, mode: str = "delete") -> str:
    low = f"lower({expr})"
    if mode == "delete":
        return strip_ws(f"regexp_replace({low}, '[^a-z \\t\\n\\r\\f\\x0B]', '', 'g')")
    if mode == "collapse":
        inner = f"regexp_replace({low}, '[^a-z \\t\\n\\r\\f\\x0B]', '', 'g')"
        return strip_ws(f"regexp_replace({inner}, '{WS}+', ' ', 'g')")
    if mode == "space":
        return strip_ws(f"regexp_replace({low}, '[^a-z]+', ' ', 'g')")
    raise ValueError(mode)


def term_ctes(prefix: str, source: str, id_col: str, text_col: str,
              mode: str | None = "delete") -> str:
    """CTEs ``{prefix}_dist(id, t)`` and ``{prefix}_tf(id, term, cnt)``."""
    text = clean(text_col, mode) if mode else text_col
    return f"""
{prefix}_clean AS (SELECT CAST({id_col} AS BIGINT) AS id, {text} AS t FROM {source}),
{prefix}_dist AS (SELECT min(id) AS id, t FROM {prefix}_clean GROUP BY t),
{prefix}_tf AS (
  SELECT id, term, count(*) AS cnt FROM (
    SELECT id, unnest(regexp_split_to_array(t, '{WS}+')) AS term FROM {prefix}_dist) s
  WHERE length(term) >= 2 GROUP BY id, term)"""


def weight_ctes(prefix: str, idf: str) -> str:
    """``{prefix}_w(id, term, w)``: unit-length tf-idf rows."""
    return f"""
{prefix}_w0 AS (SELECT id, term, cnt * idf AS w FROM {prefix}_tf JOIN {idf} USING (term)),
{prefix}_w AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {prefix}_w0)"""


def idf_cte(name: str, *prefixes: str) -> str:
    terms = " UNION ALL ".join(f"SELECT term FROM {p}_tf" for p in prefixes)
    n = " + ".join(f"(SELECT count(*) FROM {p}_dist)" for p in prefixes)
    return f"""
{name}_n AS (SELECT CAST({n} AS DOUBLE) AS n),
{name} AS (SELECT term, count(*) AS df, ln((1 + (SELECT n FROM {name}_n)) / (count(*) + 1.0)) + 1 AS idf
           FROM ({terms}) u GROUP BY term)"""


def best_match_ctes(r_source: str = "documents", r_id: str = "doc_id", r_text: str = "text",
                    j_source: str = "benchmark", j_id: str = "item_id", j_text: str = "text",
                    mode: str = "delete", digits: int = 6) -> str:
    """CTE chain ending in ``best(resume_id, job_id, match_score)``."""
    return ",".join([
        term_ctes("r", r_source, r_id, r_text, mode),
        term_ctes("j", j_source, j_id, j_text, mode),
        idf_cte("vocab", "r", "j"),
        weight_ctes("r", "vocab"),
        weight_ctes("j", "vocab"),
        f"""
dots AS (SELECT r.id AS resume_id, j.id AS job_id, round(sum(r.w * j.w), {digits}) AS score
         FROM r_w r JOIN j_w j USING (term) GROUP BY r.id, j.id),
cand AS (SELECT resume_id, job_id, score FROM dots
         UNION ALL SELECT id, (SELECT min(id) FROM j_dist), 0.0 FROM r_dist),
best AS (SELECT resume_id, job_id, score AS match_score FROM (
           SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY score DESC, job_id) AS rn
           FROM cand) x WHERE rn = 1)"""])


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"
