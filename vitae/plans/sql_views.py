"""SQL forms of the derived views and of the feature assembly."""

from __future__ import annotations

from vitae.functions import dictionaries as D
from vitae.operators.features import rx_escape
from vitae.plans.sql import WS, clean, strip_ws
from vitae.sources.views import SEGMENT_DEGREES, SKILL_LINES


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def degree_case(col: str) -> str:
    whens = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in SEGMENT_DEGREES.items())
    return f"CASE {col} {whens} ELSE '' END"


def views(whole_skills: bool = False) -> str:
    """CTEs of the derived views; ``whole_skills``: every word of a customer's lines is a skill."""
    often = "" if whole_skills else f"\n  WHERE c * {SKILL_LINES} >= n"
    return f"""
cust_lines AS (
  SELECT o.o_custkey, p.p_name, p.p_brand, p.p_size
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey),
cand_words AS (
  SELECT o_custkey, w, count(*) AS c FROM (
    SELECT o_custkey, unnest(list_distinct(string_split(p_name, ' '))) AS w FROM cust_lines) s GROUP BY o_custkey, w),
cand_skills AS (
  SELECT o_custkey, list_sort(list(w)) AS skills
  FROM cand_words JOIN (SELECT o_custkey, count(*) AS n FROM cust_lines GROUP BY o_custkey) l USING (o_custkey){often}
  GROUP BY o_custkey),
cand_certs AS (
  SELECT o_custkey, list_sort(list_distinct(list(p_brand))) AS certifications
  FROM cust_lines WHERE p_size < 10 GROUP BY o_custkey),
cand_fin AS (
  SELECT o_custkey, sum(date_diff('day', CAST(o_orderdate AS DATE), CAST(last_ship AS DATE))) AS days
  FROM (SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, max(l.l_shipdate) AS last_ship
        FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
        WHERE o.o_orderstatus = 'F' GROUP BY o.o_orderkey, o.o_custkey, o.o_orderdate) f
  GROUP BY o_custkey),
cand AS (
  SELECT c.c_custkey AS resume_id, c.c_name AS name,
         lower(replace(c.c_name, '#', '.')) || '@example.com' AS email,
         '555-' || lpad(CAST(c.c_custkey % 1000 AS VARCHAR), 3, '0') || '-'
           || lpad(CAST(c.c_custkey % 10000 AS VARCHAR), 4, '0') AS phone, s.skills, ce.certifications,
         {degree_case('c.c_mktsegment')} AS degree,
         CAST(coalesce(f.days, 0) AS BIGINT) AS experience_days
  FROM customer c
  LEFT JOIN cand_skills s ON s.o_custkey = c.c_custkey
  LEFT JOIN cand_certs ce ON ce.o_custkey = c.c_custkey
  LEFT JOIN cand_fin f ON f.o_custkey = c.c_custkey),
jobs AS (
  SELECT p_partkey AS job_id, p_name AS title, string_split(p_name, ' ') AS skills_required,
         [p_brand] AS job_certifications FROM part),
apps AS (
  SELECT DISTINCT o.o_custkey AS resume_id, l.l_partkey AS job_id
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey),
trows AS (
  SELECT a.resume_id, a.job_id, c.name, c.skills, c.certifications, c.degree, c.experience_days,
         j.skills_required, j.job_certifications
  FROM apps a JOIN cand c USING (resume_id) JOIN jobs j USING (job_id)
  WHERE c.skills IS NOT NULL AND j.skills_required IS NOT NULL)"""


VIEWS = views()


def skills_text(col: str, mode: str | None = "collapse") -> str:
    joined = f"array_to_string(list_transform({col}, lambda x: {strip_ws('lower(x)')}), ' ')"
    return clean(joined, mode) if mode else joined


def ladder_values(ladder: dict[str, float], whole_word: bool = True) -> str:
    rows = []
    for term, level in ladder.items():
        pat = rx_escape(term)
        pat = f"\\b{pat}\\b" if whole_word else pat
        rows.append(f"({sql_str(pat)}, {float(level)})")
    return "(VALUES " + ", ".join(rows) + ") AS ladder(pat, level)"


def education_sql(col: str, ladder: dict[str, float] | None = None, whole_word: bool = True) -> str:
    ladder = ladder if ladder is not None else D.DEGREE_LEVELS_TRAINING
    text = strip_ws(f"lower({col})")
    return (f"coalesce((SELECT max(level) FROM {ladder_values(ladder, whole_word)} "
            f"WHERE regexp_matches({text}, pat)), 0.0)")


def words_sql(expr: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({expr}, '{WS}+'), lambda x: x <> ''))"


def keyword_sql(have: str, need: str) -> str:
    n = words_sql(need)
    h = words_sql(have)
    return (f"CASE WHEN coalesce(len({n}), 0) = 0 THEN 0.0 ELSE "
            f"len(list_filter({n}, lambda kw: list_contains({h}, kw))) / len({n}) END")


def features_ctes(weights=D.WEIGHTS_CASUAL, threshold=D.LABEL_THRESHOLD_FULL,
                  digits: int = 6, whole_skills: bool = False) -> str:
    """CTEs ending in ``feats(resume_id, job_id, <5 features>, match_score, label)``."""
    rt = skills_text("skills")
    jt = skills_text("skills_required")
    w = [float(x) for x in weights]
    return views(whole_skills) + f""",
ftexts AS (SELECT resume_id, job_id, {rt} AS rt, {jt} AS jt, certifications, degree, experience_days
           FROM trows),
fc AS (SELECT resume_id AS id, any_value(rt) AS t, count(*) AS nrows FROM ftexts GROUP BY resume_id),
fj AS (SELECT DISTINCT job_id AS id, jt AS t FROM ftexts),
fc_tf AS (SELECT id, term, count(*) AS cnt FROM (
            SELECT id, unnest(regexp_split_to_array(t, '{WS}+')) AS term FROM fc) s
          WHERE length(term) >= 2 GROUP BY id, term),
fj_tf AS (SELECT id, term, count(*) AS cnt FROM (
            SELECT id, unnest(regexp_split_to_array(t, '{WS}+')) AS term FROM fj) s
          WHERE length(term) >= 2 GROUP BY id, term),
fvocab AS (SELECT term, ln((1 + (SELECT CAST(sum(nrows) AS DOUBLE) FROM fc)) / (sum(nrows) + 1.0)) + 1 AS idf
           FROM fc_tf JOIN fc USING (id) GROUP BY term),
fc_w0 AS (SELECT id, term, cnt * idf AS w FROM fc_tf JOIN fvocab USING (term)),
fc_w AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM fc_w0),
fj_w0 AS (SELECT id, term, cnt * idf AS w FROM fj_tf JOIN fvocab USING (term)),
fj_w AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM fj_w0),
fdot AS (SELECT p.resume_id, p.job_id, sum(r.w * j.w) AS dot
         FROM ftexts p JOIN fc_w r ON r.id = p.resume_id
         JOIN fj_w j ON j.id = p.job_id AND j.term = r.term GROUP BY p.resume_id, p.job_id),
fraw AS (
  SELECT p.resume_id, p.job_id, coalesce(d.dot, 0.0) AS skill_similarity,
         {education_sql('p.degree')} / 5.0 AS education_score,
         coalesce(len(p.certifications), 0) / 10.0 AS certification_count,
         least(p.experience_days / 365.0, 20.0) / 20.0 AS experience_score,
         coalesce({keyword_sql('p.rt', 'p.jt')}, 0.0) AS keyword_match
  FROM ftexts p LEFT JOIN fdot d USING (resume_id, job_id)),
fscored AS (
  SELECT *, skill_similarity * {w[0]} + education_score * {w[1]} + certification_count * {w[2]}
            + experience_score * {w[3]} + keyword_match * {w[4]} AS match_score FROM fraw),
feats AS (
  SELECT resume_id, job_id, round(skill_similarity, {digits}) AS skill_similarity,
         round(education_score, {digits}) AS education_score,
         round(certification_count, {digits}) AS certification_count,
         round(experience_score, {digits}) AS experience_score,
         round(keyword_match, {digits}) AS keyword_match,
         round(match_score, {digits}) AS match_score,
         CAST(match_score > {float(threshold)} AS INTEGER) AS label
  FROM fscored)"""


RESUME_DOCS = """
rd_lines AS (
  SELECT l.l_orderkey, l.l_linenumber, p.p_name, p.p_brand, p.p_size, o.o_custkey, o.o_orderdate,
         concat_ws(chr(10),
              upper(substr(string_split(p.p_name, ' ')[-1], 1, 1)) || lower(substr(string_split(p.p_name, ' ')[-1], 2))
                || ' Engineer',
              'Acme Corp',
              CAST(year(l.l_shipdate) AS VARCHAR) || ' - ' || CAST(year(l.l_shipdate) + 1 AS VARCHAR)) AS block
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey),
rd_order AS (
  SELECT l_orderkey, o_custkey,
         list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))) AS words,
         coalesce(list_sort(list_distinct(list('- ' || replace(p_brand, '#', ' ') || ' Certified - Acme Board, '
                  || CAST(year(o_orderdate) AS VARCHAR)) FILTER (WHERE p_size < 10))), []) AS cert_lines,
         list(block ORDER BY l_linenumber, block) AS blocks
  FROM rd_lines GROUP BY l_orderkey, o_custkey),
rdocs AS (
  SELECT r.l_orderkey AS doc_id, r.o_custkey AS resume_id,
         concat_ws(chr(10), c.c_name,
                   'Email: ' || lower(replace(c.c_name, '#', '.')) || '@example.com',
                   'Phone: 555-' || lpad(CAST(c.c_custkey % 1000 AS VARCHAR), 3, '0') || '-'
                     || lpad(CAST(c.c_custkey % 10000 AS VARCHAR), 4, '0'),
                   'Skills', array_to_string(r.words, ', '),
                   'Certifications', array_to_string(r.cert_lines, chr(10)),
                   'Experience', array_to_string(r.blocks, chr(10) || chr(10))) AS text
  FROM rd_order r JOIN customer c ON c.c_custkey = r.o_custkey)"""


def vocabulary_sql() -> str:
    """Skill vocabulary from part names: every distinct name and every distinct word."""
    return """
vocab_s AS (SELECT DISTINCT p_name AS skill FROM part
            UNION SELECT DISTINCT unnest(string_split(p_name, ' ')) FROM part)"""
