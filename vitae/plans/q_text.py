"""Registered queries: text normalisation, slugs and upload intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitae.functions import text as TX
from vitae.operators import intake as IN
from vitae.plans import sql as S
from vitae.plans.catalog import register
from vitae.sources.io import NO_TEXT
from vitae.sources.tables import table

WSC = r"[ \t\n\r\f\x0B]"


@register("text_normalise", f"""
SELECT doc_id, {S.clean('text', 'delete')} AS clean_delete, {S.clean('text', 'collapse')} AS clean_collapse,
       {S.clean('text', 'space')} AS clean_space,
       len(list_filter(regexp_split_to_array({S.clean('text', 'delete')}, '{WSC}+'), lambda t: length(t) >= 2))
         AS n_terms,
       len(list_filter(regexp_split_to_array(text, '\\n{WSC}*\\n'), lambda p: length({S.strip_ws('p')}) >= 15))
         AS n_paragraphs
FROM documents""")
def text_normalise(spark, sf_dir):
    """The three cleaning variants, term count and paragraph count per document."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", TX.clean("text", "delete").alias("clean_delete"),
                    TX.clean("text", "collapse").alias("clean_collapse"),
                    TX.clean("text", "space").alias("clean_space"),
                    F.size(TX.terms(TX.clean("text", "delete"))).alias("n_terms"),
                    F.size(TX.paragraphs("text")).alias("n_paragraphs"))


@register("role_slugs", f"""
SELECT p_partkey AS job_id, regexp_replace(lower({S.strip_ws('p_name')}), '{WSC}+', '-', 'g') AS slug,
       regexp_replace(lower({S.strip_ws('p_type')}), '{WSC}+', '-', 'g') AS type_slug
FROM part""")
def role_slugs(spark, sf_dir):
    """Role slugs of part names and types."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    return p.select(F.col("p_partkey").alias("job_id"), TX.role_slug("p_name").alias("slug"),
                    TX.role_slug("p_type").alias("type_slug"))


# Intake limits and allowed name endings used for the pages table
# (host names stand in for file names; ten pages form one upload batch).
PAGE_EXTENSIONS = ["com", "org"]
PAGE_MAX_FILE = 8 * 1024
PAGE_MAX_BATCH = 64 * 1024


def _pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return p.select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("filename"),
                    F.octet_length("html").cast("long").alias("size"),
                    F.floor(F.col("page_id") / 10).cast("long").alias("batch_id"))


_PAGES_SQL = """pg AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS filename,
                 CAST(strlen(html) AS BIGINT) AS size,
                 CAST(floor(page_id / 10) AS BIGINT) AS batch_id FROM pages),
tot AS (SELECT batch_id, sum(size) AS bytes FROM pg GROUP BY batch_id),
v AS (SELECT pg.*, CASE WHEN contains(filename, '.') THEN lower(string_split(filename, '.')[-1]) END AS extension,
             tot.bytes FROM pg JOIN tot USING (batch_id)),
val AS (SELECT page_id, filename, size, batch_id, extension,
           CASE WHEN bytes > {mb} THEN 'rejected'
                WHEN NOT coalesce(extension IN ({ex}), false) THEN 'rejected'
                WHEN size > {mf} THEN 'rejected' ELSE 'processed' END AS status,
           CASE WHEN bytes > {mb} THEN 'Total size exceeds batch limit'
                WHEN NOT coalesce(extension IN ({ex}), false) THEN 'Invalid file type'
                WHEN size > {mf} THEN 'File exceeds size limit' END AS error,
           CASE WHEN size = 0 THEN '0 Bytes' ELSE
             regexp_replace(regexp_replace(printf('%.2f', round(size / pow(1024.0, floor(log(size) / log(1024))), 2)),
                                           ',', '', 'g'), '\\.?0+$', '')
             || ' ' || ['Bytes', 'KB', 'MB', 'GB'][CAST(floor(log(size) / log(1024)) AS INTEGER) + 1] END AS size_text
    FROM v)""".format(mb=PAGE_MAX_BATCH, mf=PAGE_MAX_FILE, ex=", ".join(f"'{e}'" for e in PAGE_EXTENSIONS))


@register("intake_validate", f"WITH {_PAGES_SQL}\nSELECT * FROM val")
def intake_validate(spark, sf_dir):
    """Extension and size checks per file, batch total cap, readable sizes."""
    return IN.validate_intake(_pages(spark, sf_dir), extensions=PAGE_EXTENSIONS,
                              max_file=PAGE_MAX_FILE, max_batch=PAGE_MAX_BATCH)


@register("intake_counts", f"""WITH {_PAGES_SQL}
SELECT batch_id, count(*) FILTER (WHERE status = 'processed') AS processed,
       count(*) FILTER (WHERE status NOT IN ('processed', 'pending')) AS errors,
       count(*) FILTER (WHERE status = 'processed') > 0 AS success
FROM val GROUP BY batch_id""")
def intake_counts(spark, sf_dir):
    """Processed and error counts and success flag per upload batch."""
    v = IN.validate_intake(_pages(spark, sf_dir), extensions=PAGE_EXTENSIONS,
                           max_file=PAGE_MAX_FILE, max_batch=PAGE_MAX_BATCH)
    return IN.intake_counts(v)


@register("intake_processed", f"""WITH {_PAGES_SQL}
SELECT page_id, filename, size, batch_id FROM val WHERE status = 'processed'""")
def intake_processed(spark, sf_dir):
    """Files passed on to parsing."""
    v = IN.validate_intake(_pages(spark, sf_dir), extensions=PAGE_EXTENSIONS,
                           max_file=PAGE_MAX_FILE, max_batch=PAGE_MAX_BATCH)
    return IN.processed_only(v).select("page_id", "filename", "size", "batch_id")


@register("intake_parsed", """
SELECT source AS batch_id, count(*) FILTER (WHERE coalesce(text, '') <> '') AS processed,
       count(*) FILTER (WHERE coalesce(text, '') = '') AS errors,
       count(*) FILTER (WHERE coalesce(text, '') <> '') > 0 AS success
FROM documents GROUP BY source""")
def intake_parsed(spark, sf_dir):
    """Documents as files of their source's batch: processed, or a parse error where there is no text."""
    docs = table(spark, sf_dir, "documents", "source", "text")
    error = F.when(F.coalesce("text", F.lit("")) == "", NO_TEXT)
    files = docs.select(F.col("source").alias("batch_id"), F.lit("processed").alias("status"), error.alias("error"))
    return IN.intake_counts(IN.parsed(files))
