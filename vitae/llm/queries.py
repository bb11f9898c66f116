"""The registered queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

from vitae.llm import (conversations, embedding_dedup, exact_dedup, hard_negatives, html_extract, lm_scoring, mixing,
                       near_dedup, packing, quality, substring_dedup, token_output, toxicity)
from vitae.sources.tables import table

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return add


@query()
def op1_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents", "doc_id", "text"),
                                    table(spark, sf_dir, "labels"))


@query()
def op2_quality(spark, sf_dir):
    return quality.score_documents(table(spark, sf_dir, "documents", "doc_id", "text"),
                                   table(spark, sf_dir, "labels"))


@query(exact_dedup.REPORT_SQL)
def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.report(table(spark, sf_dir, "documents"), keep="largest")


@query(mixing.REPORT_SQL)
def op5_mixing(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


@query()
def op8_token_output(spark, sf_dir):
    return token_output.report(table(spark, sf_dir, "documents", "doc_id", "text"))


@query()
def op9_packing(spark, sf_dir):
    return packing.report(table(spark, sf_dir, "documents", "doc_id", "text"))


@query(substring_dedup.REPORT_SQL)
def op3_substring_dedup(spark, sf_dir):
    return substring_dedup.report(table(spark, sf_dir, "documents", "doc_id", "text"))


@query()
def op6_near_dedup(spark, sf_dir):
    return near_dedup.report(table(spark, sf_dir, "documents", "doc_id", "text"))


@query(embedding_dedup.REPORT_SQL)
def op7_embedding_dedup(spark, sf_dir):
    return embedding_dedup.report(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query()
def op10_lm_scoring(spark, sf_dir):
    return lm_scoring.score(table(spark, sf_dir, "documents", "doc_id", "text"))


@query()
def op11_html_extraction(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query(conversations.REPORT_SQL)
def op12_conversation_repair(spark, sf_dir):
    return conversations.report(table(spark, sf_dir, "conversations"))


@query(hard_negatives.REPORT_SQL)
def op13_hard_negatives(spark, sf_dir):
    return hard_negatives.report(table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"))
