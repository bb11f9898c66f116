"""Strict skill texts: synonyms rewritten and weighted skills repeated, by joins with tables of any size.

Rules replace whole words, in their order, each on what the earlier ones left. A
cleaned text's words are letters only and stand apart, so each word rewrites
alone: the rules are closed once, word by word, and texts meet the closed table in
one join on their words. A weighted skill that stands in the rewritten text
as a whole counts ``int(2 · weight)`` times more; the texts meet the skills in one
join on runs of words, and the repeats are added to the term counts, so no
text grows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitae.functions.text import clean
from vitae.operators.extract import VOCABULARY_ROWS, detect_skills
from vitae.operators.skew import join_split
from vitae.session import materialize, row_count_at_most

_WORDS = r"(?U)\w+"
_RULES, _WEIGHTS = "ord long, synonym string, standard string", "skill string, weight double"


def rules_table(spark: SparkSession, synonyms: Mapping[str, str] | DataFrame) -> DataFrame:
    """``(ord, synonym, standard)`` of a dictionary in its order, or as given."""
    if isinstance(synonyms, DataFrame):
        return synonyms
    return spark.createDataFrame([(k, s, t) for k, (s, t) in enumerate(synonyms.items())], _RULES)


def weights_table(spark: SparkSession, weights: Mapping[str, float] | DataFrame) -> DataFrame:
    """``(skill, weight)`` of a dictionary, or as given."""
    if isinstance(weights, DataFrame):
        return weights
    return spark.createDataFrame([(s, float(w)) for s, w in weights.items()], _WEIGHTS)


def _replaced(text: Column, word: Column, by: Column) -> Column:
    """``text`` with ``word`` replaced wherever it stands between word boundaries, whatever its case."""
    escaped = F.regexp_replace(by, r"([\\$])", r"\\$1")
    return F.regexp_replace(text, F.concat(F.lit(r"(?iU)\b\Q"), word, F.lit(r"\E\b")), escaped)


def closed_synonyms(rules: DataFrame) -> DataFrame:
    """``(term, standard)``: what each rule's word becomes once all rules have been applied to it in order (H4, C4).

    A round applies to every word the next rule that its text holds; a rule
    is applied once, so there are as many rounds as the longest chain has rules.
    """
    rules = materialize(rules.select(F.col("ord").cast("long").alias("ord"), F.lower("synonym").alias("synonym"), "standard"), "rules")
    state = rules.select(F.col("synonym").alias("term"), F.col("synonym").alias("text")).distinct().withColumn("last", F.lit(None).cast("long"))
    done = None
    while True:
        state = materialize(state, "closing")
        held = detect_skills(state, rules, "term", "text", "synonym").select("term", F.explode("skills").alias("synonym"))
        # the next rule of a word: the least place after the last one applied
        following = (held.join(rules, "synonym").join(state.select("term", "last"), "term")
                     .where(F.col("last").isNull() | (F.col("ord") > F.col("last")))
                     .groupBy("term").agg(F.min(F.struct("ord", "synonym", "standard")).alias("r")))
        step = materialize(state.join(following, "term", "left"), "closed")
        ended = step.where("r IS NULL").select("term", F.col("text").alias("standard"))
        done = ended if done is None else done.unionByName(ended)
        state = step.where("r IS NOT NULL").select(
            "term", _replaced(F.col("text"), F.col("r.synonym"), F.col("r.standard")).alias("text"), F.col("r.ord").alias("last"))
        if state.isEmpty():
            return done.where("term <> standard")


def rewritten(texts: DataFrame, closed: DataFrame | None) -> DataFrame:
    """``(id, text)``: the words of each text (``id, text``, ids distinct) replaced by their standard (H4)."""
    if closed is None:
        return texts.select("id", "text")
    words = texts.select("id", F.posexplode(F.split("text", " ")).alias("pos", "term"))
    few = row_count_at_most(closed, VOCABULARY_ROWS)
    met = words.join(F.broadcast(closed), "term", "left") if few else join_split(words, closed.hint("merge"), ["term"], "left")
    word = F.coalesce("standard", "term")
    return met.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", word.alias("word")))),
                                                          lambda s: s["word"]), " ").alias("text"))


def boosts(texts: DataFrame, weights: DataFrame) -> DataFrame:
    """``(id, term, cnt)``: what the weighted skills in each text add to its term counts (H5)."""
    skills = weights.select(F.lower("skill").alias("skill"), F.floor(F.col("weight") * 2).cast("long").alias("cnt"))
    found = detect_skills(texts, skills, "id", "text", "skill").select("id", F.explode("skills").alias("skill"))
    # the texts' side is never broadcast: its files are small beside its rows
    met = F.broadcast(skills) if row_count_at_most(skills, VOCABULARY_ROWS) else skills.hint("merge")
    return found.join(met, "skill").where("cnt > 0").select(
        "id", F.explode(F.regexp_extract_all("skill", F.lit(_WORDS), 0)).alias("term"), "cnt").where(F.length("term") >= 2)


def strict_texts(rows: DataFrame, id_col: str, skills: Column, synonyms: Mapping[str, str] | DataFrame) -> DataFrame:
    """``(id, text)``: skills joined by a space, cleaned to letters and spaces, synonyms rewritten (H3, H4)."""
    text = clean(F.array_join(F.coalesce(skills, F.array().cast("array<string>")), " "), "space")
    base = materialize(rows.select(F.col(id_col).cast("long").alias("id"), text.alias("text")), "strict-base")
    rules = rules_table(rows.sparkSession, synonyms)
    return materialize(rewritten(base, None if rules.isEmpty() else closed_synonyms(rules)), "strict-texts")


def strict_terms(texts: DataFrame, weights: Mapping[str, float] | DataFrame) -> DataFrame:
    """``(id, term, cnt)`` of strict texts with their boosts; a text without a word keeps a NULL term."""
    words = texts.select("id", F.explode_outer(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(_WORDS), 0),
                                                        lambda w: F.length(w) >= 2)).alias("term"))
    counts = words.groupBy("id", "term").agg(F.count("term").alias("cnt"))
    table = weights_table(texts.sparkSession, weights)
    if not table.isEmpty():
        counts = counts.unionByName(boosts(texts, table)).groupBy("id", "term").agg(F.sum("cnt").alias("cnt"))
    return counts


def distinct_texts(texts: DataFrame) -> DataFrame:
    """One row per distinct text, under its smallest id."""
    kept = texts.groupBy(F.md5("text").alias("digest")).agg(F.min("id").alias("id"))
    return texts.join(kept.select("id").hint("merge"), "id", "left_semi")
