"""TF-IDF and cosine similarity as distributed joins over a long term table.

Layout: a *term table* ``(id, term, cnt)`` with one row per distinct text and
term; never a dense matrix. Distinct texts are found by a 128-bit digest of the
cleaned text, so the shuffle that deduplicates carries digests and counts,
never the text itself. A text's id is the smallest source id among its copies
(first occurrence keeps its place).

Weights follow the smoothed inverse document frequency
``idf = ln((1 + n) / (1 + df)) + 1`` with raw term counts, rows scaled to unit
length; cosine of two rows is then the dot product of their weights.

Scale notes
-----------
* A text's terms are counted in its row; one row a distinct text and task crosses the
  network, and a text's terms lie together in what is stored.
* A side of a best match is shuffled by id only with the terms that the other side has;
  its lengths are sums that leave a task as one row a text.
* Joins with the vocabulary and with the job side broadcast only after a row
  count proves them small; otherwise they shuffle on ``term``, with heavy terms
  split by their measured frequency (``skew``).
* The best match sums only pairs whose bound can still win (``impact``), unless
  all pairs that share a term are few.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitae.functions.text import clean, terms, word_share
from vitae.operators import impact
from vitae.operators.skew import join_split, split
from vitae.session import materialize, row_count_at_most

# Rows of a table we allow to be broadcast to every task (each row is a term
# and one or two numbers, well under 100 bytes).
BROADCAST_ROWS = 2_000_000
SCORE_DIGITS = 6
# Common terms per weight of a resume up to which all of them are summed.
DIRECT_ROWS = 8


def _tokens(col, min_len: int, tokens: str):
    if tokens == "split":
        return terms(col, min_len)
    if tokens == "word":
        # maximal runs of word characters (Unicode aware), at least min_len long
        return F.filter(F.regexp_extract_all(col, F.lit(r"(?U)\w+"), 0), lambda t: F.length(t) >= min_len)
    raise ValueError(f"unknown tokens {tokens!r}; use split or word")


def term_table(df: DataFrame, id_col: str, text_col: str, clean_mode: str | None = "delete",
               min_len: int = 2, dedup: bool = True, tokens: str = "split") -> DataFrame:
    """``(id, term, cnt)`` for each distinct cleaned text.

    Texts with no token keep one row with a NULL term and ``cnt = 0`` so that
    they still count as documents and still appear in results. With
    ``dedup=False`` every input id keeps its own rows.
    """
    if not dedup:
        text = clean(F.col(text_col), clean_mode) if clean_mode else F.col(text_col)
        base = df.select(F.col(id_col).cast("long").alias("_id"), text.alias("_t"))
        toks = base.select("_id", _tokens(F.col("_t"), min_len, tokens).alias("_toks"))
        return (toks.select("_id", F.explode_outer("_toks").alias("term"))
                .groupBy("_id", "term").agg(F.count("term").alias("cnt"))
                .select(F.col("_id").alias("id"), "term", F.col("cnt").cast("long").alias("cnt")))
    return distinct_terms(text_rows(df, id_col, text_col, clean_mode, min_len, tokens))


def text_rows(df: DataFrame, id_col: str, text_col: str, clean_mode: str | None = "delete",
              min_len: int = 2, tokens: str = "split") -> DataFrame:
    """``(_id, _digest, _counts)``: each row's 128-bit digest of its cleaned text, and its terms, counted in the row."""
    text = clean(F.col(text_col), clean_mode) if clean_mode else F.col(text_col)
    base = df.select(F.col(id_col).cast("long").alias("_id"), text.alias("_t"))
    return base.select("_id", F.unhex(F.md5("_t")).alias("_digest"),
                       _counted(F.sort_array(_tokens(F.col("_t"), min_len, tokens))).alias("_counts"))


def distinct_terms(rows: DataFrame) -> DataFrame:
    """``term_table`` of ``text_rows``: a task sends one row of each text, however many copies of it there are."""
    # the smallest id that is not null, with the counts, which are the same in all copies
    first = rows.groupBy("_digest").agg(F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_counts"))).alias("x"))
    return (first.select(F.col("x._id").alias("id"), F.explode_outer("x._counts").alias("c"))
            .select("id", F.col("c.term").alias("term"), F.coalesce("c.cnt", F.lit(0).cast("long")).alias("cnt")))


def _counted(tokens) -> Column:
    """The distinct entries of a sorted array as (term, cnt): each begins where the entry before differs."""
    def of(s, starts):
        return F.transform(starts, lambda p, k: F.struct(
            F.get(s, p).alias("term"), (F.coalesce(F.get(starts, k + 1), F.size(s)) - p).cast("long").alias("cnt")))

    def counted(s):
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.get(F.transform(F.array(starts), lambda b: of(s, b)), F.lit(0))

    # bound in a lambda, an array is worked out once, not once an entry
    return F.get(F.transform(F.array(tokens), counted), F.lit(0))


def representatives(df: DataFrame, id_col: str, text_col: str, clean_mode: str = "delete") -> DataFrame:
    """``(id, rep)``: the id under which ``term_table`` keeps each row's text.

    The smallest id per digest is a partial aggregation, so a text that very
    many rows share is no hot group; the join back is by digest.
    """
    return representatives_of(materialize(df.select(
        F.col(id_col).cast("long").alias("_id"), F.unhex(F.md5(clean(F.col(text_col), clean_mode))).alias("_digest")), "digests"))


def representatives_of(rows: DataFrame) -> DataFrame:
    """``representatives`` from stored ``text_rows``."""
    rows = rows.select(F.col("_id").alias("id"), F.col("_digest").alias("digest"))
    reps = rows.groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("rep"))
    return rows.join(reps, F.col("digest").eqNullSafe(F.col("d"))).select("id", "rep")


def text_ids(tt: DataFrame) -> DataFrame:
    """One row per distinct text of a term table."""
    return tt.select("id").distinct()


@dataclass
class Vocabulary:
    """Fitted idf: ``table`` is ``(term, idf)``; ``n`` the number of texts."""

    table: DataFrame
    n: int


def fit_idf(*term_tables: DataFrame, materialize_result: bool = True) -> Vocabulary:
    """Document frequency and smoothed idf over the given term tables (D3, M1, M2).

    Each table counts its own texts (a text present on two sides counts twice,
    as when the corpora are concatenated before fitting).
    """
    n = 0
    dfs = None
    for tt in term_tables:
        n += text_ids(tt).count()
        part = tt.where(F.col("term").isNotNull()).select("term")
        dfs = part if dfs is None else dfs.unionByName(part)
    vocab = (dfs.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
             .select("term", "df",
                     (F.log((F.lit(1.0) + n) / (F.col("df") + 1.0)) + 1.0).alias("idf")))
    if materialize_result:
        vocab = materialize(vocab, "vocabulary")
    return Vocabulary(vocab, n)


def fit_idf_weighted(tt: DataFrame, doc_weights: DataFrame,
                     materialize_result: bool = False) -> Vocabulary:
    """Idf when each text stands for ``weight`` identical documents.

    ``doc_weights`` is ``(id, weight)``; df(t) = Σ weight of texts holding t and
    n = Σ weight. Used when rows of a corpus repeat a text (one candidate, many
    applications) without exploding the repeats.
    """
    n = int(doc_weights.agg(F.sum("weight")).first()[0] or 0)
    vocab = (tt.where(F.col("term").isNotNull()).select("id", "term")
             .join(doc_weights, "id")
             .groupBy("term").agg(F.sum("weight").alias("df"))
             .select("term", "df",
                     (F.log((F.lit(1.0) + n) / (F.col("df") + 1.0)) + 1.0).alias("idf")))
    if materialize_result:
        vocab = materialize(vocab, "vocabulary")
    return Vocabulary(vocab, n)


def _join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
                limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join, broadcasting ``small`` only when a row count proves it small."""
    if row_count_at_most(small, limit):
        return big.join(F.broadcast(small), on, how)
    return join_split(big, small, [on], how)


def weights(tt: DataFrame, vocab: Vocabulary, normalise: bool = True,
            keep_empty: bool = False, only: DataFrame | None = None) -> DataFrame:
    """``(id, term, w)``: count × idf, scaled to unit length per id.

    Terms outside the vocabulary are dropped (M2/M4: apply a stored vocabulary).
    The unit-length step is a window partitioned by ``id``; the result stays
    hash-partitioned by ``id`` so later per-id aggregations need no shuffle.

    With ``only``, distinct ``(term)`` small enough to broadcast, just the rows of these
    terms are given and shuffled, in unit length over all terms of their id.
    """
    rows = tt.where(F.col("term").isNotNull())
    table = vocab.table.select("term", "idf")
    w = _join_small(rows, table, "term").select("id", "term", (F.col("cnt") * F.col("idf")).alias("w"))
    if normalise and only is not None:
        # a text's sum of squares goes along with its rows as a row without a term
        none = F.lit(None)
        squares = w.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("_sq")).select(
            "id", none.cast("string").alias("term"), none.cast("double").alias("w"), "_sq")
        some = rows.join(F.broadcast(table.join(F.broadcast(only), "term")), "term").select(
            "id", "term", (F.col("cnt") * F.col("idf")).alias("w"), none.cast("double").alias("_sq"))
        norm = F.sqrt(F.sum("_sq").over(Window.partitionBy("id")))
        return some.unionByName(squares).withColumn("_norm", norm).where("term IS NOT NULL").select(
            "id", "term", (F.col("w") / F.col("_norm")).alias("w"))
    if normalise:
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
        w = w.select("id", "term", (F.col("w") / norm).alias("w"))
    return w


def dot_products(left: DataFrame, right: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Sparse dot products ``(lid, rid, dot)`` of two weight tables.

    Only pairs sharing a term are produced. When ``right`` is proven small it is
    broadcast and the per-pair sums are finished in the tasks that hold each
    ``left`` id (``left`` is partitioned by id), so no shuffle follows.
    Otherwise both sides shuffle on the term, heavy terms split by their
    measured frequency.
    """
    l = left.select(F.col("id").alias("lid"), "term", F.col("w").alias("lw"))
    r = right.select(F.col("id").alias("rid"), "term", F.col("w").alias("rw"))
    pairs = l.join(F.broadcast(r), "term") if row_count_at_most(r, limit) else join_split(l, r, ["term"])
    return pairs.groupBy("lid", "rid").agg(F.sum(F.col("lw") * F.col("rw")).alias("dot"))


def best_match(resumes: DataFrame, jobs: DataFrame, *, id_col_r: str = "doc_id",
               text_col_r: str = "text", id_col_j: str = "item_id",
               text_col_j: str = "text", clean_mode: str = "delete",
               digits: int = SCORE_DIGITS, limit: int = BROADCAST_ROWS, pruned: bool | None = None,
               rows_r: DataFrame | None = None) -> DataFrame:
    """Best job per distinct resume text by TF-IDF cosine.

    The vocabulary is fitted on distinct resumes and distinct jobs together.
    Scores are rounded to ``digits`` decimals before the arg-max so that float
    summation order cannot change the winner; ties go to the smallest job id.
    A resume sharing no term with any job gets the first job (smallest id) with
    score 0. Output: ``resume_id, job_id, match_score``. ``rows_r``: the resumes' ``text_rows``, if they are stored.
    """
    if rows_r is None:
        rows_r = text_rows(resumes, id_col_r, text_col_r, clean_mode)
    tr = materialize(distinct_terms(rows_r), "terms_r")
    tj = materialize(term_table(jobs, id_col_j, text_col_j, clean_mode), "terms_j")
    vocab = fit_idf(tr, tj)
    if pruned is None:
        # the vocabulary has each term's rows of both sides together, so the many resumes need no second count
        b = tj.where(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("b"))
        common = vocab.table.join(b, "term").agg(F.sum((F.col("df") - F.col("b")) * F.col("b"))).first()[0] or 0
        pruned = _prunes(common, tr)
    return best_match_from_terms(tr, tj, vocab, digits=digits, limit=limit, pruned=pruned)


def _prunes(common: int, tr: DataFrame) -> bool:
    return common > DIRECT_ROWS * tr.count()


def common_rows(left: DataFrame, right: DataFrame) -> int:
    """Rows of the equi-join of two term tables on their terms, from the counts of the right side's terms."""
    counts = right.where(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("b"))
    return int(_join_small(left.select("term"), counts, "term").agg(F.sum("b")).first()[0] or 0)


def _terms_if_few(tt: DataFrame, limit: int) -> DataFrame | None:
    """The distinct terms of a term table if the table has at most ``limit`` rows, else None."""
    return tt.where(F.col("term").isNotNull()).select("term").distinct() if row_count_at_most(tt, limit) else None


def best_match_from_terms(tr: DataFrame, tj: DataFrame, vocab: Vocabulary, *, digits: int = SCORE_DIGITS,
                          limit: int = BROADCAST_ROWS, pruned: bool | None = None) -> DataFrame:
    """``best_match`` from term tables. ``pruned`` None leaves it to the work which plan is taken.

    All common terms are summed where they are at most ``DIRECT_ROWS`` for each
    row of the resumes' weights, which is then work in proportion to them; else the index
    ordered by impact sums only pairs that can win. Both give the same rows.
    """
    # terms that one side lacks add to no score: where the other has few, only its terms are shuffled
    few_r, few_j = _terms_if_few(tr, limit), _terms_if_few(tj, limit)
    wr, wj = weights(tr, vocab, only=few_j), weights(tj, vocab, only=few_r)
    if pruned is None:
        pruned = _prunes(common_rows(tr, tj), tr)
    if pruned:
        scored = impact.best_scores(materialize(wr, "weights_r"), wj, digits, limit=limit)
    else:  # the weights keep their partitioning by id, which the sums and the best of each reuse
        scored = dot_products(wr, wj, limit=limit).select("lid", "rid", F.round("dot", digits).alias("score"))
    # The largest score, then the smallest id: ~id falls as id rises, for any long. A score that rounds to 0
    # ties with every job, also with those that share no term: the first one is named.
    first_job = tj.agg(F.min("id")).first()[0]
    zero = text_ids(tr).select(F.col("id").alias("lid"), F.lit(first_job).cast("long").alias("rid"), F.lit(0.0).alias("score"))
    best = scored.unionByName(zero).groupBy("lid").agg(
        F.max(F.struct("score", F.bitwise_not("rid").alias("later"))).alias("k"))
    return best.select(F.col("lid").alias("resume_id"), F.bitwise_not("k.later").alias("job_id"),
                       F.col("k.score").alias("match_score"))


def rowwise_cosine(pairs: DataFrame, left_w: DataFrame, right_w: DataFrame, digits: int | None = SCORE_DIGITS,
                   words: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Cosine of given ``(lid, rid)`` pairs only — the diagonal, never the product.

    A text's weights are one row (a map from term to weight), so a pair stays one
    row: it meets its right text by ``rid``, then its left text by ``lid``, and
    its score is summed there over the terms that both maps hold. Ids that many
    pairs share are split by their measured frequency among the pairs, before
    any text is joined. Pairs without a shared term get 0. Output ``lid, rid, score``,
    and with ``words``, each side's ``(id, words)``, also ``keywords``: the share of
    the right text's words among the left text's.
    """
    pairs = materialize(pairs.select("lid", "rid"), "pairs")
    lw, rw = term_maps(left_w, "lid", "lw"), term_maps(right_w, "rid", "rw")
    if words:
        lw = words[0].select(F.col("id").alias("lid"), F.col("words").alias("have")).join(lw, "lid", "left")
        rw = words[1].select(F.col("id").alias("rid"), F.col("words").alias("need")).join(rw, "rid", "left")
    dealt, lw = split(pairs, lw, ["lid"], "_lpart")
    dealt, rw = split(dealt, rw, ["rid"], "_rpart")
    # never broadcast: the files of term tables are small beside their rows
    met = dealt.join(rw.hint("merge"), ["rid", "_rpart"], "left").join(lw.hint("merge"), ["lid", "_lpart"], "left")
    common = F.array_intersect(F.map_keys("lw"), F.map_keys("rw"))
    dot = F.aggregate(common, F.lit(0.0), lambda total, t: total + F.element_at("lw", t) * F.element_at("rw", t))
    # a pair that comes n times sums n times its products, and comes n times
    sums = [F.sum("dot").alias("dot"), F.count(F.lit(1)).alias("n")] + ([F.max("keywords").alias("keywords")] if words else [])
    dots = met.select("lid", "rid", F.coalesce(dot, F.lit(0.0)).alias("dot"),
                      *([word_share("have", "need").alias("keywords")] if words else [])).groupBy("lid", "rid").agg(*sums)
    return (dots.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
            .select("lid", "rid", (F.round("dot", digits) if digits is not None else F.col("dot")).alias("score"),
                    *(["keywords"] if words else [])))


def pair_rows(pairs: DataFrame, left: DataFrame, right: DataFrame, lid: str = "lid", rid: str = "rid") -> DataFrame:
    """Stored ``pairs`` with the columns of the row of ``left`` of their ``lid`` and of ``right`` of their ``rid``.

    The right side first, which should be the narrower one: a pair crosses the network
    twice, and comes out where the left rows are. Neither side is broadcast, whatever its
    files' size lets the optimizer think of it. Ids that many pairs share are split.
    """
    dealt, left = split(pairs, left, [lid], "_lpart")
    dealt, right = split(dealt, right, [rid], "_rpart")
    return dealt.join(right.hint("merge"), [rid, "_rpart"]).join(left.hint("merge"), [lid, "_lpart"]).drop("_lpart", "_rpart")


def map_product(lw: str, rw: str) -> Column:
    """Sum of the products of the weights of the terms that both maps hold; a missing map holds none."""
    return F.coalesce(F.aggregate(F.map_entries(rw), F.lit(0.0), lambda total, e: total + F.coalesce(
        F.try_element_at(F.col(lw), e["key"]), F.lit(0.0)) * e["value"]), F.lit(0.0))


def term_maps(weights: DataFrame, id_col: str, out: str) -> DataFrame:
    """``(id_col, out)``: the terms and weights of each text as one map."""
    return weights.groupBy(F.col("id").alias(id_col)).agg(
        F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias(out))


def pair_similarity(pairs: DataFrame, left_tt: DataFrame, right_tt: DataFrame,
                    digits: int | None = 4) -> DataFrame:
    """Cosine when the vectorizer is refitted on each pair alone.

    With two documents the idf is closed form: 1 for a term on both sides,
    ``1 + ln 1.5`` for a term on one side, so no fit is run. A pair with no
    token on either side scores 0 (the batch continues).
    ``pairs`` holds ``(lid, rid)``; term tables hold ``(id, term, cnt)``.
    Output ``lid, rid, score``.
    """
    one_side = 1.0 + math.log(1.5)
    pairs = materialize(pairs.select("lid", "rid"), "pairs")
    l = join_split(pairs, left_tt.where(F.col("term").isNotNull()).select(
        F.col("id").alias("lid"), "term", F.col("cnt").alias("lc")), ["lid"])
    r = join_split(pairs, right_tt.where(F.col("term").isNotNull()).select(
        F.col("id").alias("rid"), "term", F.col("cnt").alias("rc")), ["rid"])
    both = l.join(r, ["lid", "rid", "term"], "full_outer")
    idf = F.when(F.col("lc").isNotNull() & F.col("rc").isNotNull(), F.lit(1.0)).otherwise(F.lit(one_side))
    lw = F.coalesce(F.col("lc"), F.lit(0)) * idf
    rw = F.coalesce(F.col("rc"), F.lit(0)) * idf
    agg = both.groupBy("lid", "rid").agg(
        F.sum(lw * rw).alias("dot"), F.sum(lw * lw).alias("ll"), F.sum(rw * rw).alias("rr"))
    score = F.when((F.col("ll") > 0) & (F.col("rr") > 0),
                   F.col("dot") / (F.sqrt("ll") * F.sqrt("rr"))).otherwise(F.lit(0.0))
    res = agg.select("lid", "rid", score.alias("score"))
    sc = F.coalesce("score", F.lit(0.0))
    return (pairs.select("lid", "rid").join(res, ["lid", "rid"], "left")
            .select("lid", "rid", (F.round(sc, digits) if digits is not None else sc).alias("score")))
