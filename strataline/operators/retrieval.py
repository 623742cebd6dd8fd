"""Ranked retrieval over tables of queries: BM25, dense vectors, fusion, re-ranking.

A query is a row (query_id, text, and filters where wanted), so one question and a whole evaluation share a plan. Only
the postings of the query terms are read; scores are added up by (query, chunk) before anything is ranked. Whole tables
of queries are better served by one scan of the texts (operators/scan.py). Ties go to the least key. Scores are rounded to six places before ranking, so that the order of additions doesn't show.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataline.functions import text as T
from strataline.operators.repeats import one_per_key

FILTER_KEYS = ("ticker", "company", "cik", "filing_type", "filing_date", "fiscal_year", "accession", "source_url", "source_path", "section_title", "item_number")
K1, B, RRF_K = 1.5, 0.75, 60


def catalog(chunks: DataFrame, *columns: str) -> DataFrame:
    """One row per chunk_id, the first to arrive, with the named columns (all by default); deliveries repeat in ord and loaded_at only."""
    return one_per_key(chunks, "chunk_id", "ord", list(columns) or None)


# ---- lexical index ---------------------------------------------------------------------------------------------------


def postings(docs: DataFrame, key: str = "chunk_id", text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """(term, key, tf, dl), one row for each term of each text; null and blank texts have none. With terms, of those only."""
    t = docs.select(F.col(key), T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    e = t.select(key, F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    if terms is not None:
        e = e.join(terms.select("term").distinct(), "term", "left_semi")
    return e.groupBy("term", key).agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(n, avgdl): over all texts, the empty ones too; 0.0 where there is none."""
    size = F.size(T.tokens(F.coalesce(F.col(text), F.lit(""))))
    return docs.agg(F.count("*").alias("n"), F.coalesce(F.avg(size), F.lit(0.0)).alias("avgdl"))


def term_stats(posts: DataFrame, stats: DataFrame, n: int | None = None) -> DataFrame:
    """(term, df, idf); idf = ln(1 + (n - df + 0.5) / (df + 0.5)) is positive for every term. n is that of the statistics."""
    n = F.lit(stats.first().n if n is None else n)  # one row
    return posts.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def document_frequencies(docs: DataFrame, stats: DataFrame, text: str = "text") -> DataFrame:
    """term_stats() straight from the texts: distinct words of each are counted where they are, so only counts by word are shuffled."""
    n = F.lit(stats.first().n)  # one row
    words = docs.select(F.explode(T.token_set(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): repeated words of a query count as often as they stand there."""
    return queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(posts: DataFrame, stats: DataFrame, queries: DataFrame, key: str = "chunk_id", k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, key, score) of every text that shares a term with the query. Statistics are those of the whole corpus, whatever is filtered afterwards."""
    q, told = query_terms(queries), stats.first()
    own = posts.join(q.select("term").distinct(), "term", "left_semi")
    weighted = own.join(term_stats(own, stats, told.n), "term")
    norm = F.lit(told.avgdl or 1.0)
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / norm))
    scored = weighted.select("term", key, part.alias("part"))
    return scored.join(q, "term").groupBy("query_id", key).agg(F.round(F.sum(F.col("part") * F.col("qtf")), 6).alias("score"))


# ---- filters ---------------------------------------------------------------------------------------------------------


def metadata_filter(where: dict[str, object]) -> Column:
    """Conjunction of equalities on the values as strings; a list means any of it. An unknown key is an error."""
    if unknown := set(where) - set(FILTER_KEYS):
        raise ValueError(f"unknown filter keys: {sorted(unknown)}")
    tests = [F.col(k).isin(*map(str, v)) if isinstance(v, (list, tuple, set)) else F.col(k) == str(v) for k, v in where.items()]
    return reduce(lambda x, y: x & y, tests, F.lit(True))


# ---- ranking ---------------------------------------------------------------------------------------------------------


def ranked(rows: DataFrame, w, k: int) -> DataFrame:
    """The first k rows of each window with their rank from 0. The limit is on the row number itself, so that each task keeps k rows a window before anything is shuffled."""
    first = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return first.withColumn("rank", F.col("rank") - 1)


def top(scores: DataFrame, k: int, *ties: str, score: str = "score", by: str = "query_id") -> DataFrame:
    """The k best rows of each query with their rank from 0; ties in the order of the named columns."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), *ties)
    return ranked(scores, w, k)


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length; the longer vector counts as long as the shorter."""
    n = F.least(F.size(a), F.size(b))
    dot = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    bottom = length(a) * length(b)
    return F.when(bottom == 0, 0.0).otherwise(dot / bottom)


# ---- feature hashing -------------------------------------------------------------------------------------------------


def hash_embedding(docs: DataFrame, key: str = "chunk_id", text: str = "text", dim: int = 256, mode: str = "document") -> DataFrame:
    """(key, idx, w): sparse vectors of length 1. A token goes to md5 mod dim, its sign is bit 8 of the md5.

    mode is document or query; hashing treats both alike, other embedders may not.
    """
    if mode not in ("document", "query"):
        raise ValueError(f"unknown mode {mode!r}")
    from strataline.operators.scan import hash_cells

    return hash_cells(docs, key, text, dim)


def sparse_scores(vectors: DataFrame, queries: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score) of the pairs with a common cell; the others have cosine 0."""
    q = queries.select("query_id", "idx", F.col("w").alias("qw"))
    return vectors.join(q, "idx").groupBy("query_id", key).agg(F.round(F.sum(F.col("w") * F.col("qw")), 6).alias("score"))


# ---- fusion ----------------------------------------------------------------------------------------------------------


def min_max(scores: DataFrame, by: str = "query_id") -> DataFrame:
    """Scores scaled to 0..1 within a list; 1 for all of a list without range."""
    w = Window.partitionBy(by)
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return scores.withColumn("score", F.when(hi - lo < 1e-12, 1.0).otherwise((F.col("score") - lo) / (hi - lo)))


def fuse(dense: DataFrame, lexical: DataFrame, method: str = "rrf", dense_weight: float = 0.5, lexical_weight: float = 0.5, k: int = RRF_K, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, fused, dense, bm25, dense_rank, bm25_rank) of the union of two ranked candidate lists.

    Where one list of a query is empty, the scores of the other pass through unchanged. rrf adds weight / (k + rank + 1),
    weighted adds the min-max scores by weight; what a list lacks counts 0.
    """
    if method not in ("rrf", "weighted"):
        raise ValueError(f"unknown fusion {method!r}")
    scaled = (lambda d: d) if method == "rrf" else min_max
    parts = []
    for name, table, weight in (("dense", dense, dense_weight), ("bm25", lexical, lexical_weight)):
        own = table.select("query_id", key, "score", "rank")
        value = F.lit(weight) / (k + F.col("rank") + 1) if method == "rrf" else F.lit(weight) * F.col("scaled")
        own = own.join(scaled(own).select("query_id", key, F.col("score").alias("scaled")), ["query_id", key]) if method == "weighted" else own
        null = F.lit(None).cast("double")
        parts.append(own.select("query_id", key, value.alias("value"), *[(F.col("score") if name == n else null).alias(n) for n in ("dense", "bm25")], *[(F.col("rank") if name == n else F.lit(None).cast("int")).alias(f"{n}_rank") for n in ("dense", "bm25")]))
    g = parts[0].unionByName(parts[1]).groupBy("query_id", key).agg(F.sum("value").alias("value"), *[F.max(c).alias(c) for c in ("dense", "bm25", "dense_rank", "bm25_rank")])
    w = Window.partitionBy("query_id")
    g = g.withColumns({"nd": F.count("dense").over(w), "nb": F.count("bm25").over(w)})
    fused = F.when(F.col("nd") == 0, F.col("bm25")).when(F.col("nb") == 0, F.col("dense")).otherwise(F.col("value"))
    return g.select("query_id", key, F.round(fused, 6).alias("fused"), "dense", "bm25", "dense_rank", "bm25_rank")


def hybrid(dense: DataFrame, lexical: DataFrame, top_k: int = 8, key: str = "chunk_id", **how) -> DataFrame:
    """Fused results with their rank; ties go to the dense list, then to the lexical one."""
    f = fuse(dense, lexical, key=key, **how)
    w = Window.partitionBy("query_id").orderBy(F.col("fused").desc(), F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last(), key)
    return ranked(f, w, top_k)


def rerank(hits: DataFrame, queries: DataFrame, docs: DataFrame, top_k: int, pool: int, key: str = "chunk_id", scorer=None) -> DataFrame:
    """The first `pool` hits scored again, sorted and numbered anew. The default scorer is the share of query words in the text."""
    score = scorer or (lambda q, t: F.size(F.array_intersect(T.token_set(q), T.token_set(t))) / F.greatest(F.lit(1), F.size(T.token_set(q))))
    j = hits.filter(F.col("rank") < pool).join(queries.select("query_id", F.col("text").alias("q")), "query_id").join(docs.select(key, F.col("text").alias("t")), key)
    again = j.withColumn("rerank", F.round(score(F.col("q"), F.col("t")), 6)).drop("q", "t").withColumnRenamed("rank", "first_rank")
    w = Window.partitionBy("query_id").orderBy(F.col("rerank").desc(), "first_rank")
    return ranked(again, w, top_k)
