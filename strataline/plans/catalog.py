"""Every registered query of the core, with the SQL it is compared with.

Queries run over whole tables. Questions come from eval_cases, chunks count once per chunk_id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions import text as T
from strataline.operators import chunking, comparison, evaluation, extraction, generation, packed, retrieval, scan, signals, verification
from strataline.operators.repeats import one_per_key
from strataline.session import cut_lineage, read_table, shared_dir
from strataline.sources import filings as source
from strataline.sources import index
from strataline.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(name: str):
    return lambda spark, d: read_table(spark, d, name)


def catalog(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return retrieval.catalog(read_table(spark, d, "chunks"), *columns)


def questions(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "eval_cases").select(F.col("id").alias("query_id"), F.col("question").alias("text"), "ticker")


TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
KEYWORDS = f"list_filter(list_distinct({TOKENS}), lambda w: length(w) > 2 AND NOT list_contains({STOPS}, w))"
SENTENCES = r"list_filter(string_split(regexp_replace(regexp_replace({}, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
CAT = "cat AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ord) = 1)"
Q = "q AS (SELECT id AS query_id, question AS text, ticker FROM eval_cases)"
#: White space: of ASCII, of column expressions that say (?U), and of Python.
AWS, UWS, PWS = r"[\t-\r ]", r"[\t-\r\x20\x85\p{Z}]", r"[\t-\r\x1c-\x20\x85\p{Z}]"


def _strip(expr: str, ws: str = AWS) -> str:
    return f"regexp_replace({expr}, '^{ws}+|{ws}+$', '', 'g')"


def _windows(size: int, overlap: int, least: int) -> str:
    """CTEs from src (k, body) to wn (k, ord, place, text, n_windows)."""
    return rf"""wt AS (SELECT k, {_strip('body', PWS)} AS t FROM src),
wp AS (SELECT k, t, string_split(regexp_replace(t, '[.!?](?:\n\n|{PWS}+)|\n\n', '\0' || chr(1), 'g'), chr(1)) AS parts FROM wt),
wi AS (SELECT k, t, length(t) AS n, list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x)))) AS br FROM wp),
rc AS (SELECT k, 0 AS pos, 0 AS i FROM wi WHERE n > {size} UNION ALL
  SELECT k, nxt AS pos, i + 1 AS i FROM (SELECT k, i, n, pos, CASE WHEN e - {overlap} > pos THEN e - {overlap} ELSE e END AS nxt
    FROM (SELECT rc.k, i, n, pos, coalesce(list_max(list_filter(br, lambda b: b > pos AND b <= pos + {size})), pos + {size})::INT AS e FROM rc JOIN wi USING (k) WHERE pos + {size} < n)) WHERE nxt < n),
wb AS (SELECT k, i, pos, {_strip('substr(t, pos + 1, (e - pos)::INT)', PWS)} AS body FROM (SELECT rc.k, i, pos, t, CASE WHEN pos + {size} < n THEN coalesce(list_max(list_filter(br, lambda b: b > pos AND b <= pos + {size})), pos + {size}) ELSE pos + {size} END AS e FROM rc JOIN wi USING (k))
  UNION ALL SELECT k, 0, 0, t FROM wi WHERE n <= {size}),
wo AS (SELECT k, pos, body, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS ord, count(*) OVER (PARTITION BY k) AS cnt, last_value(body) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail FROM wb WHERE body <> ''),
wn AS (SELECT k, ord, pos AS place, CASE WHEN cnt > 1 AND length(tail) < {least} AND ord = cnt - 2 THEN body || ' ' || tail ELSE body END AS text, CASE WHEN cnt > 1 AND length(tail) < {least} THEN cnt - 1 ELSE cnt END AS n_windows
  FROM wo WHERE NOT (cnt > 1 AND length(tail) < {least} AND ord = cnt - 1))"""


INDEX = f"""{CAT},
tok AS (SELECT chunk_id, unnest({TOKENS.format('text')}) AS term FROM cat),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT chunk_id, len({TOKENS.format('text')}) AS dl FROM cat),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, st)"""
BM25 = f"""{INDEX}, {Q},
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format('text')}) AS term FROM q) GROUP BY ALL),
bs AS (SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (chunk_id), st GROUP BY ALL)"""
RANKED = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM {}"
BTOP = BM25 + f", b AS (SELECT * FROM ({RANKED.format('bs')}) WHERE rank < 40)"
HASHED = """{0}t AS (SELECT {1} AS k, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {2}),
{0}c AS (SELECT k, ('0x' || right(md5(term), 2))::INT AS idx, sum(CASE WHEN ('0x' || substr(md5(term), 30, 1))::INT % 2 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS s FROM {0}t GROUP BY ALL HAVING s <> 0),
{0}v AS (SELECT k, idx, s / sqrt(sum(s * s) OVER (PARTITION BY k)) AS w FROM {0}c)"""
DTOP = f""", {HASHED.format('h', 'chunk_id', 'cat')}, {HASHED.format('g', 'query_id', 'q')},
ds AS (SELECT gv.k AS query_id, hv.k AS chunk_id, round(sum(gv.w * hv.w), 6) AS score FROM gv JOIN hv USING (idx) GROUP BY ALL),
d AS (SELECT * FROM ({RANKED.format('ds')}) WHERE rank < 40)"""
BOTH = "WITH " + BTOP + DTOP


# ---- tokens and index ------------------------------------------------------------------------------------------------


@query(f"WITH {CAT} SELECT chunk_id, len({TOKENS.format('text')}) AS n_tokens, len(list_distinct({TOKENS.format('text')})) AS n_distinct, greatest(1, length(text) // 4) AS estimate FROM cat")
def tokenize_counts(spark, d):
    t = T.tokens(F.col("text"))
    return catalog(spark, d).select("chunk_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"), T.token_estimate(F.col("text")).alias("estimate"))


@query(f"WITH {INDEX} SELECT chunk_id, term, tf FROM tf")
def term_frequency(spark, d):
    return retrieval.postings(catalog(spark, d)).select("chunk_id", "term", "tf")


@query(f"WITH {INDEX} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def doc_length_stats(spark, d):
    return retrieval.corpus_stats(catalog(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM idf")
def document_frequency_idf(spark, d):
    c = catalog(spark, d, "text")
    return retrieval.document_frequencies(c, retrieval.corpus_stats(c)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {BM25} SELECT query_id, chunk_id, score, rank FROM ({RANKED.format('bs')}) WHERE rank < 10")
def bm25_topk(spark, d):
    return scan.best_by_words(catalog(spark, d, "text"), questions(spark, d), 10)


@query(f"WITH {BM25}, f AS (SELECT bs.* FROM bs JOIN cat USING (chunk_id) JOIN q USING (query_id) WHERE q.ticker IS NULL OR q.ticker = cat.ticker) SELECT query_id, chunk_id, score, rank FROM ({RANKED.format('f')}) WHERE rank < 10")
def bm25_filtered_topk(spark, d):
    return scan.best_by_words(catalog(spark, d, "text", "ticker"), questions(spark, d), 10, group="ticker")


@query(f"WITH {BM25.replace('question AS text', chr(34) + 'question' + chr(34) + ' || chr(32) || question AS text')} SELECT query_id, chunk_id, score, rank FROM ({RANKED.format('bs')}) WHERE rank < 5")
def bm25_dup_terms(spark, d):
    q = questions(spark, d).withColumn("text", F.concat_ws(" ", "text", "text"))
    return scan.best_by_words(catalog(spark, d, "text"), q, 5)


@query(f"WITH {CAT}, {HASHED.format('h', 'chunk_id', 'cat')} SELECT k AS chunk_id, idx, round(w, 6) AS w FROM hv")
def hash_embedding(spark, d):
    return retrieval.hash_embedding(catalog(spark, d)).select("chunk_id", "idx", F.round("w", 6).alias("w"))


@query(f"{BOTH} SELECT query_id, chunk_id, score, rank FROM d WHERE rank < 10")
def hash_dense_topk(spark, d):
    return scan.best_by_hash(catalog(spark, d, "text"), questions(spark, d), 10)


COS = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"
VTOP = "SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, {} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 {})) WHERE rank < 10"


def _vectors(spark, d):
    e = read_table(spark, d, "embeddings")
    return e, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")


@query(VTOP.format(COS, ""))
def cosine_topk(spark, d):
    return scan.best_by_vector(*_vectors(spark, d), 10)


@query(VTOP.format(COS, "AND a.label = b.label"))
def cosine_filtered_topk(spark, d):
    return scan.best_by_vector(*_vectors(spark, d), 10, group="label")


# ---- fusion ----------------------------------------------------------------------------------------------------------


def _lists(spark, d):
    c, q = catalog(spark, d, "text"), questions(spark, d)
    return cut_lineage(scan.best_by_hash(c, q, 40)), cut_lineage(scan.best_by_words(c, q, 40))


FULL = "j AS (SELECT query_id, chunk_id, d.score AS dense, b.score AS bm25, d.rank AS dense_rank, b.rank AS bm25_rank FROM d FULL JOIN b USING (query_id, chunk_id))"
RRF = "coalesce(0.5 / (60 + dense_rank + 1), 0) + coalesce(0.5 / (60 + bm25_rank + 1), 0)"
SCALE = "CASE WHEN max({0}) OVER p - min({0}) OVER p < 1e-12 AND {0} IS NOT NULL THEN 1.0 ELSE ({0} - min({0}) OVER p) / nullif(max({0}) OVER p - min({0}) OVER p, 0) END"
WEIGHTED = f"coalesce(0.4 * ({SCALE.format('dense')}), 0) + coalesce(0.6 * ({SCALE.format('bm25')}), 0)"
PASS = "CASE WHEN count(dense) OVER p = 0 THEN bm25 WHEN count(bm25) OVER p = 0 THEN dense ELSE {} END"


@query(f"{BOTH}, {FULL} SELECT query_id, chunk_id, round({PASS.format(RRF)}, 6) AS fused FROM j WINDOW p AS (PARTITION BY query_id)")
def rrf_fusion(spark, d):
    return retrieval.fuse(*_lists(spark, d)).select("query_id", "chunk_id", "fused")


@query(f"{BOTH}, {FULL} SELECT query_id, chunk_id, round({PASS.format(WEIGHTED)}, 6) AS fused FROM j WINDOW p AS (PARTITION BY query_id)")
def weighted_fusion(spark, d):
    return retrieval.fuse(*_lists(spark, d), method="weighted", dense_weight=0.4, lexical_weight=0.6).select("query_id", "chunk_id", "fused")


FUSED = f"f AS (SELECT *, round({PASS.format(RRF)}, 6) AS fused FROM j WINDOW p AS (PARTITION BY query_id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST, chunk_id) - 1 AS rank FROM f)"
HITS = f"{BOTH}, {FULL}, {FUSED}, hits AS (SELECT * FROM r WHERE rank < 8)"


def _hits(spark, d, top_k=8):
    """Hits of all questions: few rows from a long plan that later steps read several times, so they are written down."""
    return cut_lineage(retrieval.hybrid(*_lists(spark, d), top_k=top_k))


@query(f"{HITS} SELECT query_id, chunk_id, fused, dense, bm25, rank FROM hits")
def hybrid_retrieve(spark, d):
    return _hits(spark, d).select("query_id", "chunk_id", "fused", "dense", "bm25", "rank")


@query(f"WITH {BTOP} SELECT query_id, chunk_id, score AS fused FROM b")
def hybrid_passthrough(spark, d):
    """The lexical list alone: with an empty dense list its scores pass through."""
    dense, lexical = _lists(spark, d)
    return retrieval.fuse(dense.limit(0), lexical).select("query_id", "chunk_id", "fused")


@query(f"""{BOTH}, {FULL}, {FUSED}, p AS (SELECT query_id, chunk_id, r.rank AS first_rank, round(len(list_intersect(list_distinct({TOKENS.format('q.text')}), list_distinct({TOKENS.format('cat.text')}))) / greatest(1, len(list_distinct({TOKENS.format('q.text')}))), 6) AS rerank
FROM r JOIN q USING (query_id) JOIN cat USING (chunk_id) WHERE r.rank < 24)
SELECT query_id, chunk_id, rerank, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, first_rank) - 1 AS rank FROM p) WHERE rank < 8""")
def reranked(spark, d):
    return retrieval.rerank(_hits(spark, d, 24), questions(spark, d), catalog(spark, d), 8, 24).select("query_id", "chunk_id", "rerank", "rank")


@query("SELECT chunk_id, ord FROM chunks WHERE filing_type = '10-K' AND item_number = '1A'")
def metadata_filter_scalar(spark, d):
    return read_table(spark, d, "chunks").filter(retrieval.metadata_filter({"filing_type": "10-K", "item_number": "1A"})).select("chunk_id", "ord")


@query("SELECT chunk_id, ord FROM chunks WHERE item_number IN ('3', '7') AND fiscal_year = '2023'")
def metadata_filter_in(spark, d):
    return read_table(spark, d, "chunks").filter(retrieval.metadata_filter({"item_number": ["3", "7"], "fiscal_year": 2023})).select("chunk_id", "ord")


# ---- provenance, sections, units -------------------------------------------------------------------------------------


@query(r"""SELECT DISTINCT source_path, CASE WHEN s[1] = '' THEN 'UNKNOWN' ELSE upper(s[1]) END AS ticker, CASE WHEN m THEN substr(s[2], 1, 10) WHEN len(s) > 1 THEN s[2] ELSE 'UNKNOWN' END AS cik,
CASE WHEN len(s) > 3 THEN array_to_string(s[4:], '_') WHEN m THEN s[2] ELSE 'UNKNOWN' END AS accession, CASE WHEN len(s) > 2 AND regexp_matches(s[3], '^\d{4}') THEN substr(s[3], 1, 4) WHEN m THEN '20' || substr(s[2], 12, 2) ELSE 'UNKNOWN' END AS fiscal_year
FROM (SELECT source_path, s, regexp_matches(coalesce(s[2], ''), '^\d{10}-\d{2}-\d{6}$') AS m FROM (SELECT source_path, string_split(regexp_replace(list_last(string_split(source_path, '/')), '(.)\.[^.]*$', '\1'), '_') AS s FROM filings))""")
def filename_metadata(spark, d):
    m = chunking.filename_metadata(F.col("source_path"))
    return read_table(spark, d, "filings").select("source_path", m.alias("m")).select("source_path", "m.ticker", "m.cik", "m.accession", "m.fiscal_year").distinct()


@query("SELECT DISTINCT source_path, coalesce(" + ", ".join(f"CASE WHEN list_contains(string_split(upper(source_path), '/'), '{h}') THEN '{h}' END" for h in chunking.FORM_HINTS) + ", '10-K') AS form FROM filings")
def form_inference(spark, d):
    return read_table(spark, d, "filings").select("source_path", chunking.inferred_form(F.col("source_path")).alias("form")).distinct()


@query(f"""WITH {CAT} SELECT chunk_id, concat_ws(':', ticker, item_number, section_ordinal, substr(sha1(concat_ws('|', ticker, CASE WHEN list_last(string_split(source_path, '/')) = '' THEN accession ELSE list_last(string_split(source_path, '/')) END, fiscal_year, filing_type, item_number, section_ordinal)), 1, 12)) AS made_id FROM cat""")
def chunk_ids(spark, d):
    made = chunking.chunk_id(*(F.col(c) for c in ("ticker", "source_path", "accession", "fiscal_year", "filing_type", "item_number", "section_ordinal")))
    return catalog(spark, d).select("chunk_id", made.alias("made_id"))


def _filings(spark, d):
    """One row per accession, the last delivery."""
    return one_per_key(read_table(spark, d, "filings"), "accession", "loaded_at", last=True).drop("loaded_at")


HEAD_RE = r"(?im)^\s*ITEM\s+(\d{1,2}[A-C]?)\s*[.:\-—]?\s*([^\n]{0,80})"
HEADS = rf"""fl AS (SELECT accession, replace(text, chr(1), ' ') AS text FROM filings QUALIFY row_number() OVER (PARTITION BY accession ORDER BY loaded_at DESC) = 1),
pt AS (SELECT accession, unnest(string_split(regexp_replace(text, '{HEAD_RE}', chr(1) || '\0', 'g'), chr(1))) AS part, generate_subscripts(string_split(regexp_replace(text, '{HEAD_RE}', chr(1) || '\0', 'g'), chr(1)), 1) AS n FROM fl),
hd AS (SELECT accession, n, coalesce(sum(length(part)) OVER (PARTITION BY accession ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start, part FROM pt),
it AS (SELECT accession, start, upper(regexp_extract(part, '{HEAD_RE}', 1)) AS item_number FROM hd WHERE n > 1)"""


@query(f"WITH {HEADS} SELECT accession, item_number, start FROM it")
def section_headings(spark, d):
    return chunking.headings(_filings(spark, d)).select("accession", "item_number", "start")


_TITLES = "MAP {" + ", ".join("'" + k + "': '" + v.replace("'", "''") + "'" for k, v in chunking.ITEM_TITLES.items()) + "}"
SECTIONS = rf"""{HEADS}, la AS (SELECT accession, upper(regexp_extract(part, '{HEAD_RE}', 1)) AS item_number, max(start) AS char_start, arg_max(regexp_extract(part, '{HEAD_RE}', 2), start) AS raw FROM hd WHERE n > 1 GROUP BY ALL),
nx AS (SELECT *, lead(char_start) OVER (PARTITION BY accession ORDER BY char_start) AS next, min(char_start) OVER (PARTITION BY accession) AS first FROM la),
fx AS (SELECT accession, text FROM filings QUALIFY row_number() OVER (PARTITION BY accession ORDER BY loaded_at DESC) = 1),
sc AS (SELECT nx.accession, item_number, coalesce({_TITLES}[item_number], nullif(array_to_string(list_transform(string_split(lower(trim(raw)), ' '), lambda w: upper(w[1]) || substr(w, 2)), ' '), ''), 'Item ' || item_number) AS title, char_start, {_strip("substr(text, char_start + 1, coalesce(next, length(text)) - char_start)")} AS body FROM nx JOIN fx USING (accession)
UNION ALL SELECT accession, 'UNKNOWN', 'Full Document', 0, text FROM fx WHERE accession NOT IN (SELECT accession FROM it)
UNION ALL SELECT * FROM (SELECT nx.accession, '0', 'Cover / Front Matter', 0, {_strip("substr(text, 1, first)")} AS body FROM nx JOIN fx USING (accession) WHERE char_start = first) WHERE length(body) > 200)"""


@query(f"WITH {SECTIONS} SELECT accession, item_number, title, char_start, length(body) AS size, md5(body) AS digest FROM sc")
def section_split(spark, d):
    return chunking.sections(_filings(spark, d)).select("accession", "item_number", "title", "char_start", F.length("section_text").alias("size"), F.md5("section_text").alias("digest"))


@query(f"""WITH RECURSIVE {SECTIONS}, sn AS (SELECT row_number() OVER () AS k, * FROM sc), src AS (SELECT k, body FROM sn), {_windows(1800, 200, 200)},
nu AS (SELECT sn.accession, item_number, title, (char_start + place)::INT AS char_start, ord, wn.text, row_number() OVER (PARTITION BY sn.accession ORDER BY char_start, item_number <> '0', ord) - 1 AS nr FROM wn JOIN sn USING (k) WHERE length(wn.text) >= 200 OR n_windows = 1),
me AS (SELECT accession, ticker, filing_type, fiscal_year, list_last(string_split(source_path, '/')) AS name FROM filings QUALIFY row_number() OVER (PARTITION BY accession ORDER BY loaded_at DESC) = 1)
SELECT concat_ws(':', ticker, item_number, nr, substr(sha1(concat_ws('|', ticker, CASE WHEN name = '' THEN accession ELSE name END, fiscal_year, filing_type, item_number, nr)), 1, 12)) AS chunk_id, accession, item_number, title AS section_title, char_start, char_start + length(text) AS char_end, ord AS section_ordinal, text
FROM nu JOIN me USING (accession)""")
def chunk_filing(spark, d):
    return chunking.chunk_filings(_filings(spark, d)).select("chunk_id", "accession", "item_number", "section_title", "char_start", "char_end", "section_ordinal", "text")


@query(f"WITH RECURSIVE {CAT}, src AS (SELECT chunk_id AS k, text AS body FROM cat), {_windows(600, 80, 60)} SELECT k AS chunk_id, ord AS section_ordinal, place AS \"offset\", text FROM wn")
def window_split(spark, d):
    parts = catalog(spark, d, "text").select("chunk_id", F.col("text").alias("section_text"))
    return chunking.windows(parts, 600, 80, 60).select("chunk_id", "section_ordinal", "offset", "text")


@query(f"WITH {CAT} SELECT chunk_id, len({SENTENCES.format('text')}) AS n, md5(array_to_string({SENTENCES.format('text')}, '|')) AS digest FROM cat")
def sentence_split(spark, d):
    s = T.sentences(F.col("text"))
    return catalog(spark, d).select("chunk_id", F.size(s).alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))


@query(f"WITH {CAT} SELECT chunk_id, len({KEYWORDS.format('text')}) AS n, array_to_string(list_sort({KEYWORDS.format('text')}), ' ') AS words FROM cat")
def keyword_sets(spark, d):
    k = T.keywords(F.col("text"))
    return catalog(spark, d).select("chunk_id", F.size(k).alias("n"), F.array_join(F.array_sort(k), " ").alias("words"))


def _units(expr: str, alias: str, source: str, *keys: str) -> str:
    """CTEs to alias (*keys, us): the disclosure units of a text column of the source."""
    k = ", ".join(keys)
    return rf"""{alias}p AS (SELECT {k}, list_filter(list_transform(string_split(regexp_replace({expr}, '\n{AWS}*\n', chr(1), 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '') AS ps FROM {source}),
{alias}f AS (SELECT {k}, list_filter(list_transform(flatten(list_transform(ps, lambda p: string_split(regexp_replace(p, '([.!?]){AWS}+|\n+', '\1' || chr(1), 'g'), chr(1)))), lambda x: {_strip('x')}), lambda x: x <> '') AS fs FROM {alias}p),
{alias}g AS (SELECT {k}, list_reduce(list_transform(fs, lambda x: {{'done': []::VARCHAR[], 'held': x}}), lambda acc, y: CASE WHEN length(CASE WHEN acc.held = '' THEN y.held ELSE acc.held || ' ' || y.held END) >= 80
  THEN {{'done': list_append(acc.done, CASE WHEN acc.held = '' THEN y.held ELSE acc.held || ' ' || y.held END), 'held': ''}} ELSE {{'done': acc.done, 'held': CASE WHEN acc.held = '' THEN y.held ELSE acc.held || ' ' || y.held END}} END, {{'done': []::VARCHAR[], 'held': ''}}) AS g FROM {alias}f),
{alias} AS (SELECT {k}, CASE WHEN g.held = '' THEN g.done WHEN len(g.done) > 0 THEN list_append(g.done[:len(g.done) - 1], g.done[len(g.done)] || ' ' || g.held) ELSE [g.held] END AS us FROM {alias}g)"""


@query(f"WITH {CAT}, {_units('text', 'un', 'cat', 'chunk_id')} SELECT chunk_id, generate_subscripts(us, 1) - 1 AS place, unnest(us) AS unit FROM un")
def disclosure_units(spark, d):
    u = chunking.units(F.col("text"))
    return catalog(spark, d, "text").select("chunk_id", F.posexplode(u).alias("place", "unit"))


@query(r"SELECT DISTINCT accession, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM filings")
def normalize_text(spark, d):
    return read_table(spark, d, "filings").select("accession", F.md5(T.normalise(F.col("text"))).alias("digest")).distinct()


# ---- comparison and signals ------------------------------------------------------------------------------------------

JAC = "CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN 1.0 WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"


@query(f"SELECT DISTINCT answer_id, round({JAC.format('a', 'b')}, 6) AS similarity FROM (SELECT answer_id, list_distinct({TOKENS.format('question')}) AS a, list_distinct({TOKENS.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}) AS b FROM answers)")
def jaccard_pairs(spark, d):
    a = read_table(spark, d, "answers")
    sim = T.jaccard(T.token_set(F.col("question")), T.token_set(F.coalesce("text", F.lit(""))))
    return a.select("answer_id", F.round(sim, 6).alias("similarity")).distinct()


_TOKSET = f"list_distinct({TOKENS})"
DIFF = rf"""{CAT}, kc AS (SELECT *, upper(ticker) AS tk FROM cat WHERE filing_type = '10-K'),
en AS (SELECT tk, min(fiscal_year) AS ya, max(fiscal_year) AS yb FROM kc WHERE regexp_matches(fiscal_year, '^[0-9]{{4}}$') GROUP BY tk HAVING min(fiscal_year) < max(fiscal_year)),
tx AS (SELECT tk, ya, yb, item_number, fiscal_year = yb AS is_b, string_agg(text, chr(10) || chr(10) ORDER BY char_start NULLS FIRST, ord) AS body, first(section_title ORDER BY char_start NULLS FIRST, ord) AS title
  FROM kc JOIN en USING (tk) WHERE fiscal_year IN (ya, yb) AND item_number NOT IN ('UNKNOWN', '0') GROUP BY ALL),
pr AS (SELECT tk, ya, yb, item_number, coalesce(a.body, '') AS ta, coalesce(b.body, '') AS tb, coalesce(b.title, 'Item ' || item_number) AS title
  FROM (SELECT * FROM tx WHERE NOT is_b) a FULL JOIN (SELECT * FROM tx WHERE is_b) b USING (tk, ya, yb, item_number)),
{_units('ta', 'va', 'pr', 'tk', 'item_number')}, {_units('tb', 'vb', 'pr', 'tk', 'item_number')},
ea AS (SELECT tk, item_number, i, u, {_TOKSET.format('u')} AS w FROM (SELECT tk, item_number, generate_subscripts(us, 1) AS i, unnest(us) AS u FROM va)),
eb AS (SELECT tk, item_number, j, u, {_TOKSET.format('u')} AS w FROM (SELECT tk, item_number, generate_subscripts(us, 1) AS j, unnest(us) AS u FROM vb)),
si AS (SELECT eb.tk, eb.item_number, j, i, {JAC.format('ea.w', 'eb.w')} AS s FROM eb JOIN ea ON ea.tk = eb.tk AND ea.item_number = eb.item_number),
sl AS (SELECT eb.tk, eb.item_number, eb.j, list({{'i': i, 's': s}} ORDER BY s DESC, i) FILTER (WHERE s >= 0.3) AS near FROM eb LEFT JOIN si ON si.tk = eb.tk AND si.item_number = eb.item_number AND si.j = eb.j GROUP BY ALL),
al AS (SELECT tk, item_number, 0::BIGINT AS j, []::BIGINT[] AS used, NULL::BIGINT AS i, NULL::DOUBLE AS s FROM pr UNION ALL
  SELECT tk, item_number, j, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.i) END, best.i, best.s
  FROM (SELECT sl.tk, sl.item_number, sl.j, used, list_filter(coalesce(near, []), lambda x: NOT list_contains(used, x.i))[1] AS best FROM al JOIN sl ON sl.tk = al.tk AND sl.item_number = al.item_number AND sl.j = al.j + 1)),
en2 AS (SELECT tk, item_number, used FROM al QUALIFY row_number() OVER (PARTITION BY tk, item_number ORDER BY j DESC) = 1),
ad AS (SELECT al.tk, al.item_number, count(*) AS n, string_agg(u, '|' ORDER BY al.j) AS t FROM al JOIN eb ON eb.tk = al.tk AND eb.item_number = al.item_number AND eb.j = al.j WHERE al.i IS NULL GROUP BY ALL),
ch AS (SELECT al.tk, al.item_number, count(*) AS n, string_agg(ea.u || '>' || eb.u, '|' ORDER BY al.j) AS t FROM al JOIN eb ON eb.tk = al.tk AND eb.item_number = al.item_number AND eb.j = al.j JOIN ea ON ea.tk = al.tk AND ea.item_number = al.item_number AND ea.i = al.i WHERE al.s < 0.65 GROUP BY ALL),
rm AS (SELECT ea.tk, ea.item_number, count(*) AS n, string_agg(u, '|' ORDER BY ea.i) AS t FROM ea JOIN en2 ON en2.tk = ea.tk AND en2.item_number = ea.item_number WHERE NOT list_contains(used, ea.i) GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {DIFF} SELECT pr.tk AS ticker, pr.item_number, title AS section_title, ya AS label_a, yb AS label_b, round({JAC.format(_TOKSET.format('ta'), _TOKSET.format('tb'))}, 6) AS similarity,
coalesce(ad.n, 0) AS n_added, coalesce(rm.n, 0) AS n_removed, coalesce(ch.n, 0) AS n_changed, md5(coalesce(ad.t, '')) AS added, md5(coalesce(rm.t, '')) AS removed, md5(coalesce(ch.t, '')) AS changed
FROM pr LEFT JOIN ad ON ad.tk = pr.tk AND ad.item_number = pr.item_number LEFT JOIN rm ON rm.tk = pr.tk AND rm.item_number = pr.item_number LEFT JOIN ch ON ch.tk = pr.tk AND ch.item_number = pr.item_number""")
def section_diff(spark, d):
    """Differences of the annual reports of each ticker's first and last year, the texts of the units as digests."""
    r = comparison.compare_years(catalog(spark, d), forms=["10-K"])
    digest = lambda c: F.md5(F.array_join(c, "|"))
    changed = F.transform("changed", lambda x: F.concat(x["old_text"], F.lit(">"), x["new_text"]))
    return r.select(
        "ticker", "item_number", "section_title", "label_a", "label_b", "similarity", F.size("added").alias("n_added"), F.size("removed").alias("n_removed"), F.size("changed").alias("n_changed"),
        digest(F.col("added")).alias("added"), digest(F.col("removed")).alias("removed"), digest(changed).alias("changed"),
    )


@query("SELECT ticker, count(*) AS sections_compared, sum(len(coalesce(added, []))) AS added, sum(len(coalesce(removed, []))) AS removed, sum(len(coalesce(changed, []))) AS changed FROM section_diffs GROUP BY ticker")
def diff_summary(spark, d):
    return comparison.summary(read_table(spark, d, "section_diffs"), "ticker")


LEX = ", ".join("struct_pack(k := '" + k + "', p := coalesce(" + ", ".join(f"CASE WHEN contains(t, '{p}') THEN '{p}' END" for p in ps) + "))" for k, ps in signals.LEXICON.items())
SIG = f"{CAT}, sg AS (SELECT chunk_id, ticker, text, s.k AS signal_type, s.p AS phrase FROM (SELECT *, unnest([{LEX}]) AS s FROM (SELECT *, lower(text) AS t FROM cat)) WHERE s.p IS NOT NULL)"




def _collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{UWS}+', ' ', 'g'))"


_AT = "instr(lower(text), phrase)"


@query(f"WITH {SIG} SELECT chunk_id, signal_type, phrase, {_collapse(f'substr(text, greatest(1, {_AT} - 80), {_AT} + length(phrase) + 80 - greatest(1, {_AT} - 80))')} AS snippet FROM sg")
def risk_signals(spark, d):
    return signals.detect(catalog(spark, d, "text"))


@query(f"WITH {SIG} SELECT ticker, signal_type, count(*) AS n, array_to_string(list_sort(list_distinct(list(phrase))), '; ') AS phrases FROM sg GROUP BY ALL")
def signals_by_type(spark, d):
    c = catalog(spark, d, "text", "ticker")
    return signals.by_type(signals.detect(c).join(c.select("chunk_id", "ticker"), "chunk_id"), "ticker")


@query(f"""WITH {SIG}, s AS (SELECT ticker, count(*) AS signals, bool_or(signal_type = 'going_concern') AS going_concern FROM sg GROUP BY ticker),
e AS (SELECT ticker, sum(CASE WHEN item_number = '1A' THEN len(added) ELSE 0 END) AS new_risk_factors, sum(CASE WHEN item_number = '1A' THEN len(removed) ELSE 0 END) AS removed_risk_factors, sum(CASE WHEN item_number = '1A' THEN len(changed) ELSE 0 END) AS changed_risk_factors, sum(CASE WHEN item_number = '3' THEN len(added) ELSE 0 END) AS new_litigation FROM section_diffs GROUP BY ticker)
SELECT ticker, coalesce(new_risk_factors, 0) AS new_risk_factors, coalesce(removed_risk_factors, 0) AS removed_risk_factors, coalesce(changed_risk_factors, 0) AS changed_risk_factors, coalesce(new_litigation, 0) AS new_litigation, coalesce(signals, 0) AS signals, coalesce(going_concern, false) AS going_concern FROM e FULL JOIN s USING (ticker)""")
def monitor_summary(spark, d):
    c = catalog(spark, d)
    s = signals.detect(c).join(c.select("chunk_id", "ticker"), "chunk_id")
    return signals.monitor(read_table(spark, d, "section_diffs"), s)


# ---- figures, quotes, claims -----------------------------------------------------------------------------------------

FIG = r"\$?\s?(\d[\d,]*(?:\.\d+)?)\s*(%|percentage points?|percent|basis points?|bps|trillion|billion|million|thousand|bn|mm|mn)?"
UNITS = "CASE u " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in T.SCALES.items()) + " ELSE 1 END"
PCT = "u IN (" + ", ".join(f"'{p}'" for p in T.PERCENT) + ")"


@query(f"SELECT answer_id, place - 1 AS place, try_cast(replace(n, ',', '') AS DOUBLE) * CASE WHEN {PCT} THEN 1 ELSE {UNITS} END AS value, {PCT} AS is_percent FROM (SELECT answer_id, unnest(ns) AS n, unnest(us) AS u, generate_subscripts(ns, 1) AS place FROM (SELECT DISTINCT answer_id, regexp_extract_all(text, '(?i){FIG}', 1) AS ns, list_transform(regexp_extract_all(text, '(?i){FIG}', 2), lambda x: lower(coalesce(x, ''))) AS us FROM answers WHERE text IS NOT NULL))")
def extract_figures(spark, d):
    a = read_table(spark, d, "answers").select("answer_id", "text").distinct()
    return a.select("answer_id", F.posexplode(T.figures(F.col("text"))).alias("place", "f")).select("answer_id", "place", "f.value", "f.is_percent")


def _evidence(spark, d):
    c = catalog(spark, d, "text").select("chunk_id", "text")
    return read_table(spark, d, "citations").select("answer_id", "n", "chunk_id").distinct().join(c, "chunk_id")


def _answers(spark, d):
    return read_table(spark, d, "answers").select("answer_id", "text").distinct()


def _figs(expr: str) -> str:
    ns, us = f"regexp_extract_all({expr}, '(?i){FIG}', 1)", f"list_transform(regexp_extract_all({expr}, '(?i){FIG}', 2), lambda x: lower(coalesce(x, '')))"
    unit = "CASE p.u " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in T.SCALES.items()) + " ELSE 1 END"
    percent = "p.u IN (" + ", ".join(f"'{p}'" for p in T.PERCENT) + ")"
    zipped = f"list_transform(list_zip({ns}, {us}), lambda z: {{'n': z[1], 'u': z[2]}})"
    return f"list_transform({zipped}, lambda p: {{'v': try_cast(replace(p.n, ',', '') AS DOUBLE) * CASE WHEN {percent} THEN 1 ELSE {unit} END, 'p': {percent}}})"


def _near(a: str, b: str) -> str:
    return f"(CASE WHEN ({a}) = 0 OR ({b}) = 0 THEN ({a}) = ({b}) ELSE abs(({a}) - ({b})) <= 0.005 * greatest(abs({a}), abs({b})) END)"


_MEETS = "(c.p = e.p AND (" + _near("c.v", "e.v") + " OR (NOT c.p AND (" + " OR ".join(_near("c.v", f"e.v * {k}") + " OR " + _near(f"c.v * {k}", "e.v") for k in ("1e3", "1e6", "1e9")) + "))))"


def _supported(claim: str, evidence: str) -> str:
    return f"(len(list_filter({claim}, lambda c: len(list_filter({evidence}, lambda e: {_MEETS})) = 0)) = 0)"


@query(f"""WITH {CAT}, fa AS (SELECT answer_id, {_figs("coalesce(text, '')")} AS f FROM (SELECT DISTINCT answer_id, text FROM answers)), fe AS (SELECT chunk_id, {_figs('text')} AS f FROM cat),
pe AS (SELECT DISTINCT answer_id, n, chunk_id FROM citations) SELECT answer_id, n, {_supported('fa.f', 'fe.f')} AS supported FROM pe JOIN fe USING (chunk_id) JOIN fa USING (answer_id)""")
def figures_supported(spark, d):
    j = _evidence(spark, d).withColumnRenamed("text", "evidence").join(_answers(spark, d), "answer_id")
    return j.select("answer_id", "n", T.figures_supported(F.coalesce("text", F.lit("")), F.col("evidence")).alias("supported"))


def _holds(text: str, quote: str) -> str:
    return f"CASE WHEN {_collapse(quote)} = '' THEN false ELSE contains({_collapse(text)}, {_collapse(quote)}) END"


@query(f"""WITH {CAT} SELECT citation_id, {_holds("coalesce(cat.text, '')", "coalesce(quote, '')")} AS in_chunk FROM citations LEFT JOIN cat USING (chunk_id)""")
def quote_in_source(spark, d):
    """Every citation, white space beyond ASCII included; one whose chunk isn't there has no source."""
    j = read_table(spark, d, "citations").select("citation_id", "chunk_id", "quote").join(catalog(spark, d, "text").select("chunk_id", "text"), "chunk_id", "left")
    return j.select("citation_id", T.contains_quote(F.col("text"), F.col("quote")).alias("in_chunk"))


def _claims(ans: str, ev: str) -> str:
    """CTEs to bj (judged claims) and vc (after the checks) from queries for answers (answer_id, text) and evidence (answer_id, n, chunk_id, text)."""
    return f"""ans AS ({ans}), evt AS ({ev}),
sn AS (SELECT answer_id, unnest(s) AS claim, generate_subscripts(s, 1) - 1 AS claim_no FROM (SELECT answer_id, {SENTENCES.format("regexp_replace(text, '[[][0-9]+[]]', '', 'g')")} AS s FROM ans)),
cl AS (SELECT * FROM (SELECT *, {KEYWORDS.format('claim')} AS words FROM sn) WHERE len(words) > 0),
ev AS (SELECT answer_id, n, chunk_id, text AS source, {KEYWORDS.format('text')} AS own FROM evt),
jj AS (SELECT cl.answer_id, claim_no, claim, words, n, chunk_id, source, coalesce(len(list_intersect(words, own)) / len(words), 0) AS overlap FROM cl LEFT JOIN ev USING (answer_id)),
bj AS (SELECT answer_id, claim_no, claim, words, round(overlap, 6) AS overlap, CASE WHEN overlap >= 0.6 THEN 'SUPPORTED' WHEN overlap >= 0.3 THEN 'PARTIAL' ELSE 'UNSUPPORTED' END AS verdict, n, chunk_id, source FROM jj QUALIFY row_number() OVER (PARTITION BY answer_id, claim_no ORDER BY jj.overlap DESC, n, chunk_id DESC) = 1),
qs AS (SELECT answer_id, claim_no, list_transform(ss, lambda x: {{'s': x, 'k': {KEYWORDS.format('x')}}}) AS ss, words FROM (SELECT answer_id, claim_no, words, {SENTENCES.format('source')} AS ss FROM bj WHERE verdict <> 'UNSUPPORTED')),
qf AS (SELECT answer_id, claim_no, list_transform(ss, lambda x: x.s) AS ss, list_transform(ss, lambda x: CASE WHEN len(x.k) = 0 THEN 0 ELSE len(list_intersect(x.k, words)) / len(x.k) END) AS fits FROM qs),
qq AS (SELECT answer_id, claim_no, CASE WHEN coalesce(list_max(fits), 0) > 0 THEN ss[list_position(fits, list_max(fits))] ELSE '' END AS quote FROM qf),
vq AS (SELECT bj.*, coalesce(quote, '') AS quote, CASE WHEN verdict <> 'UNSUPPORTED' THEN n END AS citation, CASE WHEN verdict <> 'UNSUPPORTED' THEN source ELSE '' END AS basis FROM bj LEFT JOIN qq USING (answer_id, claim_no)),
vf AS (SELECT *, {_figs('claim')} AS fc, {_figs('basis')} AS fb, {_holds('basis', 'quote')} AS valid_quote FROM vq),
vn AS (SELECT *, {_supported('fc', 'fb')} AS numeric_ok FROM vf),
vc AS (SELECT answer_id, claim_no, CASE WHEN verdict IN ('SUPPORTED', 'PARTIAL') AND NOT (valid_quote AND numeric_ok) THEN 'UNSUPPORTED' ELSE verdict END AS verdict, citation, quote, valid_quote, numeric_ok FROM vn)"""


CLAIMS = _claims("SELECT DISTINCT answer_id, coalesce(text, '') AS text FROM answers", "SELECT DISTINCT answer_id, n, chunk_id, cat.text FROM citations JOIN cat USING (chunk_id)")


def _judged(spark, d):
    return verification.judge(_answers(spark, d), _evidence(spark, d))


@query(f"WITH {CAT}, {CLAIMS} SELECT answer_id, claim_no, verdict, overlap, CASE WHEN verdict <> 'UNSUPPORTED' THEN n END AS citation FROM bj")
def lexical_judge(spark, d):
    return _judged(spark, d).select("answer_id", "claim_no", "verdict", "overlap", "citation")


@query(f"WITH {CAT}, {CLAIMS} SELECT answer_id, count(*) AS total, count_if(verdict = 'SUPPORTED') AS supported, count_if(verdict = 'CONTRADICTED') AS contradicted, round((count_if(verdict = 'SUPPORTED') + 0.5 * count_if(verdict = 'PARTIAL')) / count(*), 6) AS groundedness FROM bj GROUP BY answer_id")
def groundedness(spark, d):
    return verification.report(_judged(spark, d))


@query(f"WITH {CAT}, {CLAIMS} SELECT * FROM vc")
def verified_claims(spark, d):
    return verification.checked(_judged(spark, d)).select("answer_id", "claim_no", "verdict", "citation", "quote", "valid_quote", "numeric_ok")


@query(f"WITH {CAT}, {CLAIMS} SELECT answer_id, chunk_id, verdict FROM (SELECT *, row_number() OVER (PARTITION BY answer_id, chunk_id ORDER BY CASE verdict WHEN 'SUPPORTED' THEN 0 ELSE 1 END, claim_no) AS r FROM bj WHERE verdict <> 'UNSUPPORTED') WHERE r = 1")
def best_verdict_per_chunk(spark, d):
    return verification.best_verdicts(_judged(spark, d)).select("answer_id", "chunk_id", "verdict")


@query("SELECT verdict, count(*) AS n, round(avg(score), 6) AS mean_score FROM citations GROUP BY verdict")
def citation_verdicts(spark, d):
    return read_table(spark, d, "citations").groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


# ---- answers ---------------------------------------------------------------------------------------------------------


def _context(spark, d):
    return cut_lineage(generation.context_of(_hits(spark, d), catalog(spark, d)))


CTX = f"{HITS}, ctx AS (SELECT hits.*, hits.rank + 1 AS n, cat.text, cat.item_number FROM hits JOIN cat USING (chunk_id) WHERE hits.rank < 6)"
EXTRACT = f"""{CTX}, sx AS (SELECT query_id, n, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS place, wanted FROM (SELECT ctx.query_id, n, {SENTENCES.format('ctx.text')} AS s, {KEYWORDS.format('q.text')} AS wanted FROM ctx JOIN q USING (query_id))),
sw AS (SELECT *, {KEYWORDS.format('sentence')} AS words FROM sx),
sc AS (SELECT *, round(len(list_intersect(words, wanted)) / (1 + abs(len(words) - 18) / 40), 6) AS score FROM sw WHERE len(list_intersect(words, wanted)) > 0),
so AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_id, lower(sentence) ORDER BY score DESC, n, place) = 1),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n, place) AS r FROM so QUALIFY r <= 4),
an AS (SELECT query_id, string_agg(sentence, ' ' ORDER BY r) || ' ' || array_to_string(list_transform(list_sort(list_distinct(list(n))), lambda x: '[' || x || ']'), ' ') AS answer FROM sr GROUP BY query_id),
aa AS (SELECT q.query_id, coalesce(answer, 'INSUFFICIENT_EVIDENCE') AS answer FROM q LEFT JOIN an USING (query_id))"""


@query(f"{EXTRACT} SELECT * FROM aa")
def extractive_answer(spark, d):
    return generation.extract(questions(spark, d), _context(spark, d))


EVID = "evi AS (SELECT query_id, round(greatest(0, max(e)), 6) AS evidence_score, round(avg(both_), 6) AS agreement, count(*) AS n_context FROM (SELECT query_id, greatest(coalesce(dense, 0), CASE WHEN max(coalesce(bm25, 0)) OVER (PARTITION BY query_id) > 0 THEN coalesce(bm25, 0) / max(coalesce(bm25, 0)) OVER (PARTITION BY query_id) ELSE 0 END) AS e, CASE WHEN coalesce(dense, 0) > 0 AND coalesce(bm25, 0) > 0 THEN 1 ELSE 0 END AS both_ FROM ctx) GROUP BY query_id)"


@query(f"{CTX}, {EVID} SELECT * FROM evi")
def evidence_score(spark, d):
    return generation.evidence(_context(spark, d))


CITED = f"""sz AS (SELECT query_id, count(*) AS size FROM ctx GROUP BY query_id),
ci AS (SELECT query_id, list_filter(list_distinct(list_transform(regexp_extract_all(answer, '\\[(\\d{{1,9}})\\]', 1), lambda x: x::INT)), lambda x: x BETWEEN 1 AND size) AS ns FROM aa JOIN sz USING (query_id)),
cn AS (SELECT query_id, unnest(CASE WHEN len(ns) > 0 THEN ns ELSE [1] END) AS n FROM ci),
cq AS (SELECT query_id, n::INT AS n, chunk_id, substr({_collapse('ctx.text')}, 1, 240) AS quote, round(fused, 4) AS score, ctx.item_number FROM cn JOIN ctx USING (query_id, n))"""


@query(f"{EXTRACT}, {CITED} SELECT query_id, n, chunk_id, quote, score FROM cq")
def answer_citations(spark, d):
    c = _context(spark, d)
    return generation.citations(generation.extract(questions(spark, d), c), c)


GROUNDED = f"""{CITED}, {EVID}, nc AS (SELECT query_id, count(*) AS n_citations FROM cq GROUP BY query_id),
gj AS (SELECT query_id, answer, evidence_score AS es, coalesce(n_citations, 0) AS n_citations, coalesce(round(greatest(0, least(1, 0.5 * evidence_score + 0.3 * least(1, coalesce(n_citations, 0) / 2) + 0.2 * agreement)), 6), 0) AS confidence FROM aa LEFT JOIN evi USING (query_id) LEFT JOIN nc USING (query_id)),
gr AS (SELECT query_id, answer, coalesce(es, 0) AS evidence_score, n_citations, confidence, CASE WHEN es IS NULL OR es < 0.05 THEN 'insufficient retrieval evidence' WHEN contains(answer, 'INSUFFICIENT_EVIDENCE') THEN 'model reported insufficient evidence' WHEN n_citations < 1 THEN 'too few grounded citations' WHEN confidence < 0.15 THEN 'low confidence' END AS abstain_reason FROM gj)"""


@query(f"{EXTRACT}, {GROUNDED} SELECT query_id, answer, evidence_score, n_citations, confidence, abstain_reason IS NOT NULL AS abstained, abstain_reason FROM gr")
def grounded_answers(spark, d):
    return generation.answer(questions(spark, d), _context(spark, d))


@query(f"""{CTX} SELECT query_id, string_agg('[' || n || '] ' || CASE WHEN cat.company IN ('', 'UNKNOWN') THEN cat.ticker ELSE cat.company END || ' ' || cat.filing_type || ' ' || cat.filing_date || ' — ' || cat.section_title || ' (Item ' || cat.item_number || ')' || chr(10) || cat.text, chr(10) || chr(10) ORDER BY n) AS prompt_context
FROM ctx JOIN cat USING (chunk_id) GROUP BY query_id""")
def prompt_contexts(spark, d):
    return generation.format_context(_context(spark, d))


@query(f"""{CTX}, bl AS (SELECT query_id, string_agg('[' || n || '] (' || cat.ticker || ' ' || cat.filing_type || ' ' || cat.filing_date || ', ' || cat.section_title || ') ' || cat.text, chr(10) || chr(10) ORDER BY n) AS prompt_context FROM ctx JOIN cat USING (chunk_id) GROUP BY query_id)
SELECT query_id, md5(prompt_context) AS digest, len(regexp_extract_all(prompt_context, '(?:^|\\n)[[][0-9]+[]]')) AS blocks FROM bl""")
def extraction_contexts(spark, d):
    """The contexts of extraction, and the number of blocks that numbered marks cut them into."""
    c = generation.extraction_context(_context(spark, d))
    return c.select("query_id", F.md5("prompt_context").alias("digest"), F.size(generation.numbered_blocks(F.col("prompt_context"))).alias("blocks"))


@query(f"WITH {Q}, qa AS (SELECT query_id, text FROM q) SELECT query_id, md5('CONTEXT:' || chr(10) || text || chr(10) || chr(10) || 'QUESTION: ' || text || chr(10) || chr(10) || 'ANSWER:') AS prompt, trim(text) AS question_again FROM qa")
def user_prompts(spark, d):
    """Prompts of questions over a context (here the question itself), and the question read back from them."""
    q = questions(spark, d).select("query_id", "text")
    p = generation.user_prompt(q.withColumn("prompt_context", F.col("text")))
    return p.select("query_id", F.md5("prompt").alias("prompt"), generation.marked(F.col("prompt"), "QUESTION").alias("question_again"))


@query(r"""WITH mx AS (SELECT answer_id, max(n) AS most FROM citations GROUP BY answer_id) SELECT answer_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\[(\d{1,9})\]', 1), lambda x: x::INT), lambda x: x BETWEEN 1 AND coalesce(most, 0)))) AS n FROM (SELECT DISTINCT answer_id, text FROM answers) LEFT JOIN mx USING (answer_id)""")
def cited_indices(spark, d):
    """The numbers each answer cites, of those that its citations have."""
    most = read_table(spark, d, "citations").groupBy("answer_id").agg(F.max("n").alias("most"))
    a = _answers(spark, d).join(most, "answer_id", "left")
    return a.select("answer_id", F.explode(verification.cited_numbers(F.col("text"), F.coalesce("most", F.lit(0)))).alias("n"))


@query(f"""{HITS}, xj AS (SELECT query_id, hits.rank, cat.text, cat.item_number = '1A' AS own, bool_or(cat.item_number = '1A') OVER (PARTITION BY query_id) AS has FROM hits JOIN cat USING (chunk_id)),
xc AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS t FROM xj WHERE own OR NOT has GROUP BY query_id), xs AS (SELECT query_id, {SENTENCES.format('t')}[:3] AS ss FROM xc)
SELECT query_id, len(ss) AS n, md5(array_to_string(ss, '|')) AS risks, true AS valid, NULL::VARCHAR AS error FROM xs""")
def extraction_instances(spark, d):
    x = extraction.extract(_hits(spark, d), catalog(spark, d, "text", "item_number"), "risk_factors")
    return x.select("query_id", F.size("data.risk_factors").alias("n"), F.md5(F.array_join("data.risk_factors.risk", "|")).alias("risks"), "valid", "error")


REPLY = "CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' || chr(10) || 'Done {ok}.' WHEN 2 THEN 'Result: ' || props || ' as asked.' WHEN 3 THEN substr(props, 1, length(props) - 1) ELSE '```' || chr(10) || props || '```' END"


@query(f"WITH r AS (SELECT event_id, event_id % 5 AS kind, {REPLY} AS reply FROM events), b AS (SELECT event_id, CASE WHEN contains(reply, '```') THEN regexp_extract(reply, '(?s)```(?:json)?\\s*(.*?)```', 1) ELSE regexp_extract(reply, '(?s)[{{].*[}}]', 0) END AS body FROM r) SELECT event_id, json_valid(body) AND body <> '' AS valid FROM b")
def json_tolerant_parse(spark, d):
    """Replies around the stored JSON: bare, fenced, within a sentence, cut off, fenced without a language."""
    reply = F.expr(REPLY.replace("chr(10)", "'\n'").replace("||", "||"))
    body = extraction.json_body(reply)
    return read_table(spark, d, "events").select("event_id", F.from_json(body, "map<string, string>").isNotNull().alias("valid"))


# ---- evaluation ------------------------------------------------------------------------------------------------------


def _retrieved(spark, d):
    h = _hits(spark, d).join(catalog(spark, d, "item_number").select("chunk_id", "item_number"), "chunk_id")
    r = evaluation.distinct_in_rank_order(h, "item_number")
    cases = read_table(spark, d, "eval_cases").select(F.col("id").alias("query_id"), "relevant_items", "answerable", "question", "gold_answer")
    none = F.array().cast("array<string>")
    return cases.join(r, "query_id", "left").withColumns({"values": F.coalesce("values", none), "relevant_items": F.coalesce("relevant_items", none)})


ITEMS = f"{HITS}, ri AS (SELECT query_id, list(item_number ORDER BY r) AS got FROM (SELECT query_id, item_number, min(hits.rank) AS r FROM hits JOIN cat USING (chunk_id) GROUP BY ALL) GROUP BY query_id), ca AS (SELECT id AS query_id, coalesce(got, []) AS got, list_distinct(coalesce(relevant_items, [])) AS gold FROM eval_cases LEFT JOIN ri ON id = query_id)"
RECALL = "CASE WHEN len(gold) = 0 THEN 0 ELSE len(list_intersect(got[:8], gold)) / len(gold) END"
RR = "coalesce(1 / nullif(list_position(list_transform(got, lambda x: list_contains(gold, x)), true), 0), 0)"


@query(f"{ITEMS} SELECT query_id, round({RECALL}, 6) AS recall, round({RR}, 6) AS rr, round(CASE WHEN len(got) = 0 THEN 0 ELSE len(list_filter(got[:8], lambda x: list_contains(gold, x))) / len(got[:8]) END, 6) AS precision FROM ca")
def retrieval_metrics(spark, d):
    v, g = F.col("values"), F.col("relevant_items")
    return _retrieved(spark, d).select("query_id", F.round(evaluation.recall_at_k(v, g, 8), 6).alias("recall"), F.round(evaluation.reciprocal_rank(v, g), 6).alias("rr"), F.round(evaluation.precision_at_k(v, g, 8), 6).alias("precision"))


@query(f"{ITEMS}, ex AS (SELECT query_id, gold, unnest(got[:8]) AS x, generate_subscripts(got[:8], 1) AS i FROM ca), hh AS (SELECT *, list_contains(gold, x)::INT AS h FROM ex), cm AS (SELECT *, sum(h) OVER (PARTITION BY query_id ORDER BY i) AS c FROM hh), sm AS (SELECT query_id, sum(h * c / i) AS s FROM cm GROUP BY query_id) SELECT ca.query_id, round(CASE WHEN len(gold) = 0 THEN 0 ELSE coalesce(s, 0) / least(len(gold), 8) END, 6) AS ap FROM ca LEFT JOIN sm USING (query_id)")
def average_precision(spark, d):
    return _retrieved(spark, d).select("query_id", F.round(evaluation.average_precision(F.col("values"), F.col("relevant_items"), 8), 6).alias("ap"))


WWORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: w <> ''))"


@query(rf"{HITS}, ps AS (SELECT id AS query_id, unnest(relevant_passages) AS p FROM eval_cases), z AS (SELECT ps.query_id, chunk_id, max(len(list_intersect({WWORDS.format('p')}, {WWORDS.format('cat.text')})) / greatest(1, len({WWORDS.format('p')}))) AS v FROM ps JOIN hits USING (query_id) JOIN cat USING (chunk_id) GROUP BY ALL) SELECT query_id, chunk_id, round(v, 6) AS best_recall, v >= 0.5 AS hit FROM z")
def passage_hits(spark, d):
    p = read_table(spark, d, "eval_cases").select(F.col("id").alias("query_id"), F.explode("relevant_passages").alias("p"))
    j = _hits(spark, d).join(p, "query_id").join(catalog(spark, d, "text").select("chunk_id", "text"), "chunk_id")
    g = j.groupBy("query_id", "chunk_id").agg(F.max(evaluation.token_recall(F.col("text"), F.col("p"))).alias("v"))
    return g.select("query_id", "chunk_id", F.round("v", 6).alias("best_recall"), (F.col("v") >= 0.5).alias("hit"))


@query("SELECT model, confidence AS p95 FROM (SELECT model, confidence, row_number() OVER (PARTITION BY model ORDER BY confidence) - 1 AS i, round_even(0.95 * (count(*) OVER (PARTITION BY model) - 1), 0) AS place FROM answers WHERE confidence IS NOT NULL) WHERE i = place")
def nearest_rank_p95(spark, d):
    return evaluation.nearest_rank(read_table(spark, d, "answers").select("model", "confidence").filter("confidence IS NOT NULL"), "confidence", 95, "model").select("model", F.col("confidence").alias("p95"))


RELEVANCE = rf"""ec AS (SELECT id AS query_id, ticker, coalesce(relevant_items, []) AS ri, coalesce(relevant_passages, []) AS rp, answerable FROM eval_cases),
rh AS (SELECT hits.query_id, CASE WHEN len(rp) > 0 THEN chunk_id ELSE cat.item_number END AS value, hits.rank, len(list_filter(rp, lambda p: len({WWORDS.format('p')}) > 0 AND len(list_intersect({WWORDS.format('p')}, {WWORDS.format('cat.text')})) / len({WWORDS.format('p')}) >= 0.5)) > 0 AS hit FROM hits JOIN cat USING (chunk_id) JOIN ec USING (query_id)),
re AS (SELECT query_id, value, min(rank) AS r, bool_or(hit) AS hit FROM rh GROUP BY ALL),
rl AS (SELECT query_id, list(value ORDER BY r) AS got, list(value ORDER BY r) FILTER (WHERE hit) AS hs FROM re GROUP BY query_id),
rg AS (SELECT query_id, answerable, len(rp) > 0 AS by_passage, coalesce(got, []) AS got, CASE WHEN len(rp) > 0 THEN coalesce(hs, []) ELSE list_distinct(ri) END AS gold FROM ec LEFT JOIN rl USING (query_id)),
xx AS (SELECT query_id, gold, unnest(got[:8]) AS x, generate_subscripts(got[:8], 1) AS i FROM rg), xh AS (SELECT *, list_contains(gold, x)::INT AS h FROM xx), xm AS (SELECT *, sum(h) OVER (PARTITION BY query_id ORDER BY i) AS c FROM xh), xs AS (SELECT query_id, sum(h * c / i) AS s FROM xm GROUP BY query_id),
cc AS (SELECT query_id, list(CASE WHEN by_passage THEN chunk_id ELSE item_number END) AS cited FROM cq JOIN rg USING (query_id) GROUP BY query_id),
gg AS (SELECT answer_id AS query_id, (count_if(verdict = 'SUPPORTED') + 0.5 * count_if(verdict = 'PARTIAL')) / count(*) AS g FROM vc GROUP BY answer_id),
cr AS (SELECT query_id, answerable, abstain_reason IS NOT NULL AS abstained, {RECALL} AS recall, {RR} AS rr, CASE WHEN len(gold) = 0 THEN 0 ELSE coalesce(s, 0) / least(len(gold), 8) END AS ap,
  coalesce(len(list_filter(cited, lambda x: list_contains(gold, x))) / nullif(len(cited), 0), 0) AS ok, round(coalesce(g, 0), 6) AS g FROM rg LEFT JOIN xs USING (query_id) LEFT JOIN cc USING (query_id) LEFT JOIN gg USING (query_id) JOIN gr USING (query_id))"""
JUDGED_ANSWERS = _claims("SELECT query_id AS answer_id, CASE WHEN abstain_reason IS NULL THEN answer ELSE '' END AS text FROM gr", "SELECT query_id AS answer_id, n, chunk_id, text FROM ctx")
CASES = f"{EXTRACT}, {GROUNDED}, {JUDGED_ANSWERS}, {RELEVANCE}"


def _case_rows(spark, d):
    """One row of measures per case: what was retrieved, what the answer cites, whether its claims hold."""
    chunks, hits = catalog(spark, d), _hits(spark, d)
    c = cut_lineage(generation.context_of(hits, chunks))
    a = cut_lineage(generation.answer(questions(spark, d), c))
    cases = read_table(spark, d, "eval_cases").select(F.col("id").alias("query_id"), "relevant_items", "relevant_passages", "answerable")
    return evaluation.case_rows(cases, hits, chunks, a, c, k=8)


@query(f"{CASES} SELECT query_id, answerable, abstained, round(recall, 6) AS recall, round(rr, 6) AS rr, round(ap, 6) AS ap, round(ok, 6) AS citations_ok, g AS groundedness FROM cr")
def eval_cases_measured(spark, d):
    m = _case_rows(spark, d)
    return m.select("query_id", "answerable", "abstained", *[F.round(x, 6).alias(x) for x in ("recall", "rr", "ap", "citations_ok")], "groundedness")


@query(f"""{CASES} SELECT count(*) AS n_cases, round(avg(recall), 6) AS recall_at_k, round(avg(rr), 6) AS mrr, round(avg(ap), 6) AS map_at_k, round(avg(CASE WHEN answerable THEN ok END), 6) AS citation_correctness,
round(avg((NOT abstained AND (NOT answerable OR ok = 0))::INT), 6) AS hallucination_rate, round(avg(CASE WHEN NOT answerable THEN abstained::INT END), 6) AS abstention_recall,
round(avg(CASE WHEN answerable AND NOT abstained THEN g END), 6) AS lexical_groundedness, round(avg(CASE WHEN answerable AND NOT abstained THEN (g >= 1)::INT END), 6) AS fully_grounded_rate FROM cr""")
def eval_rollup(spark, d):
    return evaluation.roll_up(_case_rows(spark, d))


@query("WITH m AS (SELECT model AS metric, avg(confidence) AS value FROM answers WHERE asked_at >= TIMESTAMP '2025-09-01' GROUP BY model), b AS (SELECT model AS metric, avg(confidence) AS value FROM answers WHERE asked_at < TIMESTAMP '2025-09-01' GROUP BY model) SELECT metric, round(m.value - b.value, 6) AS delta, CASE WHEN b.value IS NULL THEN 'added' WHEN m.value IS NULL THEN 'removed' WHEN round(m.value - b.value, 6) > 0.01 THEN 'regression' ELSE 'ok' END AS status FROM m FULL JOIN b USING (metric)")
def snapshot_diff(spark, d):
    a = read_table(spark, d, "answers").withColumn("late", F.col("asked_at") >= F.lit("2025-09-01").cast("timestamp"))
    side = lambda late: a.filter(F.col("late") == late).groupBy(F.col("model").alias("metric")).agg(F.avg("confidence").alias("value"))
    return evaluation.snapshot_diff(side(True), side(False)).select("metric", "delta", "status")


_RELEVANT = f"CASE WHEN len(rp) > 0 THEN len(list_filter(rp, lambda p: len({WWORDS.format('p')}) > 0 AND len(list_intersect({WWORDS.format('p')}, {WWORDS.format('cat.text')})) / len({WWORDS.format('p')}) >= 0.5)) > 0 ELSE list_contains(ri, cat.item_number) END"
_UNIT = "SELECT query_id, chunk_id, CASE WHEN max(score) OVER p - min(score) OVER p < 1e-12 THEN 1.0 ELSE (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) END AS s FROM {} WINDOW p AS (PARTITION BY query_id)"


@query(f"""{BOTH}, ec AS (SELECT id AS query_id, coalesce(relevant_items, []) AS ri, coalesce(relevant_passages, []) AS rp FROM eval_cases),
du AS ({_UNIT.format('d')}), bu AS ({_UNIT.format('b')}), un AS (SELECT query_id, chunk_id, coalesce(du.s, 0) AS ds, coalesce(bu.s, 0) AS bs FROM du FULL JOIN bu USING (query_id, chunk_id)),
go AS (SELECT query_id, chunk_id FROM un JOIN cat USING (chunk_id) JOIN ec USING (query_id) WHERE {_RELEVANT}), gs AS (SELECT query_id, count(*) AS size FROM go GROUP BY query_id),
ws AS (SELECT unnest(range(0, 11)) / 10 AS w), sw AS (SELECT w, query_id, chunk_id, row_number() OVER (PARTITION BY w, query_id ORDER BY round(w * bs + (1 - w) * ds, 6) DESC, chunk_id) AS r FROM un, ws),
sh AS (SELECT w, query_id, count(*) AS hits, min(r) AS first FROM sw JOIN go USING (query_id, chunk_id) WHERE r <= 8 GROUP BY ALL),
sm AS (SELECT w, round(avg(coalesce(hits / size, 0)), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM gs CROSS JOIN ws LEFT JOIN sh USING (w, query_id) GROUP BY w)
SELECT w AS lexical_weight, recall, mrr, row_number() OVER (ORDER BY recall + mrr DESC, w) = 1 AS best FROM sm""")
def weight_sweep(spark, d):
    """Fusion weights against what the cases themselves call relevant: chunks that hold a passage, or are of a relevant item."""
    dense, lexical = _lists(spark, d)
    found = dense.select("query_id", "chunk_id").union(lexical.select("query_id", "chunk_id")).distinct().withColumn("rank", F.lit(0))
    cases = read_table(spark, d, "eval_cases").select(F.col("id").alias("query_id"), "relevant_items", "relevant_passages")
    gold = evaluation.relevant_chunks(cases, found, catalog(spark, d, "text", "item_number"))
    return evaluation.weight_sweep(dense, lexical, cut_lineage(gold))


_WANT = "[['going_concern', 'liquidity'], ['litigation', 'impairment'], ['restatement', 'material_weakness', 'litigation'], []][length(question) % 4 + 1]"
ENFORCED = f"""{HITS}, {SIG.replace(CAT + ', ', '')}, kt AS (SELECT upper(ticker) AS t, list_distinct(list(signal_type)) AS s FROM sg GROUP BY 1), ka AS (SELECT list_distinct(list(signal_type)) AS s FROM sg),
it AS (SELECT query_id, list_distinct(list(cat.item_number)) AS got FROM hits JOIN cat USING (chunk_id) GROUP BY query_id),
ef AS (SELECT id, CASE WHEN e.ticker IS NULL OR e.ticker = '' THEN ka.s ELSE coalesce(kt.s, []) END AS s, {_WANT} AS want, coalesce(got, []) AS got, list_distinct(coalesce(relevant_items, [])) AS items FROM eval_cases e CROSS JOIN ka LEFT JOIN kt ON kt.t = upper(e.ticker) LEFT JOIN it ON it.query_id = e.id),
eo AS (SELECT id AS case_id, round(CASE WHEN len(want) = 0 THEN 0 ELSE len(list_intersect(s, want)) / len(want) END, 6) AS signal_recall, round(CASE WHEN len(items) = 0 THEN 0 ELSE len(list_intersect(got, items)) / len(items) END, 6) AS evidence_recall FROM ef)"""


def _enforced(spark, d):
    c = catalog(spark, d)
    s = signals.detect(c).join(c.select("chunk_id", "ticker"), "chunk_id").select("ticker", "signal_type")
    want = F.expr("element_at(array(array('going_concern', 'liquidity'), array('litigation', 'impairment'), array('restatement', 'material_weakness', 'litigation'), cast(array() AS array<string>)), length(question) % 4 + 1)")
    cases = read_table(spark, d, "eval_cases").select(F.col("id").alias("case_id"), "ticker", want.alias("expected_signals"), F.col("relevant_items").alias("expected_items"))
    items = _hits(spark, d).join(c.select("chunk_id", "item_number"), "chunk_id").select(F.col("query_id").alias("case_id"), "item_number")
    return evaluation.enforcement(cases, s, items)


@query(f"{ENFORCED} SELECT * FROM eo")
def enforcement_cases(spark, d):
    return _enforced(spark, d)


@query(f"{ENFORCED} SELECT count(*) AS n_cases, round(avg(signal_recall), 6) AS signal_recall, round(avg(evidence_recall), 6) AS evidence_retrieval_recall FROM eo")
def enforcement_rollup(spark, d):
    return evaluation.enforcement_means(_enforced(spark, d))


# ---- ingest ----------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT *, loaded_at >= TIMESTAMPTZ '2022-08-09 00:00:00+00' AS fresh FROM filings) SELECT accession, md5(text) AS digest, loaded_at::VARCHAR AS loaded FROM l QUALIFY row_number() OVER (PARTITION BY accession ORDER BY fresh DESC, loaded_at DESC) = 1""".replace("loaded_at::VARCHAR", "epoch_us(loaded_at)"))
def upsert_latest(spark, d):
    """Later deliveries put into what was there before them."""
    f = read_table(spark, d, "filings").select("accession", "text", F.unix_micros("loaded_at").alias("ord"))
    since = F.unix_micros(F.lit("2022-08-09 00:00:00").cast("timestamp"))
    old = one_per_key(f.filter(F.col("ord") < since), "accession", "ord", last=True)
    merged = index.upsert(old, f.filter(F.col("ord") >= since), "accession")
    return merged.select("accession", F.md5("text").alias("digest"), F.col("ord").alias("loaded"))


@query("SELECT DISTINCT accession FROM filings WHERE accession NOT IN (SELECT accession FROM chunks WHERE loaded_at < TIMESTAMPTZ '2022-08-23 00:00:00+00')")
def resume_anti_join(spark, d):
    """What is still to be indexed at a point in time: filings without a chunk loaded until then."""
    there = read_table(spark, d, "chunks").filter(F.col("loaded_at") < F.lit("2022-08-23 00:00:00").cast("timestamp")).select("accession")
    return read_table(spark, d, "filings").select("accession").distinct().join(there, "accession", "left_anti")


@query("""SELECT ticker, accession, filing_type, filing_date FROM (SELECT DISTINCT ticker, accession, filing_type, filing_date FROM filings WHERE filing_type IN ('10-K', '10-Q', '8-K') AND regexp_matches(filing_date, '^\\d{4}-\\d{2}-\\d{2}$') AND filing_date BETWEEN '2020-01-01' AND '2023-12-31')
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY CASE filing_type WHEN '10-K' THEN 0 WHEN '10-Q' THEN 1 ELSE 2 END, filing_date DESC, accession DESC) = 1""")
def selected_filings(spark, d):
    f = read_table(spark, d, "filings")
    return source.select_filings(f, ["10-K", "10-Q", "8-K"], start="2020-01-01", end="2023-12-31").select("ticker", "accession", "filing_type", "filing_date")


@query("""SELECT DISTINCT accession, CASE WHEN trim(company) = '' THEN ticker ELSE trim(company) END AS company, CASE WHEN filing_date = '' THEN 'UNKNOWN' ELSE filing_date END AS filing_date, CASE WHEN filing_type LIKE '10-K%' AND fiscal_year <> '' THEN substr(fiscal_year, 1, 4) WHEN filing_date IN ('', 'UNKNOWN') THEN 'UNKNOWN' ELSE substr(filing_date, 1, 4) END AS fiscal_year,
CASE WHEN trim(source_url) <> '' THEN trim(source_url) WHEN try_cast(cik AS BIGINT) IS NOT NULL AND accession NOT IN ('', 'UNKNOWN') THEN 'https://www.sec.gov/Archives/edgar/data/' || try_cast(cik AS BIGINT) || '/' || replace(accession, '-', '') || '/' || accession || '-index.htm' ELSE '' END AS source_url FROM filings""")
def filing_provenance(spark, d):
    """Metadata of filings as they come: a period of report for annual reports only, dates and urls where known."""
    f = read_table(spark, d, "filings")
    raw = f.select("ticker", "company", "cik", F.col("filing_type").alias("form"), "filing_date", F.when(F.col("filing_type").startswith("10-K"), F.concat("fiscal_year", F.lit("-12-31"))).alias("period"), "accession", "source_url", "source_path")
    return source.provenance(raw).select("accession", "company", "filing_date", "fiscal_year", "source_url").distinct()


@query(f"WITH {CAT}, t AS (SELECT ticker, list_sort(list_distinct(list(item_number))) AS i FROM cat GROUP BY ticker) SELECT ticker, array_to_string(i, ' ') AS items FROM t")
def items_sorted(spark, d):
    """The items of each ticker in the order of their names: 1, 10, 1A, 2."""
    g = catalog(spark, d, "ticker", "item_number").groupBy("ticker").agg(F.array_join(F.array_sort(F.collect_set("item_number")), " ").alias("items"))  # a few dozen items at most
    return g


@query("SELECT filing_type, fiscal_year, count(DISTINCT accession) AS n FROM filings GROUP BY ALL")
def checkpoint_counts(spark, d):
    return read_table(spark, d, "filings").groupBy("filing_type", "fiscal_year").agg(F.countDistinct("accession").alias("n"))


@query("WITH w AS (SELECT t.ticker, f.filing_type, y.y::VARCHAR AS fiscal_year FROM (SELECT DISTINCT ticker FROM filings) t, (SELECT DISTINCT filing_type FROM filings) f, (SELECT unnest(range(2019, 2026)) AS y) y) SELECT * FROM w WHERE (ticker, filing_type, fiscal_year) NOT IN (SELECT (ticker, filing_type, fiscal_year) FROM filings)")
def worklist_open(spark, d):
    """Ticker, form and year still to be fetched: the work list without what is there."""
    f = read_table(spark, d, "filings")
    forms = [r.filing_type for r in f.select("filing_type").distinct().limit(1001).collect()]
    if len(forms) > 1000:
        raise ValueError("over 1000 forms; name those wanted")
    return source.open_work(f.select("ticker").distinct(), forms, [str(y) for y in range(2019, 2026)], f).select("ticker", "filing_type", "fiscal_year")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def audit_windows(spark, d):
    e = read_table(spark, d, "events")
    return e.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# ---- stored and streamed ---------------------------------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    """A new folder beside the other intermediates, where every executor sees it."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {BM25} SELECT query_id, chunk_id, score, rank FROM ({RANKED.format('bs')}) WHERE rank < 10")
def stored_index_topk(spark, d):
    """BM25 from an index that is written, read again and looked up by the words of the questions."""
    path = _folder(spark, "index")
    index.write_index(read_table(spark, d, "chunks"), path)
    t = index.read_index(spark, path, index.VectorSpace())
    return packed.best_by_postings(t["postings"], t["term_stats"], t["corpus_stats"], questions(spark, d), 10)


@query(ORACLE["chunk_filing"].replace("AS chunk_id, accession, item_number, title AS section_title, char_start, char_start + length(text) AS char_end, ord AS section_ordinal, text", "AS chunk_id, accession, item_number, md5(text) AS digest"))
def streamed_chunks(spark, d):
    """Filings taken in as a stream, file by file, and the latest row of each chunk read back."""
    f = read_table(spark, d, "filings")
    out = _folder(spark, "stream")
    ingest.ingest(ingest.stream_filings(spark, f"{d}/filings.parque[t]", f.schema, 2), f"{out}/chunks", f"{out}/state").awaitTermination()
    return ingest.upserted(spark, f"{out}/chunks").select("chunk_id", "accession", "item_number", F.md5("text").alias("digest"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, 'event' AS event FROM events GROUP BY event_type")
def audit_log(spark, d):
    """Events appended to the log as JSON lines, and counted from what is read back."""
    path = _folder(spark, "audit")
    index.append_audit(spark, path, "event", read_table(spark, d, "events").select("event_id", "event_type", "value"))
    log = spark.read.schema("event string, payload string").json(path).select("event", F.from_json("payload", "event_id long, event_type string, value double").alias("p"))
    return log.groupBy("p.event_type", "event").agg(F.count("*").alias("n"), F.round(F.sum("p.value"), 4).alias("total")).select("event_type", "n", "total", "event")
