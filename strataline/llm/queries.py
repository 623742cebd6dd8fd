"""Queries of the training-data operators: name -> (session, folder of the tables) -> result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataline.llm import leakage, lookalikes, markup, mixing, near_duplicates, pairs, pii, quality, splitting
from strataline.session import cut_lineage, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


# SQL by brute force over the whole tables, or properties of results that SQL can't compute (texts cut by a heap, seeded
# choices). The other queries have none: they come from trained models, and their tests hold them against small fixtures.
ORACLE["p1_found"] = r"""
WITH rec AS (
  SELECT DISTINCT 'c' AS tbl, chunk_id AS key, text FROM chunks
  UNION ALL SELECT 'd', diff_id || ':added:' || (i - 1), x FROM (SELECT diff_id, unnest(added) AS x, generate_subscripts(added, 1) AS i FROM section_diffs)
  UNION ALL SELECT 'd', diff_id || ':removed:' || (i - 1), x FROM (SELECT diff_id, unnest(removed) AS x, generate_subscripts(removed, 1) AS i FROM section_diffs)
  UNION ALL SELECT 'd', diff_id || ':old:' || (i - 1), x.old_text FROM (SELECT diff_id, unnest(changed) AS x, generate_subscripts(changed, 1) AS i FROM section_diffs)
  UNION ALL SELECT 'd', diff_id || ':new:' || (i - 1), x.new_text FROM (SELECT diff_id, unnest(changed) AS x, generate_subscripts(changed, 1) AS i FROM section_diffs)),
w AS (SELECT tbl, key, list_filter(regexp_split_to_array(lower(text), '[ \t\r\n\f\x0B]+'), lambda x: x <> '') AS ws FROM rec WHERE text IS NOT NULL),
s AS (SELECT DISTINCT tbl, key, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS sh FROM w WHERE len(ws) >= 30),
n AS (SELECT tbl, key, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.tbl, a.key AS l, b.key AS r, count(*) AS c FROM s a JOIN s b ON a.tbl = b.tbl AND a.sh = b.sh AND a.key < b.key GROUP BY ALL)
SELECT l AS left_key, r AS right_key FROM p JOIN n x ON x.tbl = p.tbl AND x.key = l JOIN n y ON y.tbl = p.tbl AND y.key = r WHERE c >= 0.5 * (x.n + y.n - c)"""
_P1 = ORACLE["p1_found"].rsplit("SELECT l AS left_key", 1)[0].strip()
ORACLE["p1_groups"] = _P1.replace("WITH rec", "WITH RECURSIVE rec", 1) + r""",
li AS (SELECT p.tbl, l, r FROM p JOIN n x ON x.tbl = p.tbl AND x.key = l JOIN n y ON y.tbl = p.tbl AND y.key = r WHERE c >= 0.5 * (x.n + y.n - c)),
cl AS (SELECT DISTINCT tbl, key, min(key) OVER (PARTITION BY tbl, array_to_string(ws, ' ')) AS class_key FROM w WHERE len(ws) >= 30),
ed AS (SELECT DISTINCT li.tbl, a.class_key AS x, b.class_key AS y FROM li JOIN cl a ON a.tbl = li.tbl AND a.key = l JOIN cl b ON b.tbl = li.tbl AND b.key = r WHERE a.class_key <> b.class_key),
bo AS (SELECT tbl, x, y FROM ed UNION SELECT tbl, y, x FROM ed),
re AS (SELECT tbl, x AS node, x AS seen FROM bo UNION SELECT re.tbl, node, y FROM re JOIN bo ON bo.tbl = re.tbl AND bo.x = re.seen),
gr AS (SELECT tbl, node, min(seen) AS least FROM re GROUP BY ALL), de AS (SELECT tbl, x, count(*) AS links FROM bo GROUP BY ALL)
SELECT CASE cl.tbl WHEN 'c' THEN 'chunks' ELSE 'section_diffs' END AS tbl, key, class_key, coalesce(least, class_key) AS group_key, coalesce(links, 0) AS links
FROM cl LEFT JOIN gr ON gr.tbl = cl.tbl AND gr.node = class_key LEFT JOIN de ON de.tbl = cl.tbl AND de.x = class_key"""
_AWS = r"[\t-\r ]"
_STOPS = "[" + ", ".join(f"'{w}'" for w in sorted(markup.STOP_WORDS)) + "]"
ORACLE["p2_statistics"] = rf"""
WITH t AS (SELECT chunk_id, coalesce(text, '') AS t FROM chunks),
v AS (SELECT chunk_id, t, list_filter(regexp_split_to_array(regexp_replace(t, '^{_AWS}+|{_AWS}+$', '', 'g'), '{_AWS}+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS l FROM t)
SELECT chunk_id, length(t) AS n_chars, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / nullif(len(w), 0) AS mean_word_length,
  length(regexp_replace(t, '[\p{{L}}\p{{N}}\t-\r ]', '', 'g')) / nullif(length(t), 0) AS symbol_ratio, length(regexp_replace(t, '[^0-9]', '', 'g')) / nullif(length(t), 0) AS digit_ratio,
  len(list_filter(l, lambda x: regexp_matches(rtrim(x), '[.!?:;"]$'))) / nullif(len(l), 0) AS punctuated_lines, len(list_filter(w, lambda x: list_contains({_STOPS}, lower(x)))) / nullif(len(w), 0) AS common_words FROM v"""
# Properties that every result must have, told by chunk, document or mix; the SQL says for which rows they must hold.
ORACLE["p6_checked"] = "SELECT DISTINCT chunk_id, true AS fits, true AS covers, true AS overlaps FROM chunks WHERE length(text) > 1800"
ORACLE["p8_checked"] = "SELECT DISTINCT mix_name, source, true AS within_repeats, true AS near_budget FROM mix_targets"
_LONGEST = "list_max(list_transform({}, lambda x: length(x)))"
_PARAS = r"string_split(regexp_replace(text, '\n[^\S\n]*\n\s*', chr(1), 'g'), chr(1))"
_SENTS = r"string_split(regexp_replace(regexp_replace(text, '\n[^\S\n]*\n\s*', chr(1), 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_SPACED = r"regexp_split_to_array(text, '\s+')"
ORACLE["p6_found"] = f"""SELECT DISTINCT chunk_id, CASE WHEN {_LONGEST.format(_PARAS)} <= 1800 THEN 'paragraph' WHEN {_LONGEST.format(_SENTS)} <= 1800 THEN 'sentence'
WHEN {_LONGEST.format(_SPACED)} <= 1800 THEN 'word' ELSE 'none' END AS cut_level FROM chunks WHERE length(text) > 1800"""
_GRAMS = "unnest(list_transform(range(1, len(ws) - 10), lambda i: array_to_string(ws[i:i + 11], ' '))) AS g"
ORACLE["p7_found"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM documents WHERE text IS NOT NULL),
c AS (SELECT id, regexp_extract_all(lower(p), '[\p{{L}}\p{{N}}]+') AS ws FROM (SELECT id, unnest(relevant_passages) AS p FROM eval_cases)),
dg AS (SELECT DISTINCT doc_id, {_GRAMS} FROM d), cg AS (SELECT DISTINCT id, {_GRAMS} FROM c)
SELECT DISTINCT doc_id, id AS case_id FROM dg JOIN cg USING (g)"""

ORACLE["p7_checked"] = f"""SELECT doc_id, string_agg(case_id, ' ' ORDER BY case_id) AS case_ids, true AS clean FROM ({ORACLE["p7_found"]}) GROUP BY doc_id"""


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# ---- 1: near-duplicates ----------------------------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.filing_records(read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "section_diffs"))


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.pairs(_records(spark, sf_dir), words=3, threshold=0.5, min_words=30).select("left_key", "right_key")


@query
def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(_records(spark, sf_dir), words=3, threshold=0.5, min_words=30)


# ---- 6: oversized items ----------------------------------------------------------------------------------------------


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "chunks")


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split(_chunks(spark, sf_dir)).filter("piece = 0").select("chunk_id", "cut_level").distinct()


@query
def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _chunks(spark, sf_dir).filter(F.length("text") > 1800)
    once = long.select("chunk_id", "text", "item_number", "accession", "char_start", "char_end").dropDuplicates(["chunk_id"])
    placed = splitting.right_offsets(once, read_table(spark, sf_dir, "filings"))
    return splitting.split(placed).join(once.select("chunk_id", "item_number"), "chunk_id")


@query
def p6_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pieces of each long chunk fit the limit, stand where they say and cover it, and overlap by 200 characters at most."""
    once = _chunks(spark, sf_dir).filter(F.length("text") > 1800).select("chunk_id", "text").distinct().withColumn("char_start", F.lit(0))
    p = splitting.split(once).join(once.select("chunk_id", "text"), "chunk_id")
    before = F.lag("char_end").over(Window.partitionBy("chunk_id").orderBy("piece"))  # the pieces of one text
    p = p.withColumns({"gap": F.coalesce(before, F.lit(0)) - F.col("char_start"), "right": F.substring("text", F.col("char_start") + 1, F.length("piece_text")) == F.col("piece_text")})
    told = p.groupBy("chunk_id").agg(F.max(F.length("piece_text")).alias("most"), F.min("right").alias("right"), F.min("gap").alias("least"), F.max("gap").alias("widest"), F.max("char_end").alias("end"), F.max(F.length("text")).alias("size"))
    return told.select("chunk_id", (F.col("most") <= 1800).alias("fits"), (F.col("right") & (F.col("least") >= 0) & (F.col("end") == F.col("size"))).alias("covers"), (F.col("widest") <= 200).alias("overlaps"))


# ---- 7: leaked evaluation texts --------------------------------------------------------------------------------------


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = read_table(spark, sf_dir, "eval_cases").select(F.col("id").alias("case_id"), F.explode("relevant_passages").alias("passage"))
    return leakage.scan(read_table(spark, sf_dir, "documents"), cases, least=12)


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", F.explode("case_ids").alias("case_id")).distinct()


@query
def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


@query
def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases that each document gives away, and whether no passage of 50 words is left in its cleaned text."""
    found = cut_lineage(_leaks(spark, sf_dir))
    cases = read_table(spark, sf_dir, "eval_cases").select(F.col("id").alias("case_id"), F.explode("relevant_passages").alias("passage"))
    left = leakage.scan(found.select("doc_id", F.col("cleaned").alias("text")), cases, least=50).select("doc_id", F.lit(False).alias("ok"))
    return found.join(left, "doc_id", "left").select("doc_id", F.array_join("case_ids", " ").alias("case_ids"), F.coalesce("ok", F.lit(True)).alias("clean"))


# ---- 4: look-alike characters ----------------------------------------------------------------------------------------


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "citations")
    out = _chunks(spark, sf_dir).select(F.col("chunk_id").alias("record_id"), F.lit("text").alias("field_name"), F.col("text").alias("value"))
    for name in ("quote", "support_quote"):
        out = out.unionByName(c.select(F.col("citation_id").alias("record_id"), F.lit(name).alias("field_name"), F.col(name).alias("value")))
    return out


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.found(_values(spark, sf_dir))


@query
def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.forms(_values(spark, sf_dir))


@query
def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.groups(lookalikes.forms(_values(spark, sf_dir)))


@query
def p4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.quotes_in_chunks(read_table(spark, sf_dir, "citations"), _chunks(spark, sf_dir))


# ---- 3: markup left in texts -----------------------------------------------------------------------------------------


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.found(_chunks(spark, sf_dir))


@query
def p3_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.cleaned(_chunks(spark, sf_dir)).select("chunk_id", "clean_text", F.size("blocks").alias("n_blocks"))


# ---- 2: text statistics ----------------------------------------------------------------------------------------------


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.found(_chunks(spark, sf_dir)).select("chunk_id", "field_name", "kind")


@query
def p2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_statistics(_chunks(spark, sf_dir))


# ---- 5: broken question and answer pairs -----------------------------------------------------------------------------


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = read_table(spark, sf_dir, "answers").select(F.lit("answers").alias("table_name"), F.col("answer_id").alias("record_id"), "question", "text", F.col("abstained").alias("exempt"))
    cases = read_table(spark, sf_dir, "eval_cases").select(F.lit("eval_cases").alias("table_name"), F.col("id").alias("record_id"), "question", F.col("gold_answer").alias("text"), (~F.col("answerable")).alias("exempt"))
    return pairs.defects(answers.unionByName(cases))


# ---- 9: personal information -----------------------------------------------------------------------------------------


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(read_table(spark, sf_dir, "documents")).select("doc_id", "pii_type", "char_start")


@query
def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(read_table(spark, sf_dir, "documents"))


# ---- 8: mixes of sources ---------------------------------------------------------------------------------------------


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.select(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


@query
def p8_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0].select("mix_name", "doc_id", "source", "uses")


@query
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


@query
def p8_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source of each mix keeps to its repeats, and its tokens to its budget (within 2 percent and one long document a language)."""
    chosen, report = _mixed(spark, sf_dir)
    targets = read_table(spark, sf_dir, "mix_targets").groupBy("mix_name", "source").agg(F.max("max_repeats").alias("most"))
    uses = cut_lineage(chosen).groupBy("mix_name", "source").agg(F.max("uses").alias("uses"), F.max("tokens").alias("longest"))
    j = targets.join(report, ["mix_name", "source"], "left").join(uses, ["mix_name", "source"], "left")
    room = 0.02 * F.col("budget") + (len(mixing.LANGUAGES) + 1) * F.coalesce("longest", F.lit(0))
    return j.select("mix_name", "source", (F.coalesce("uses", F.lit(0)) <= F.col("most")).alias("within_repeats"), F.coalesce(F.abs(F.col("tokens") - F.col("budget")) <= room, F.lit(False)).alias("near_budget"))
