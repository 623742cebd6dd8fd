"""Extractive answers from retrieved chunks, with citations, confidence and abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataline.functions import text as T

SENTENCES, CONTEXT, QUOTE = 4, 6, 240
MIN_EVIDENCE, MIN_CITATIONS, MIN_CONFIDENCE = 0.05, 1, 0.15
INSUFFICIENT = "INSUFFICIENT_EVIDENCE"


def context_of(hits: DataFrame, chunks: DataFrame, size: int = CONTEXT, key: str = "chunk_id") -> DataFrame:
    """The first hits of each query with their chunks; n counts from 1."""
    return hits.filter(F.col("rank") < size).withColumn("n", F.col("rank") + 1).join(chunks, key)


def format_context(context: DataFrame) -> DataFrame:
    """(query_id, prompt_context): numbered excerpts with their origin, best first."""
    who = F.when(F.col("company").isin("", "UNKNOWN"), F.col("ticker")).otherwise(F.col("company"))
    block = F.format_string("[%d] %s %s %s — %s (Item %s)\n%s", "n", who, "filing_type", "filing_date", "section_title", "item_number", "text")
    g = context.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))).alias("l"))
    return g.select("query_id", F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("prompt_context"))


def extraction_context(context: DataFrame) -> DataFrame:
    """(query_id, prompt_context): numbered excerpts as extraction has them, best first."""
    block = F.format_string("[%d] (%s %s %s, %s) %s", "n", "ticker", "filing_type", "filing_date", "section_title", "text")
    g = context.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))).alias("l"))
    return g.select("query_id", F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("prompt_context"))


def numbered_blocks(prompt_context: Column) -> Column:
    """array<struct<n, text>> of a context: what stands from each `[n]` at the start of a line to the next."""
    parts = F.filter(F.split(prompt_context, r"(?:^|\n)(?=\[\d+\])"), lambda x: x.rlike(r"^\[\d+\]"))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^\[(\d+)\]", 1).cast("int").alias("n"), F.trim(F.regexp_replace(x, r"^\[\d+\]", "")).alias("text")))


#: Instructions for models that answer, judge and repair; the operators only put them together.
SYSTEM = "Answer from the numbered excerpts alone and cite them as [n]. If they don't hold the answer, reply " + INSUFFICIENT + "."
JUDGE_SYSTEM = 'Judge each claim by the excerpts. Reply with JSON: {"claims": [{"claim", "verdict": SUPPORTED, PARTIAL, CONTRADICTED or UNSUPPORTED, "citation", "quote"}]}.'


def user_prompt(contexts: DataFrame) -> DataFrame:
    """contexts (query_id, text, prompt_context) with `prompt`: the excerpts, then the question."""
    return contexts.withColumn("prompt", F.format_string("CONTEXT:\n%s\n\nQUESTION: %s\n\nANSWER:", "prompt_context", "text"))


def judge_prompt(answers: DataFrame) -> DataFrame:
    """answers (query_id, answer, prompt_context) with `prompt` for a judge."""
    return answers.withColumn("prompt", F.format_string("CONTEXT:\n%s\n\nANSWER: %s\n\nCLAIMS:", "prompt_context", "answer"))


def repair_prompt(answers: DataFrame) -> DataFrame:
    """answers (query_id, text, answer, flagged array of claims, prompt_context) with `prompt`: the question again, naming the claims that failed."""
    listed = F.array_join(F.transform("flagged", lambda c: F.concat(F.lit("- "), c)), "\n")
    return answers.withColumn("prompt", F.format_string("CONTEXT:\n%s\n\nQUESTION: %s\n\nDRAFT: %s\n\nUNSUPPORTED:\n%s\n\nANSWER:", "prompt_context", "text", "answer", listed))


def marked(prompt: Column, name: str) -> Column:
    """What stands after `NAME:` up to the next mark of three or more capitals at the start of a line."""
    return F.trim(F.regexp_extract(prompt, rf"(?s)(?:^|\n){name}:[ \t]*\n?(.*?)(?=\n+[A-Z]{{3,}}:|$)", 1))


def extract(queries: DataFrame, context: DataFrame, most: int = SENTENCES) -> DataFrame:
    """(query_id, answer): the sentences of the context closest to the question and the numbers of their excerpts.

    A sentence scores its keywords in common with the question over 1 + |keywords - 18| / 40. Equal sentences count
    once, ties go to the first excerpt and place. Without a common word the answer is INSUFFICIENT_EVIDENCE.
    """
    q = queries.select("query_id", T.keywords(F.col("text")).alias("wanted"))
    s = context.select("query_id", "n", F.posexplode(T.sentences(F.col("text"))).alias("place", "sentence")).join(q, "query_id")
    s = s.withColumn("words", T.keywords(F.col("sentence"))).withColumn("common", F.size(F.array_intersect("words", "wanted"))).filter("common > 0")
    s = s.withColumn("score", F.round(F.col("common") / (1 + F.abs(F.size("words") - 18) / 40), 6))
    once = s.groupBy("query_id", F.lower("sentence").alias("same")).agg(F.min(F.struct((-F.col("score")).alias("m"), "n", "place", "sentence")).alias("b")).select("query_id", "b.*")
    w = Window.partitionBy("query_id").orderBy("m", "n", "place")
    best = once.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
    g = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("r", "sentence"))).alias("l"), F.array_sort(F.collect_set("n")).alias("cited"))
    text = F.concat_ws(" ", F.array_join(F.transform("l", lambda x: x["sentence"]), " "), F.array_join(F.transform("cited", lambda n: F.format_string("[%d]", n)), " "))
    return queries.select("query_id").join(g.select("query_id", text.alias("answer")), "query_id", "left").withColumn("answer", F.coalesce("answer", F.lit(INSUFFICIENT)))


def evidence(context: DataFrame) -> DataFrame:
    """(query_id, evidence_score, agreement, n_context).

    evidence_score is the best of the dense scores and the lexical scores relative to the largest; agreement the share
    of excerpts with both above 0.
    """
    d, b = F.coalesce("dense", F.lit(0.0)), F.coalesce("bm25", F.lit(0.0))
    most = F.max(b).over(Window.partitionBy("query_id"))
    c = context.withColumn("e", F.greatest(d, F.when(most > 0, b / most).otherwise(0.0))).withColumn("both", ((d > 0) & (b > 0)).cast("int"))
    return c.groupBy("query_id").agg(F.round(F.greatest(F.lit(0.0), F.max("e")), 6).alias("evidence_score"), F.round(F.avg("both"), 6).alias("agreement"), F.count("*").alias("n_context"))


def confidence(evidence_score: Column, citations: Column, agreement: Column) -> Column:
    value = 0.5 * evidence_score + 0.3 * F.least(F.lit(1.0), citations / 2) + 0.2 * agreement
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 6)


def verified_confidence(value: Column, groundedness: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value * (0.4 + 0.6 * groundedness))), 6)


def cited_numbers(text: Column, n: Column, least: int = MIN_CITATIONS) -> Column:
    """Numbers of the excerpts that the answer cites; the first `least` where it cites none."""
    from strataline.operators.verification import cited_numbers as found

    given = found(text, n)
    return F.when(F.size(given) > 0, given).otherwise(F.slice(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), 1, least))


def citations(answers: DataFrame, context: DataFrame, quote_chars: int = QUOTE, least: int = MIN_CITATIONS) -> DataFrame:
    """(query_id, n, chunk_id, quote, score) of the excerpts that each answer relies on."""
    size = context.groupBy("query_id").agg(F.count("*").cast("int").alias("size"))
    c = answers.join(size, "query_id").select("query_id", F.explode(cited_numbers(F.col("answer"), F.col("size"), least)).alias("n"))
    j = c.join(context, ["query_id", "n"])
    return j.select("query_id", "n", "chunk_id", F.substring(T.collapse(F.col("text")), 1, quote_chars).alias("quote"), F.round("fused", 4).alias("score"))


def gate(evidence_score: Column, answer: Column, n_citations: Column, value: Column, min_evidence: float = MIN_EVIDENCE, min_citations: int = MIN_CITATIONS, min_confidence: float = MIN_CONFIDENCE) -> Column:
    """Why an answer abstains, or null: the first of weak evidence, nothing to say, few citations, low confidence."""
    # The reasons.
    return (
        F.when(evidence_score.isNull() | (evidence_score < min_evidence), "insufficient retrieval evidence")
        .when(F.contains(answer, F.lit(INSUFFICIENT)), "model reported insufficient evidence")
        .when(n_citations < min_citations, "too few grounded citations")
        .when(value < min_confidence, "low confidence")
    )


def answer(queries: DataFrame, context: DataFrame, answerer=extract, min_evidence: float = MIN_EVIDENCE, min_citations: int = MIN_CITATIONS, min_confidence: float = MIN_CONFIDENCE, quote_chars: int = QUOTE) -> DataFrame:
    """(query_id, answer, evidence_score, n_citations, confidence, abstained, abstain_reason), one row per query.

    context: query_id, n, chunk_id, text, dense, bm25, fused. Queries without context abstain. answerer maps (queries,
    context) to (query_id, answer); queries it has no row for count as having no answer.
    """
    a = queries.select("query_id").join(answerer(queries, context).select("query_id", "answer"), "query_id", "left").withColumn("answer", F.coalesce("answer", F.lit(INSUFFICIENT)))
    e = evidence(context)
    cited = citations(a, context, quote_chars, min_citations).groupBy("query_id").agg(F.count("*").alias("n_citations"))
    j = a.join(e, "query_id", "left").join(cited, "query_id", "left").na.fill(0, ["n_citations"])
    j = j.withColumn("confidence", F.coalesce(confidence(F.col("evidence_score"), F.col("n_citations"), F.col("agreement")), F.lit(0.0)))
    j = j.withColumn("abstain_reason", gate(F.col("evidence_score"), F.col("answer"), F.col("n_citations"), F.col("confidence"), min_evidence, min_citations, min_confidence))
    return j.select("query_id", "answer", F.coalesce("evidence_score", F.lit(0.0)).alias("evidence_score"), "n_citations", "confidence", F.col("abstain_reason").isNotNull().alias("abstained"), "abstain_reason")
