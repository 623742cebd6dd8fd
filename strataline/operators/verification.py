"""Claims of answers held against their evidence: lexical judge, quote and figure checks, groundedness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions import text as T

SUPPORT, PARTIAL = 0.6, 0.3
FLOOR = 0.6
#: Verdicts from best to worst.
RANK = ("SUPPORTED", "PARTIAL", "CONTRADICTED", "UNSUPPORTED")


def uncited(text: Column) -> Column:
    return F.regexp_replace(text, r"\[\d+\]", "")


def cited_numbers(text: Column, n: Column) -> Column:
    """Distinct numbers of `[n]` marks between 1 and n in order of appearance."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(found, lambda k: (k >= 1) & (k <= n)))


def claims(answers: DataFrame) -> DataFrame:
    """(answer_id, claim_no, claim, words): sentences of the answers with a keyword, citation marks aside."""
    s = answers.select("answer_id", F.posexplode(T.sentences(uncited(F.coalesce("text", F.lit(""))))).alias("claim_no", "claim"))
    return s.withColumn("words", T.keywords(F.col("claim"))).filter(F.size("words") > 0)


def judge(answers: DataFrame, evidence: DataFrame, support: float = SUPPORT, partial: float = PARTIAL) -> DataFrame:
    """(answer_id, claim_no, claim, verdict, citation, chunk_id, overlap, quote, evidence_text).

    answers: answer_id, text; evidence: answer_id, n, chunk_id, text. The evidence with the largest share of the
    keywords of a claim counts, the least n of equal ones. The quote is its sentence with the largest share of own
    keywords in the claim. Claims of answers without evidence are UNSUPPORTED.
    """
    e = evidence.select("answer_id", "n", "chunk_id", F.col("text").alias("evidence_text"), T.keywords(F.col("text")).alias("evidence_words"))
    j = claims(answers).join(e, "answer_id", "left")
    share = F.coalesce(F.size(F.array_intersect("words", "evidence_words")) / F.size("words"), F.lit(0.0))
    best = j.withColumn("overlap", share).groupBy("answer_id", "claim_no", "claim", "words").agg(F.max(F.struct("overlap", (-F.col("n")).alias("minus"), "chunk_id", "evidence_text")).alias("b"))
    verdict = F.when(F.col("b.overlap") >= support, "SUPPORTED").when(F.col("b.overlap") >= partial, "PARTIAL").otherwise("UNSUPPORTED")
    kept = F.col("verdict") != "UNSUPPORTED"

    def fit(s: Column) -> Column:
        own = T.keywords(s)
        return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, F.col("words"))) / F.size(own))

    scored = F.transform(T.sentences(F.coalesce("b.evidence_text", F.lit(""))), lambda s: F.struct(fit(s).alias("score"), s.alias("sentence")))
    first = F.aggregate(scored, F.struct(F.lit(0.0).alias("score"), F.lit("").alias("sentence")), lambda acc, x: F.when(x["score"] > acc["score"], x).otherwise(acc))
    return best.withColumn("verdict", verdict).select(
        "answer_id", "claim_no", "claim", "verdict", F.when(kept, -F.col("b.minus")).alias("citation"), F.when(kept, F.col("b.chunk_id")).alias("chunk_id"),
        F.round("b.overlap", 6).alias("overlap"), F.when(kept, first["sentence"]).otherwise("").alias("quote"), F.when(kept, F.col("b.evidence_text")).alias("evidence_text"),
    )


def checked(judged: DataFrame) -> DataFrame:
    """judged with valid_quote, numeric_ok and the verdict after them: a claim with a made-up quote or a wrong figure isn't supported."""
    valid = T.contains_quote(F.col("evidence_text"), F.col("quote"))
    numeric = T.figures_supported(F.col("claim"), F.coalesce("evidence_text", F.lit("")))
    out = judged.withColumns({"valid_quote": valid, "numeric_ok": numeric})
    fails = F.col("verdict").isin("SUPPORTED", "PARTIAL") & F.col("citation").isNotNull() & (~F.col("valid_quote") | ~F.col("numeric_ok"))
    return out.withColumn("verdict", F.when(fails, "UNSUPPORTED").otherwise(F.col("verdict")))


def report(judged: DataFrame) -> DataFrame:
    """(answer_id, total, supported, contradicted, groundedness): PARTIAL counts half."""
    is_ = lambda v: (F.col("verdict") == v).cast("int")
    g = judged.groupBy("answer_id").agg(F.count("*").alias("total"), F.sum(is_("SUPPORTED")).alias("supported"), F.sum(is_("CONTRADICTED")).alias("contradicted"), F.sum(is_("PARTIAL")).alias("p"))
    return g.select("answer_id", "total", "supported", "contradicted", F.round((F.col("supported") + 0.5 * F.col("p")) / F.col("total"), 6).alias("groundedness"))


def fails_gate(floor: float = FLOOR, on_contradiction: bool = True) -> Column:
    low = F.col("groundedness") < floor
    return (low | (F.col("contradicted") > 0)) if on_contradiction else low


def best_verdicts(judged: DataFrame) -> DataFrame:
    """(answer_id, chunk_id, verdict, quote): the best verdict on each cited chunk, the first claim of equal ones."""
    rank = F.coalesce(*[F.when(F.col("verdict") == v, F.lit(k)) for k, v in enumerate(RANK)], F.lit(len(RANK)))
    c = judged.filter("chunk_id IS NOT NULL").withColumn("r", rank)
    return c.groupBy("answer_id", "chunk_id").agg(F.min(F.struct("r", "claim_no", "verdict", "quote")).alias("b")).select("answer_id", "chunk_id", "b.verdict", "b.quote")


def parsed_claims(replies: DataFrame, n_evidence: Column) -> DataFrame:
    """Claims read from the JSON reply of a model judge: what stands between the first { and the last }.

    replies: answer_id, reply. Unknown verdicts become UNSUPPORTED, citations out of range null; a reply that can't be
    read gives no claims.
    """
    body = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    schema = "claims array<struct<claim: string, verdict: string, citation: string, quote: string>>"
    c = replies.select("answer_id", n_evidence.alias("n"), F.posexplode(F.from_json(body, schema)["claims"]).alias("claim_no", "c"))
    number = F.expr("try_cast(c.citation AS int)")
    return c.select(
        "answer_id", "claim_no", "c.claim", F.when(F.upper("c.verdict").isin(*RANK), F.upper("c.verdict")).otherwise("UNSUPPORTED").alias("verdict"),
        F.when((number >= 1) & (number <= F.col("n")), number).alias("citation"), F.coalesce("c.quote", F.lit("")).alias("quote"),
    )


def model_judge(replies):
    """A judge, for Pipeline's JUDGES, of a model that replies with JSON.

    replies maps (answers, evidence), as of judge(), to (answer_id, reply). Claims are read by parsed_claims() and get
    the text of the evidence that they cite; overlap is null, as the model tells none.
    """

    def run(answers: DataFrame, evidence: DataFrame) -> DataFrame:
        size = evidence.groupBy("answer_id").agg(F.max("n").alias("most"))
        told = replies(answers, evidence).select("answer_id", "reply").join(size, "answer_id", "left")
        c = parsed_claims(told, F.coalesce("most", F.lit(0)))
        e = evidence.select("answer_id", F.col("n").cast("int").alias("citation"), "chunk_id", F.col("text").alias("evidence_text"))
        kept = F.col("verdict") != "UNSUPPORTED"
        j = c.withColumn("citation", F.when(kept, F.col("citation").cast("int"))).join(e, ["answer_id", "citation"], "left")
        return j.select("answer_id", "claim_no", "claim", "verdict", "citation", "chunk_id", F.lit(None).cast("double").alias("overlap"), "quote", "evidence_text")

    return run


def independent(judge_model: str, generator_model: str) -> None:
    """A judge must be another model than the one that wrote the answer."""
    if judge_model == generator_model:
        raise ValueError("the judge must not be the model that it judges")
