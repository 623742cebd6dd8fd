"""Retrieval and faithfulness metrics, snapshots of them and sweeps over fusion weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataline.session import cut_lineage

#: Ranges of values that nearest_rank counts by.
RANGES = 64
# Names of metrics as snapshots have them.
#: Metrics where more is better; for all others less is.
HIGHER = ("recall@k", "mrr", "map@k", "citation_correctness", "abstention_recall", "mean_groundedness", "lexical_groundedness", "fully_grounded_rate")
TOLERANCE = 0.01


# Metrics over arrays: retrieved in rank order, relevant as a set.


def recall_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    gold = F.array_distinct(relevant)
    return F.when(F.size(gold) == 0, 0.0).otherwise(F.size(F.array_intersect(F.slice(retrieved, 1, k), gold)) / F.size(gold))


def precision_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    """Hits among the first k, repeats counted, over the number looked at."""
    head = F.slice(retrieved, 1, k)
    return F.when(F.size(head) == 0, 0.0).otherwise(F.size(F.filter(head, lambda x: F.array_contains(relevant, x))) / F.size(head))


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    first = F.array_position(F.transform(retrieved, lambda x: F.array_contains(relevant, x)), F.lit(True))
    return F.when(first > 0, 1 / first).otherwise(0.0)


def average_precision(retrieved: Column, relevant: Column, k: int) -> Column:
    gold = F.array_distinct(relevant)
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("hits"), F.lit(0.0).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        hit = F.array_contains(relevant, x)
        hits = acc["hits"] + F.when(hit, 1).otherwise(0)
        return F.struct((acc["i"] + 1).alias("i"), hits.alias("hits"), (acc["sum"] + F.when(hit, hits / (acc["i"] + 1)).otherwise(0.0)).alias("sum"))

    total = F.aggregate(F.slice(retrieved, 1, k), zero, step)["sum"]
    return F.when(F.size(gold) == 0, 0.0).otherwise(total / F.least(F.size(gold), F.lit(k)))


def token_recall(text: Column, passage: Column) -> Column:
    """Share of the distinct white-space words of the passage that the text has, in lower case."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    p = words(passage)
    return F.when(F.size(p) == 0, 0.0).otherwise(F.size(F.array_intersect(p, words(text))) / F.size(p))


def passage_hit(text: Column, passages: Column, threshold: float = 0.5) -> Column:
    return F.exists(passages, lambda p: token_recall(text, p) >= threshold)


def distinct_in_rank_order(hits: DataFrame, value: str, by: str = "query_id") -> DataFrame:
    """(by, values): the distinct values of the hits, each at its best rank."""
    first = hits.groupBy(by, value).agg(F.min("rank").alias("r"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", value))), lambda x: x[value]).alias("values"))


def relevance(cases: DataFrame, hits: DataFrame, chunks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """cases with values (what was retrieved, in rank order) and gold (what is relevant).

    A case with relevant_passages is judged by chunk: those retrieved that hold at least `threshold` of the words of a
    passage are relevant. The others are judged by item number, each at its best rank, against relevant_items.
    cases: query_id, relevant_items, relevant_passages; hits: query_id, chunk_id, rank; chunks: chunk_id, item_number, text.
    """
    none = F.array().cast("array<string>")
    c = cases.withColumns({"relevant_items": F.coalesce("relevant_items", none), "relevant_passages": F.coalesce("relevant_passages", none)})
    by_passage = F.size("relevant_passages") > 0
    h = hits.select("query_id", "chunk_id", "rank").join(chunks.select("chunk_id", "item_number", "text"), "chunk_id").join(c.select("query_id", "relevant_passages"), "query_id")
    h = h.select("query_id", F.when(by_passage, F.col("chunk_id")).otherwise(F.col("item_number")).alias("value"), "rank", F.when(by_passage, passage_hit(F.col("text"), F.col("relevant_passages"), threshold)).otherwise(False).alias("hit"))
    each = h.groupBy("query_id", "value").agg(F.min("rank").alias("r"), F.max("hit").alias("hit"))
    lists = F.array_sort(F.collect_list(F.struct("r", "value", "hit")))
    g = each.groupBy("query_id").agg(lists.alias("l")).select("query_id", F.transform("l", lambda x: x["value"]).alias("values"), F.transform(F.filter("l", lambda x: x["hit"]), lambda x: x["value"]).alias("_hits"))
    j = c.join(g, "query_id", "left")
    return j.withColumns({"values": F.coalesce("values", none), "gold": F.when(by_passage, F.coalesce("_hits", none)).otherwise(F.array_distinct("relevant_items"))}).drop("_hits")


def relevant_chunks(cases: DataFrame, candidates: DataFrame, chunks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(query_id, chunk_id) of the candidates that hold a relevant passage, or are of a relevant item where a case names no passages."""
    none = F.array().cast("array<string>")
    items, passages = F.coalesce("relevant_items", none), F.coalesce("relevant_passages", none)
    j = candidates.select("query_id", "chunk_id").join(chunks.select("chunk_id", "item_number", "text"), "chunk_id").join(cases, "query_id")
    return j.filter(F.when(F.size(passages) > 0, passage_hit(F.col("text"), passages, threshold)).otherwise(F.array_contains(items, F.col("item_number")))).select("query_id", "chunk_id")


def case_rows(cases: DataFrame, hits: DataFrame, chunks: DataFrame, answers: DataFrame, context: DataFrame, k: int = 8, judge=None) -> DataFrame:
    """query_id, answerable, abstained, recall, rr, ap, citations_ok, groundedness, contradicted of each case.

    cases: query_id, relevant_items, relevant_passages, answerable; answers: as of generation.answer. Claims are judged
    against the context with their quotes and figures checked; abstained answers have none and groundedness 0.
    """
    from strataline.operators import generation, verification

    r = relevance(cases, hits, chunks)
    text = F.when(~F.col("abstained"), F.col("answer")).otherwise("")
    evidence = context.select(F.col("query_id").alias("answer_id"), "n", "chunk_id", "text")
    told = verification.report(verification.checked((judge or verification.judge)(answers.select(F.col("query_id").alias("answer_id"), text.alias("text")), evidence)))
    cited = generation.citations(answers, context).join(chunks.select("chunk_id", "item_number"), "chunk_id").groupBy("query_id").agg(F.collect_list("chunk_id").alias("chunks_cited"), F.collect_list("item_number").alias("items_cited"))
    j = r.join(answers.select("query_id", "abstained"), "query_id").join(cited, "query_id", "left").join(told.select(F.col("answer_id").alias("query_id"), "groundedness", "contradicted"), "query_id", "left")
    none = F.array().cast("array<string>")
    keys = F.coalesce(F.when(F.size("relevant_passages") > 0, F.col("chunks_cited")).otherwise(F.col("items_cited")), none)
    v, g = F.col("values"), F.col("gold")
    return j.select(
        "query_id", F.coalesce("answerable", F.lit(True)).alias("answerable"), "abstained", recall_at_k(v, g, k).alias("recall"), reciprocal_rank(v, g).alias("rr"), average_precision(v, g, k).alias("ap"),
        citation_correctness(keys, g).alias("citations_ok"), F.coalesce("groundedness", F.lit(0.0)).alias("groundedness"), F.coalesce("contradicted", F.lit(0)).alias("contradicted"),
    )


def citation_correctness(cited: Column, gold: Column) -> Column:
    """Share of the citations, repeats counted, that are relevant; 0 without citations."""
    return F.when(F.size(cited) == 0, 0.0).otherwise(F.size(F.filter(cited, lambda x: F.array_contains(gold, x))) / F.size(cited))


def nearest_rank(df: DataFrame, value: str, percent: float, *by: str) -> DataFrame:
    """(*by, value): the element at round(percent / 100 * (n - 1)), halves to even; no interpolation. Nulls are left out.

    Equal values are counted before anything is shuffled and only the counts are ordered. Values are cut into ranges
    whose counts tell in which range the element of each group lies, so each task orders a part of one range at most.
    """
    known = df.filter(F.col(value).isNotNull())
    counts = known.groupBy(*by, value).agg(F.count("*").alias("n"))
    bounds = known.select(F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], RANGES * 20).alias("b")).first()
    edges = sorted(set(bounds.b)) if bounds and bounds.b else []  # RANGES values at most
    part = F.lit(0)
    for e in edges:
        part = part + F.when(F.col(value) > e, 1).otherwise(0)
    placed = cut_lineage(counts.withColumn("_part", part))
    keys = list(by)
    sums = placed.groupBy(*keys, "_part").agg(F.sum("n").alias("s"))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sums = sums.withColumns({"before": F.sum("s").over(over.orderBy("_part")) - F.col("s"), "total": F.sum("s").over(over)})  # RANGES rows a group
    sums = sums.withColumn("at", F.bround(F.lit(percent / 100) * (F.col("total") - 1), 0).cast("long"))
    home = sums.filter((F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("s"))).select(*keys, "_part", "before", "at")
    inside = placed.join(F.broadcast(home) if not keys else home, [*keys, "_part"])
    w = Window.partitionBy(*keys, "_part").orderBy(value)
    run = inside.withColumn("upto", F.sum("n").over(w) + F.col("before"))
    return run.filter((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n"))).select(*by, value)


def roll_up(cases: DataFrame, lexical: bool = True) -> DataFrame:
    """One row of metrics over cases: query_id, recall, rr, ap, answerable, abstained, citations_ok, groundedness, contradicted, and latency_ms if there.

    An answer hallucinates if it is given to an unanswerable case, or cites nothing relevant. Groundedness is averaged
    over answers to answerable cases; a lexical judge sees no contradictions, so their rate is left out for it.
    """
    answered = ~F.col("abstained")
    told = F.col("answerable") & answered
    lies = answered & (~F.col("answerable") | (F.col("citations_ok") == 0))
    mean = lambda c, name: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(name)
    out = [
        F.count("*").alias("n_cases"), mean("recall", "recall_at_k"), mean("rr", "mrr"), mean("ap", "map_at_k"), mean(F.when(F.col("answerable"), F.col("citations_ok")), "citation_correctness"),
        mean(lies.cast("int"), "hallucination_rate"), F.round(F.avg(F.when(~F.col("answerable"), F.col("abstained").cast("int"))), 6).alias("abstention_recall"),
        mean(F.when(told, F.col("groundedness")), "lexical_groundedness" if lexical else "mean_groundedness"), mean(F.when(told, (F.col("groundedness") >= 1).cast("int")), "fully_grounded_rate"),
    ]
    if not lexical:
        out.append(mean(F.when(told, (F.col("contradicted") > 0).cast("int")), "contradiction_rate"))
    if "latency_ms" in cases.columns:
        out += [mean("latency_ms", "mean_latency_ms"), F.max("_p95").alias("p95_latency_ms")]
        cases = cases.crossJoin(F.broadcast(nearest_rank(cases, "latency_ms", 95).select(F.col("latency_ms").alias("_p95"))))  # one row
    return cases.agg(*out)


def as_metrics(rolled: DataFrame) -> DataFrame:
    """(metric, value), one row for each metric of a roll-up, by the names that snapshots use."""
    names = {"recall_at_k": "recall@k", "map_at_k": "map@k"}
    pairs = [F.struct(F.lit(names.get(c, c)).alias("metric"), F.col(c).cast("double").alias("value")) for c in rolled.columns if c != "n_cases"]
    return rolled.select(F.explode(F.array(*pairs)).alias("m")).select("m.*").filter("value IS NOT NULL")


def snapshot_diff(current: DataFrame, baseline: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(metric, current, baseline, delta, status): ok, regression, added or removed for each metric of either side."""
    j = current.select("metric", F.col("value").alias("current")).join(baseline.select("metric", F.col("value").alias("baseline")), "metric", "full")
    d = j.withColumn("delta", F.round(F.col("current") - F.col("baseline"), 6))
    worse = F.when(F.col("metric").isin(*HIGHER), F.col("delta") < -tolerance).otherwise(F.col("delta") > tolerance)
    return d.withColumn("status", F.when(F.col("baseline").isNull(), "added").when(F.col("current").isNull(), "removed").when(worse, "regression").otherwise("ok"))


def weight_sweep(dense: DataFrame, lexical: DataFrame, gold: DataFrame, step: float = 0.1, k: int = 8, key: str = "chunk_id") -> DataFrame:
    """(lexical_weight, recall, mrr, best) for lexical weights 0, step, ... 1 of the weighted fusion.

    Candidates are scored once; only the weighted sum and the ranking repeat. gold: query_id, key. The best is the
    largest recall + mrr, the least weight of equal ones.
    """
    from strataline.operators.retrieval import min_max

    n = round(1 / step)
    grid = F.explode(F.array(*[F.lit(i / n) for i in range(n + 1)]))
    d = min_max(dense).select("query_id", key, F.col("score").alias("d"))
    b = min_max(lexical).select("query_id", key, F.col("score").alias("b"))
    both = d.join(b, ["query_id", key], "full").na.fill(0.0, ["d", "b"]).withColumn("lexical_weight", grid)
    scored = both.withColumn("score", F.round(F.col("lexical_weight") * F.col("b") + (1 - F.col("lexical_weight")) * F.col("d"), 6))
    w = Window.partitionBy("lexical_weight", "query_id").orderBy(F.col("score").desc(), key)
    head = scored.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    hits = head.join(gold.select("query_id", key).distinct(), ["query_id", key], "left_semi").groupBy("lexical_weight", "query_id").agg(F.count("*").alias("hits"), F.min("r").alias("first"))
    size = gold.select("query_id", key).distinct().groupBy("query_id").agg(F.count("*").alias("size"))
    per = size.withColumn("lexical_weight", grid).join(hits, ["lexical_weight", "query_id"], "left")
    m = per.groupBy("lexical_weight").agg(F.round(F.avg(F.coalesce(F.col("hits") / F.col("size"), F.lit(0.0))), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
    order = Window.partitionBy().orderBy((F.col("recall") + F.col("mrr")).desc(), "lexical_weight")
    return m.withColumn("best", F.row_number().over(order) == 1)


def enforcement(cases: DataFrame, signals: DataFrame, items: DataFrame) -> DataFrame:
    """(case_id, signal_recall, evidence_recall): expected signals found in the chunks of the case's ticker, and expected items retrieved.

    cases: case_id, ticker, expected_signals, expected_items; signals: ticker, signal_type; items: case_id, item_number of
    what was retrieved for the case. A case without ticker looks at all chunks; tickers match without regard to case.
    """
    none = F.array().cast("array<string>")
    kinds = signals.select(F.upper("ticker").alias("_ticker"), "signal_type").distinct()
    each = kinds.groupBy("_ticker").agg(F.collect_set("signal_type").alias("s"))
    whole = F.broadcast(kinds.agg(F.collect_set("signal_type").alias("all_s")))  # one row
    i = items.groupBy("case_id").agg(F.collect_set("item_number").alias("i"))
    c = cases.withColumn("_ticker", F.upper(F.nullif(F.col("ticker"), F.lit(""))))
    j = c.join(each, "_ticker", "left").crossJoin(whole).join(i, "case_id", "left")
    got = F.when(F.col("_ticker").isNull(), F.col("all_s")).otherwise(F.col("s"))
    share = lambda got, want: F.when(F.size(F.array_distinct(F.coalesce(F.col(want), none))) == 0, 0.0).otherwise(F.size(F.array_intersect(F.coalesce(got, none), F.array_distinct(F.col(want)))) / F.size(F.array_distinct(F.col(want))))
    return j.select("case_id", F.round(share(got, "expected_signals"), 6).alias("signal_recall"), F.round(share(F.col("i"), "expected_items"), 6).alias("evidence_recall"))


def enforcement_means(results: DataFrame) -> DataFrame:
    """One row: the number of cases and the means of their recalls, 0 without cases."""
    mean = lambda c, name: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(name)
    return results.agg(F.count("*").alias("n_cases"), mean("signal_recall", "signal_recall"), mean("evidence_recall", "evidence_retrieval_recall"))
