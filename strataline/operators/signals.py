"""Lexicon signals in chunks, and the monitor report over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions.text import collapse

# Phrases by signal, in order of severity and of preference.
LEXICON = {
    "going_concern": ["going concern", "substantial doubt", "ability to continue as a going concern"],
    "liquidity": [
        "insufficient liquidity", "liquidity constraints", "may not have sufficient", "default on our", "covenant", "breach of covenant", "additional financing", "negative working capital", "constrain future liquidity",
    ],
    "material_weakness": ["material weakness", "significant deficiency", "were not effective", "was not effective", "remediation plan"],
    "litigation": ["class action", "lawsuit", "litigation", "investigation", "subpoena", "enforcement action", "alleging", "infringement"],
    "impairment": ["impairment", "goodwill impairment", "write-down", "write down"],
    "restatement": ["restate", "restatement", "material misstatement"],
}


def snippet(text: Column, phrase: Column, width: int = 160) -> Column:
    """The surroundings of the first place of a phrase, white space collapsed."""
    at = F.locate(phrase, F.lower(text)) if isinstance(phrase, str) else F.instr(F.lower(text), phrase)
    start = F.greatest(F.lit(1), at - width // 2)
    end = at + F.length(phrase) + width // 2
    return F.when(at == 0, F.substring(collapse(text), 1, width)).otherwise(collapse(F.substring(text, start, end - start)))


def detect(chunks: DataFrame, lexicon: dict[str, list[str]] | None = None, key: str = "chunk_id") -> DataFrame:
    """(key, signal_type, phrase, snippet): for each chunk and signal the first phrase of the lexicon that it holds.

    Phrases are looked for as substrings without regard to case, the lexicon once a chunk; null texts hold none.
    """
    lexicon = LEXICON if lexicon is None else lexicon
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    found = [F.struct(F.lit(kind).alias("signal_type"), F.coalesce(*[F.when(F.contains(text, F.lit(p)), p) for p in phrases]).alias("phrase")) for kind, phrases in lexicon.items() if phrases]
    hits = chunks.select(key, "text", F.explode(F.filter(F.array(*found), lambda s: s["phrase"].isNotNull())).alias("s"))
    return hits.select(key, "s.signal_type", "s.phrase", snippet(F.col("text"), F.col("s.phrase")).alias("snippet"))


def by_type(signals: DataFrame, *by: str) -> DataFrame:
    """(*by, signal_type, n, phrases): the number of hits of each signal, and its phrases in order, separated by "; "."""
    g = signals.groupBy(*by, "signal_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("phrase")).alias("p"))  # phrases of the lexicon
    return g.select(*by, "signal_type", "n", F.array_join("p", "; ").alias("phrases"))


def monitor(diffs: DataFrame, signals: DataFrame, by: str = "ticker") -> DataFrame:
    """One row per ticker: new and removed risk factors, new litigation, signals, and whether going concern is among them.

    diffs: the section differences; signals: by, signal_type. Tickers of either table come out.
    """
    n = lambda c, item: F.coalesce(F.sum(F.when(F.col("item_number") == item, F.size(c))), F.lit(0))
    d = diffs.groupBy(by).agg(n("added", "1A").alias("new_risk_factors"), n("removed", "1A").alias("removed_risk_factors"), n("changed", "1A").alias("changed_risk_factors"), n("added", "3").alias("new_litigation"))
    s = signals.groupBy(by).agg(F.count("*").alias("signals"), F.max(F.col("signal_type") == "going_concern").alias("going_concern"))
    zero = {c: 0 for c in ("new_risk_factors", "removed_risk_factors", "changed_risk_factors", "new_litigation", "signals")}
    return d.join(s, by, "full").na.fill(zero).withColumn("going_concern", F.coalesce("going_concern", F.lit(False)))
