"""Year over year comparison of sections, unit by unit.

Units of year B take in order the best unit of year A that is still free. Only token sets reach Python: units of equal
tokens are one class, similarities come from the postings of the tokens within a section pair, and the choice in order
runs over places alone; the texts stay in the JVM.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import text as T
from strataline.operators.chunking import units

SAME, CHANGED = 0.65, 0.30
PLACES = "added array<int>, old array<int>, new array<int>, removed array<int>"


def section_texts(chunks: DataFrame, *by: str) -> DataFrame:
    """(*by, item_number, section_title, section_text): the chunks of a section in order, joined by blank lines. UNKNOWN and 0 are left out."""
    c = chunks.filter(~F.col("item_number").isin("UNKNOWN", "0"))
    parts = F.array_sort(F.collect_list(F.struct("char_start", "ord", "text", "section_title")))
    g = c.groupBy(*by, "item_number").agg(parts.alias("p"))
    return g.select(*by, "item_number", F.element_at("p", 1)["section_title"].alias("section_title"), F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("section_text"))


def align(a: list[set[str]], b: list[set[str]]) -> tuple[list[int], list[tuple[int, int]], list[int]]:
    """(added in b, (old, new) changed, removed from a), by index."""
    classes: dict[frozenset[str], list[int]] = {}
    for i, ta in enumerate(a):
        classes.setdefault(frozenset(ta), []).append(i)
    postings: dict[str, list[int]] = {}
    for k, ta in enumerate(classes):
        for t in ta:
            postings.setdefault(t, []).append(k)
    arrays = {t: np.array(ks) for t, ks in postings.items()}
    places, sizes = list(classes.values()), np.array([len(ta) for ta in classes], int)
    used, taken = len(a), np.zeros(len(places), int)
    head = np.array([p[0] for p in places], int)  # the least free place of a class, used when there is none
    near: dict[frozenset[str], tuple[np.ndarray, np.ndarray]] = {}
    added, changed = [], []
    for j, tb in enumerate(map(frozenset, b)):
        if tb not in near:
            hits = [arrays[t] for t in tb if t in arrays]
            both = np.bincount(np.concatenate(hits), minlength=len(places)) if hits else np.zeros(len(places), int)
            union = sizes + len(tb) - both
            s = np.where(union > 0, both / np.maximum(union, 1), 1.0)
            near[tb] = (ks := np.flatnonzero(s >= CHANGED)), s[ks]
        ks, s = near[tb]
        free = head[ks] < used
        if not free.any():
            added.append(j)
            continue
        ks, s = ks[free], s[free]
        score = s.max()
        best = ks[s == score]
        k = best[head[best].argmin()]
        if score < SAME:
            changed.append((int(head[k]), j))
        taken[k] += 1
        head[k] = places[k][taken[k]] if taken[k] < len(places[k]) else used
    return added, changed, sorted(i for k, p in enumerate(places) for i in p[taken[k] :])


def _places(tokens_a: pd.Series, tokens_b: pd.Series) -> pd.DataFrame:
    out = []
    for a, b in zip(tokens_a, tokens_b):
        added, changed, removed = align([set(x) for x in a], [set(x) for x in b])
        out.append((added, [i for i, _ in changed], [j for _, j in changed], removed))
    return pd.DataFrame(out, columns=["added", "old", "new", "removed"])


def compare_years(chunks: DataFrame, year_a: str | None = None, year_b: str | None = None, forms: list[str] | None = None, one_filing: bool = False) -> DataFrame:
    """Section differences of every ticker between two fiscal years; by default its first and its last in the table.

    Returns ticker, item_number, section_title, label_a, label_b, similarity, added, removed, changed. A section that
    only one year has is compared with an empty text. Tickers match without regard to case.
    The chunks of all filings of a year make up its sections; with one_filing only those of its latest filing.
    """
    c = chunks.withColumn("ticker", F.upper("ticker"))
    if forms:
        c = c.filter(F.col("filing_type").isin(*forms))
    if year_a is None or year_b is None:
        ends = c.filter("fiscal_year RLIKE '^[0-9]{4}$'").groupBy("ticker").agg(F.min("fiscal_year").alias("ya"), F.max("fiscal_year").alias("yb")).filter("ya < yb")
        c = c.join(ends, "ticker")
    else:
        c = c.withColumns({"ya": F.lit(str(year_a)), "yb": F.lit(str(year_b))})
    one = c.filter((F.col("fiscal_year") == F.col("ya")) | (F.col("fiscal_year") == F.col("yb")))
    if one_filing:
        latest = one.groupBy("ticker", "fiscal_year").agg(F.max(F.struct("filing_date", "accession")).alias("f"))
        one = one.join(latest.select("ticker", "fiscal_year", F.col("f.accession").alias("accession")), ["ticker", "fiscal_year", "accession"], "left_semi")
    s = section_texts(one.withColumn("is_b", F.col("fiscal_year") == F.col("yb")), "ticker", "ya", "yb", "is_b")
    key = ["ticker", "ya", "yb", "item_number"]
    a = s.filter("NOT is_b").select(*key, F.col("section_text").alias("text_a"), F.col("section_title").alias("title_a"))
    b = s.filter("is_b").select(*key, F.col("section_text").alias("text_b"), F.col("section_title").alias("title_b"))
    j = a.join(b, key, "full").withColumns({"text_a": F.coalesce("text_a", F.lit("")), "text_b": F.coalesce("text_b", F.lit(""))})
    j = j.withColumns({"units_a": units(F.col("text_a")), "units_b": units(F.col("text_b"))})
    each = lambda c: F.transform(c, T.token_set)
    ready = j.withColumns({"tokens_a": each(F.col("units_a")), "tokens_b": each(F.col("units_b")), "similarity": F.round(T.jaccard(T.token_set(F.col("text_a")), T.token_set(F.col("text_b"))), 6)})
    done = ready.withColumn("d", F.pandas_udf(_places, PLACES)("tokens_a", "tokens_b"))
    at = lambda units, i: F.element_at(units, i + 1)
    pick = lambda units, places: F.transform(places, lambda i: at(F.col(units), i))
    changed = F.transform(F.arrays_zip(F.col("d.old").alias("old"), F.col("d.new").alias("new")), lambda p: F.struct(at(F.col("units_a"), p["old"]).alias("old_text"), at(F.col("units_b"), p["new"]).alias("new_text")))
    title = F.coalesce("title_b", F.concat(F.lit("Item "), "item_number")).alias("section_title")
    return done.select("ticker", "item_number", title, F.col("ya").alias("label_a"), F.col("yb").alias("label_b"), "similarity", pick("units_b", "d.added").alias("added"), pick("units_a", "d.removed").alias("removed"), changed.alias("changed"))


def summary(diffs: DataFrame, *by: str) -> DataFrame:
    """sections_compared, added, removed, changed: counts over the sections."""
    n = lambda c: F.coalesce(F.sum(F.size(F.coalesce(F.col(c), F.array().cast(diffs.schema[c].dataType)))), F.lit(0)).alias(c)
    return diffs.groupBy(*by).agg(F.count("*").alias("sections_compared"), n("added"), n("removed"), n("changed"))
