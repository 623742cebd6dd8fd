"""Text primitives as column expressions; everything stays in the JVM.

Nulls give nulls (or empty arrays where said), and empty texts empty arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no keywords.
STOP_WORDS = (
    "the a an and or of to in for on with is are was were be by as at that this from it its we our their have has had which these those what how did does do than into about also"
).split()
# Units of figures and what they multiply by; the percent class isn't rescaled.
SCALES = {"thousand": 1e3, "million": 1e6, "mm": 1e6, "mn": 1e6, "billion": 1e9, "bn": 1e9, "trillion": 1e12}
PERCENT = ("%", "percent", "percentage point", "percentage points", "basis point", "basis points", "bps")
FIGURE = r"(?i)\$?\s?(\d[\d,]*(?:\.\d+)?)\s*(%|percentage points?|percent|basis points?|bps|trillion|billion|million|thousand|bn|mm|mn)?"


def tokens(text: Column, pattern: str = "[a-z0-9]+") -> Column:
    """Runs of ASCII letters and digits of the lower-cased text, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def unicode_tokens(text: Column) -> Column:
    """Runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def keywords(text: Column) -> Column:
    """Distinct tokens over two letters long that are no stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_except(F.filter(tokens(text), lambda w: F.length(w) > 2), stop)


def sentences(text: Column) -> Column:
    parts = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def collapse(text: Column) -> Column:
    """Runs of white space, also beyond ASCII, as one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalise(text: Column) -> Column:
    """Line feeds only, one space for a run of spaces and tabs, at most one blank line, nothing at the ends."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: 1 where both are empty, 0 where one is."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def figures(text: Column) -> Column:
    """array<struct<value: double, is_percent: boolean>> of the numbers of a text, scale words applied."""
    raw = F.regexp_extract_all(text, F.lit(FIGURE), F.lit(1))
    unit = F.transform(F.regexp_extract_all(text, F.lit(FIGURE), F.lit(2)), F.lower)
    scale = F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])

    def one(p: Column) -> Column:
        value = F.regexp_replace(p["n"], ",", "").try_cast("double")
        percent = p["u"].isin(*PERCENT)
        return F.struct(F.when(percent, value).otherwise(value * F.coalesce(F.try_element_at(scale, p["u"]), F.lit(1.0))).alias("value"), percent.alias("is_percent"))

    return F.transform(F.arrays_zip(raw.alias("n"), unit.alias("u")), one)


def _close(a: Column, b: Column, tolerance: float) -> Column:
    return F.when((a == 0) | (b == 0), a == b).otherwise(F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b)))


def figures_supported(claim: Column, evidence: Column, tolerance: float = 0.005) -> Column:
    """Whether each figure of the claim stands in the evidence; percent only with percent, others in any scale of thousands."""

    def meets(c: Column, e: Column) -> Column:
        near = _close(c["value"], e["value"], tolerance)
        for s in (1e3, 1e6, 1e9):
            near = near | (~c["is_percent"] & (_close(c["value"], e["value"] * s, tolerance) | _close(c["value"] * s, e["value"], tolerance)))
        return (c["is_percent"] == e["is_percent"]) & near

    return F.forall(figures(claim), lambda c: F.exists(figures(evidence), lambda e: meets(c, e)))


def contains_quote(text: Column, quote: Column) -> Column:
    """Whether the quote stands in the text, white space aside; an empty or null quote doesn't."""
    q = collapse(F.coalesce(quote, F.lit("")))
    return F.when(q == "", False).otherwise(F.contains(collapse(F.coalesce(text, F.lit(""))), q))


def first_truthy(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])
