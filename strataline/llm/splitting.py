"""Oversized texts cut at natural boundaries: atoms joined bottom-up, weakest boundary first."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators.repeats import one_per_key

_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_SPACE = re.compile(r"\s+")
LEVELS = ("paragraph", "sentence", "word", "none")
_STRENGTH = {"paragraph": 3, "sentence": 2, "word": 1, "none": 0}


def _cut(text: str, spans: list[tuple[int, int, str]], at: re.Pattern, level: str, limit: int | None) -> list[tuple[int, int, str]]:
    """Each span over the limit (each at all if there is none) cut where the pattern matches; a span names the level of the boundary before it."""
    out = []
    for lo, hi, before in spans:
        if limit is not None and hi - lo <= limit:
            out.append((lo, hi, before))
            continue
        start = lo
        for m in at.finditer(text, lo, hi):
            if m.start() > start:
                out.append((start, m.start(), before))
                before = level
            start = m.end()
        if start < hi:
            out.append((start, hi, before))
    return out


def atoms(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, str]], str]:
    """Smallest segments worth keeping whole, and the level down to which the text has to be cut to fit the limit."""
    spans = _cut(text, [(0, len(text), "paragraph")], _BLANK, "paragraph", None)
    fits = lambda: all(hi - lo <= limit for lo, hi, _ in spans)
    level = "paragraph" if fits() else ""
    spans = _cut(text, spans, _SENTENCE, "sentence", limit if level else None)
    level = level or ("sentence" if fits() else "")
    if not level:
        spans = _cut(text, spans, _SPACE, "word", limit)
        level = "word" if fits() else "none"
    if level == "none":
        step = max(1, limit - overlap)
        spans = [(k, min(k + step, hi), before if k == lo else "none") for lo, hi, before in spans for k in (range(lo, hi, step) if hi - lo > limit else (lo,))]
    return spans, level


def pieces(text: str, limit: int = 1800, overlap: int = 200) -> tuple[list[tuple[int, int, int]], str]:
    """(start, own start, end) of each piece, and the cut level. A piece repeats text[start:own start] of the one before."""
    spans, level = atoms(text, limit, overlap)
    if len(text) <= limit or not spans:
        return [(0, 0, len(text))] if text else [], level
    left, right = list(range(-1, len(spans) - 1)), [*range(1, len(spans)), -1]
    lo, hi = [s[0] for s in spans], [s[1] for s in spans]
    alive, version = [True] * len(spans), [0] * len(spans)
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(a: int) -> None:
        b = right[a]
        if b >= 0 and (size := hi[b] - lo[a]) + (overlap if left[a] >= 0 else 0) <= limit:
            heapq.heappush(heap, (_STRENGTH[spans[b][2]], size, a, version[a], version[b]))

    for k in range(len(spans)):
        offer(k)
    while heap:
        _, _, a, va, vb = heapq.heappop(heap)
        b = right[a]
        if not alive[a] or b < 0 or version[a] != va or version[b] != vb:
            continue
        hi[a], right[a], alive[b] = hi[b], right[b], False
        version[a] += 1
        if right[b] >= 0:
            left[right[b]] = a
        offer(a)
        if left[a] >= 0:
            offer(left[a])
    out: list[tuple[int, int, int]] = []
    for k in range(len(spans)):
        if not alive[k]:
            continue
        own, end = (0 if not out else out[-1][2]), (hi[k] if right[k] >= 0 else len(text))
        if end - own > limit:  # white space at a boundary belongs to neither side where it doesn't fit
            own = lo[k]
            end = min(end, own + limit)
        start = own
        if out and (room := min(overlap, limit - (end - own))) > 0:
            earliest = max(out[-1][1], out[-1][2] - room, own - room)
            m = _SPACE.search(text, max(earliest - 1, 0), out[-1][2])
            start = m.end() if m and m.end() < out[-1][2] else earliest
        out.append((start, own, end))
    return out, level


def split(df: DataFrame, key: str = "chunk_id", text: str = "text", start: str = "char_start", limit: int = 1800, overlap: int = 200) -> DataFrame:
    """Pieces of at most `limit` code points of every row whose text is longer.

    Each piece repeats up to `overlap` characters of the one before, starting at a word where there is one. Boundaries
    are, from strong to weak: blank lines, white space after `.`, `!` or `?`, other white space, none. Where the start
    column is null the offsets of the pieces are null. Null texts and texts that fit give no rows; equal rows give equal
    pieces; an empty table gives none.

    Returns key, cut_level, piece (from 0), piece_text, char_start, char_end.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t, s in zip(*(batch.column(c).to_pylist() for c in range(3))):
                found, level = pieces(t, limit, overlap)
                rows += [(k, level, n, t[a:c], None if s is None else s + a, None if s is None else s + c) for n, (a, _, c) in enumerate(found)]
            cols = list(zip(*rows)) or [()] * 6
            types = (batch.schema.types[0], pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=[key, "cut_level", "piece", "piece_text", "char_start", "char_end"])

    kind = df.schema[key].dataType.simpleString()
    long = df.filter(F.length(text) > limit).select(F.col(key).alias(key), F.col(text).alias("t"), F.col(start).cast("int").alias("s"))
    return long.mapInArrow(run, f"`{key}` {kind}, cut_level string, piece int, piece_text string, char_start int, char_end int")


def right_offsets(chunks: DataFrame, filings: DataFrame) -> DataFrame:
    """chunks with char_start where the text really stands in its filing; null where it stands nowhere.

    The stored offset is kept if it holds, else the first place of the text is taken. Deliveries of a filing repeat its
    text, so any of them serves. Rows without a filing keep their offset if it isn't 0/0.
    """
    f = one_per_key(filings, "accession", "loaded_at", ["text"]) if "loaded_at" in filings.columns else filings.groupBy("accession").agg(F.max("text").alias("text"))
    f = f.select("accession", F.col("text").alias("filing_text"))
    j = chunks.join(f, "accession", "left")
    stored = F.when((F.col("char_end") > F.col("char_start")) & F.col("filing_text").isNull(), F.col("char_start"))
    holds = F.substring("filing_text", F.col("char_start") + 1, F.length("text")) == F.col("text")
    at = F.instr("filing_text", F.col("text")) - 1
    fixed = F.when(F.col("filing_text").isNull(), stored).when(holds, F.col("char_start")).when(at >= 0, at)
    return j.withColumn("char_start", fixed.cast("int")).drop("filing_text")
