"""Test passages inside a training corpus, found with a generalised suffix automaton of the passages.

The automaton is small (twice the test words) and goes to every task; the corpus is streamed through it once, without a
shuffle. After each word the length of the longest passage fragment that ends there is known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
#: Words of test passages per automaton; a larger test set is scanned in blocks of at most this many.
BLOCK_WORDS = 1_000_000


class SuffixAutomaton:
    """All fragments of a set of word sequences; items[s] are the sequences that hold the fragments of state s."""

    def __init__(self, sequences: list[list[str]], least: int):
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, set[int]] = {}
        for k, words in enumerate(sequences):
            last = 0
            for w in words:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                ends.setdefault(last, set()).add(k)
        self.items: list[frozenset[int] | None] = [None] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.length[s] < least:
                break
            mine = ends.get(s, set())
            self.items[s] = frozenset(mine)
            if (up := self.link[s]) > 0:
                ends.setdefault(up, set()).update(mine)

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the fragments no longer than those of p and one word."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def scan(self, words: list[str], least: int) -> tuple[set[int], list[tuple[int, int]]]:
        """Sequences that share `least` or more consecutive words, and the maximal shared runs as (first, past the last)."""
        get, following, link, length = self.vocabulary.get, self.next, self.link, self.length
        state = matched = 0
        hit: set[int] = set()
        runs: list[tuple[int, int]] = []
        for at, c in enumerate(map(get, words)):
            if c is None:
                state = matched = 0
                continue
            step = following[state].get(c)
            if step is None:
                while state and step is None:
                    state = link[state]
                    step = following[state].get(c)
                matched = length[state]
                if step is None:
                    continue
            state = step
            matched += 1
            if matched >= least:
                s = state
                while length[link[s]] >= least:
                    s = link[s]
                hit |= self.items[s]
                first = at + 1 - matched
                if runs and first <= runs[-1][1]:
                    runs[-1] = (min(first, runs[-1][0]), at + 1)
                else:
                    runs.append((first, at + 1))
        return hit, runs


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


_built: dict[int, SuffixAutomaton] = {}


def _automaton(shared, least: int) -> SuffixAutomaton:
    """Built once per worker process."""
    sequences = shared.value[0]
    key = hash((least, *map(tuple, sequences)))
    if key not in _built:
        _built.clear()
        _built[key] = SuffixAutomaton(sequences, least)
    return _built[key]


def scan(corpus: DataFrame, tests: DataFrame, least: int = 12, max_words: int = 50, max_coverage: float = 0.3) -> DataFrame:
    """Leaks of test passages into documents.

    corpus: doc_id, text; tests: case_id, passage; other columns are ignored. Null or blank texts and passages never
    match, a passage under `least` words neither; repeated documents each come out; equal passages are one sequence
    held by several cases. An empty table gives no rows.

    Returns doc_id, case_ids (sorted), longest (words of the longest run), coverage (share of the words in runs) and
    cleaned: the text without each run of max_words or more, and without all of them once they cover more than
    max_coverage. Only documents with a leak come out.
    """
    spark = corpus.sparkSession
    passages = tests.select(F.col("case_id").cast("string").alias("case_id"), "passage").dropna().distinct()
    total = passages.agg(F.sum(F.length("passage") - F.length(F.translate("passage", " ", "")) + 1)).first()[0] or 0
    blocks = -(-int(total) // BLOCK_WORDS)
    parts = []
    for b in range(blocks):
        by_text: dict[tuple[str, ...], set[str]] = {}
        for r in passages.filter(F.pmod(F.xxhash64("passage"), F.lit(blocks)) == b).toLocalIterator():
            if len(words := tuple(words_of(r.passage))) >= least:
                by_text.setdefault(words, set()).add(r.case_id)
        if not by_text:
            continue
        texts = sorted(by_text)
        shared = spark.sparkContext.broadcast(([list(t) for t in texts], [sorted(by_text[t]) for t in texts]))
        parts.append(corpus.select("doc_id", "text").dropna().mapInArrow(_scanner(shared, least), f"doc_id {corpus.schema['doc_id'].dataType.simpleString()}, case_ids array<string>, runs array<struct<lo: int, hi: int>>, n_words int, text string"))
    if not parts:
        return corpus.select("doc_id", F.array().cast("array<string>").alias("case_ids"), F.lit(0).alias("longest"), F.lit(0.0).alias("coverage"), F.col("text").cast("string").alias("cleaned")).limit(0)
    found = parts[0]
    if blocks > 1:
        for p in parts[1:]:
            found = found.unionByName(p)
        key = ["doc_id", "text", "n_words"]
        found = found.groupBy(*key).agg(F.flatten(F.collect_list("case_ids")).alias("case_ids"), F.flatten(F.collect_list("runs")).alias("runs"))
    schema = found.select("doc_id").schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(_cleaner(max_words, max_coverage), f"doc_id {schema}, case_ids array<string>, longest int, coverage double, cleaned string")


def _scanner(shared, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, cases = _automaton(shared, least), shared.value[1]
        for batch in batches:
            picked, ids, runs, n = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text)
                hit, found = automaton.scan(words, least)
                if hit:
                    picked.append(k)
                    ids.append(sorted({c for item in hit for c in cases[item]}))
                    runs.append([{"lo": lo, "hi": hi} for lo, hi in found])
                    n.append(len(words))
            kept = batch.take(pa.array(picked, pa.int64()))
            span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            yield pa.record_batch([kept.column(0), pa.array(ids, pa.list_(pa.string())), pa.array(runs, span), pa.array(n, pa.int32()), kept.column(1)], names=["doc_id", "case_ids", "runs", "n_words", "text"])

    return run


def _cleaner(max_words: int, max_coverage: float):
    def one(text: str, runs: list[dict], n: int):
        merged: list[list[int]] = []
        for lo, hi in sorted((r["lo"], r["hi"]) for r in runs):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(hi, merged[-1][1])
            else:
                merged.append([lo, hi])
        covered = sum(hi - lo for lo, hi in merged) / n
        gone = [m for m in merged if covered > max_coverage or m[1] - m[0] >= max_words]
        folded = text.casefold()
        at = [m.span() for m in _WORD.finditer(text if len(folded) != len(text) else folded)]
        out, start = [], 0
        for lo, hi in gone:
            if hi <= len(at):
                out.append(text[start : at[lo][0]])
                start = at[hi - 1][1]
        return max(hi - lo for lo, hi in merged), covered, "".join(out) + text[start:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(*x) for x in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), batch.column("n_words").to_pylist())]
            ids = [sorted(set(x)) for x in batch.column("case_ids").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.string())), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.string())],
                names=["doc_id", "case_ids", "longest", "coverage", "cleaned"],
            )

    return run
