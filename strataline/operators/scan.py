"""Best texts or vectors of each query by one scan: scores of an Arrow batch against a block of queries are a matrix
product, and each task keeps the k best of each query, so neither documents nor scores are shuffled.

Queries are broadcast in blocks of bounded size; a further block is a further scan. For few queries over a stored index,
`retrieval.bm25_scores` and `retrieval.sparse_scores` read the postings of the query words alone.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions import text as T
from strataline.operators.retrieval import K1, B, top

#: Queries of a block, and the words they may have together.
QUERIES, WORDS = 512, 8000
#: Values of a working matrix.
CELLS = 4_000_000
_TOKEN = re.compile("[a-z0-9]+")


def blocks_of(queries: DataFrame, size, columns: list[str]) -> list[list]:
    """The queries, as lists of rows, in blocks of at most QUERIES rows and about WORDS units of the size column."""
    q = queries.select(*columns, size.alias("_size"))
    n, total = q.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    blocks = max(1, -(-n // QUERIES), -(-int(total) // WORDS))
    out: list[list] = []
    for b in range(blocks):
        part = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else q
        if rows := part.collect():
            out.append(rows)
    return out


class Best:
    """The k best (score, key) of each query so far; ties go to the least key."""

    def __init__(self, queries: int, k: int):
        self.k, self.held = k, [[] for _ in range(queries)]

    def add(self, keys: list, scores: np.ndarray, allowed: np.ndarray | None) -> None:
        """scores, allowed: keys x queries."""
        order = np.argsort(np.array(keys, object), kind="stable") if len(keys) else np.zeros(0, int)
        scores = np.round(scores[order], 6)
        allowed = None if allowed is None else allowed[order]
        for q, held in enumerate(self.held):
            s = scores[:, q]
            if allowed is not None:
                own = np.flatnonzero(allowed[:, q])
                s = s[own]
            else:
                own = None
            floor = held[-1][0] if len(held) >= self.k else -np.inf
            if len(s) > self.k:
                floor = max(floor, np.partition(s, len(s) - self.k)[len(s) - self.k])
            at = np.flatnonzero(s >= floor)
            if not len(at):
                continue
            at = at[np.argsort(-s[at], kind="stable")[: self.k]]  # keys are in order, so ties are
            new = [(float(s[i]), keys[order[i if own is None else own[i]]]) for i in at]
            self.held[q] = sorted(held + new, key=lambda x: (-x[0], x[1]))[: self.k]

    def batch(self, ids: list, key_type: pa.DataType, id_type: pa.DataType, key: str) -> pa.RecordBatch:
        rows = [(i, name, s) for i, held in zip(ids, self.held) for s, name in held]
        a, b, c = zip(*rows) if rows else ((), (), ())
        return pa.record_batch([pa.array(a, id_type), pa.array(b, key_type), pa.array(c, pa.float64())], names=["query_id", key, "score"])


def _scan(docs: DataFrame, column: str, key: str, k: int, rows: list, score: Callable, group: str | None, open_group: bool, id_kind: str, id_type: pa.DataType) -> DataFrame:
    """k best of each row of a block. score: list of values -> (scores, allowed or None), each values x rows."""
    ids = [r.query_id for r in rows]
    groups = [r.group for r in rows] if group else None
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, key_type = Best(len(ids), k), None
        for batch in batches:
            key_type = batch.schema.types[0]
            keys, values = batch.column(0).to_pylist(), batch.column(1)
            names = batch.column(2).to_pylist() if group else None
            for lo, hi, scores, allowed in score(values):
                if group:
                    same = np.array([[(g is None and open_group) or (g is not None and g == x) for g in groups] for x in names[lo:hi]], bool).reshape(hi - lo, len(ids))
                    allowed = same if allowed is None else allowed & same
                best.add(keys[lo:hi], scores, allowed)
        if key_type is not None:
            yield best.batch(ids, key_type, id_type, key)

    picked = docs.select(key, column, *([group] if group else [])).filter(F.col(column).isNotNull() & F.col(key).isNotNull())
    return picked.mapInArrow(run, f"query_id {id_kind}, `{key}` {kind}, score double")


def _id_type(queries: DataFrame) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = queries.schema["query_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def ranked_parts(parts: list[DataFrame], spark: SparkSession, kind: str, key: str, k: int) -> DataFrame:
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], kind)
    return top(found, k, key)


def _ranked(parts: list[DataFrame], docs: DataFrame, queries: DataFrame, key: str, k: int) -> DataFrame:
    kind = f"query_id {_id_type(queries)[0]}, `{key}` {docs.schema[key].dataType.simpleString()}, score double"
    return ranked_parts(parts, docs.sparkSession, kind, key, k)


def _columns(group: str | None) -> list:
    return ["query_id", "text"] + ([F.col(group).alias("group")] if group else [])


# ---- words -----------------------------------------------------------------------------------------------------------


def word_statistics(docs: DataFrame, words: list[str], text: str = "text") -> tuple[int, float, dict[str, int]]:
    """Number of texts (nulls count as empty), their mean length in tokens, and how many hold each of the words."""
    vocabulary = {w: i for i, w in enumerate(words)}
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, size, df = 0, 0, np.zeros(len(vocab.value), np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                tokens = _TOKEN.findall(t.lower()) if t else []
                n, size = n + 1, size + len(tokens)
                for w in set(tokens) & vocab.value.keys():
                    df[vocab.value[w]] += 1
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array([-2, -1, *at.tolist()], pa.int32()), pa.array([n, size, *df[at].tolist()], pa.int64())], names=["word", "n"])

    got = {r.word: r.total for r in docs.select(text).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("total")).collect()}  # a row a query word
    n = got.get(-2, 0)
    return n, (got.get(-1, 0) / n if n else 0.0), {w: got.get(i, 0) for w, i in vocabulary.items()}


def best_by_words(docs: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", text: str = "text", group: str | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, key, score, rank): the k best texts of each query by BM25, of those that share a word with it.

    With group, a column of both tables, only texts of the query's group count, all where it is null; statistics are
    those of all texts. Ties go to the least key; repeated words of a query count as often as they stand there.
    """
    parts, (id_kind, id_type) = [], _id_type(queries)
    for rows in blocks_of(queries, F.size(T.tokens(F.coalesce("text", F.lit("")))), _columns(group)):
        counts = [Counter(_TOKEN.findall((r.text or "").lower())) for r in rows]
        words = sorted(set().union(*counts))
        n, mean, df = word_statistics(docs, words, text)
        weights = np.zeros((len(words), len(rows)))
        place = {w: i for i, w in enumerate(words)}
        for q, c in enumerate(counts):
            for w, times in c.items():
                weights[place[w], q] = times * np.log1p((n - df[w] + 0.5) / (df[w] + 0.5))
        shared = docs.sparkSession.sparkContext.broadcast((place, weights))
        step, mean = max(16, CELLS // max(1, len(words))), mean or 1.0

        def score(values: pa.Array, shared=shared, step=step, mean=mean):
            place, weights = shared.value
            for lo in range(0, len(values), step):
                texts = values[lo : lo + step].to_pylist()
                tf, size = np.zeros((len(texts), len(place))), np.zeros(len(texts))
                for i, t in enumerate(texts):
                    tokens = _TOKEN.findall(t.lower())
                    size[i] = len(tokens)
                    for w, c in Counter(tokens).items():
                        if (v := place.get(w)) is not None:
                            tf[i, v] = c
                s = (tf * (k1 + 1) / (tf + (k1 * (1 - b + b * size / mean))[:, None])) @ weights
                yield lo, lo + len(texts), s, s > 0

        parts.append(_scan(docs, text, key, k, rows, score, group, True, id_kind, id_type))
    return _ranked(parts, docs, queries, key, k)


# ---- feature hashing -------------------------------------------------------------------------------------------------


class Signed(dict):
    """Twice the cell of a token, and 1 more where its sign is positive; md5 is taken of tokens not met before."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        h = int.from_bytes(hashlib.md5(token.encode()).digest())
        self[token] = at = 2 * (h % self.dim) + ((h >> 8) & 1)
        return at


def cells_of(texts: list[str], dim: int, known: Signed) -> np.ndarray:
    """Rows of length 1, or 0 without tokens: each token adds its sign (bit 8 of its md5) to the cell md5 mod dim."""
    signed: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if len(known) > 200_000:
            known.clear()
        tokens = _TOKEN.findall(t.lower())
        sizes[i] = len(tokens)
        signed.extend(map(known.__getitem__, tokens))
    at = np.array(signed, np.int64)
    place = np.repeat(np.arange(len(texts)) * dim, sizes) + (at >> 1)
    out = np.bincount(place, 2.0 * (at & 1) - 1, len(texts) * dim).astype(np.float64, copy=False).reshape(len(texts), dim)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def best_by_hash(docs: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", text: str = "text", dim: int = 256) -> DataFrame:
    """(query_id, key, score, rank): the k best texts of each query by cosine of hashed words, of those with a common cell."""
    parts, (id_kind, id_type) = [], _id_type(queries)
    for rows in blocks_of(queries, F.lit(1), ["query_id", "text"]):
        wanted = docs.sparkSession.sparkContext.broadcast(cells_of([r.text or "" for r in rows], dim, Signed(dim)))

        def score(values: pa.Array, wanted=wanted):
            q, known = wanted.value.T, Signed(dim)
            step = max(16, CELLS // dim)
            for lo in range(0, len(values), step):
                d = cells_of(values[lo : lo + step].to_pylist(), dim, known)
                yield lo, lo + len(d), d @ q, ((d != 0).astype(np.float32) @ (q != 0).astype(np.float32)) > 0

        parts.append(_scan(docs, text, key, k, rows, score, None, False, id_kind, id_type))
    return _ranked(parts, docs, queries, key, k)


def hash_cells(docs: DataFrame, key: str = "chunk_id", text: str = "text", dim: int = 256) -> DataFrame:
    """(key, idx, w): the sparse vector of each row's text, in one pass; null and blank texts have no cells."""
    if dim <= 0:
        raise ValueError("dim must be positive")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Signed(dim)
        step = max(16, CELLS // dim)
        for batch in batches:
            for lo in range(0, len(batch), step):
                part = batch.slice(lo, step)
                cells = cells_of(part.column(1).to_pylist(), dim, known)
                row, idx = np.nonzero(cells)
                yield pa.record_batch([part.column(0).take(pa.array(row)), pa.array(idx.astype(np.int32)), pa.array(cells[row, idx])], names=[key, "idx", "w"])

    return docs.select(key, text).filter(F.col(text).isNotNull()).mapInArrow(run, f"`{key}` {kind}, idx int, w double")


# ---- dense vectors ---------------------------------------------------------------------------------------------------


def best_by_vector(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", group: str | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k best vectors of each query by cosine, 0 where either has no length.

    queries: query_id, vector (and group); vectors of one table have one length. With group only vectors of the same,
    known group count. Null vectors take no part.
    """
    parts, (id_kind, id_type) = [], _id_type(queries)
    for rows in blocks_of(queries.filter("vector IS NOT NULL"), F.ceil(F.size("vector") / 64), ["query_id", "vector"] + ([F.col(group).alias("group")] if group else [])):
        q = np.array([r.vector for r in rows], np.float64)
        shared = vectors.sparkSession.sparkContext.broadcast(q)

        def score(values: pa.Array, shared=shared):
            q = shared.value
            width = q.shape[1]
            step = max(16, CELLS // max(width, len(q)))
            for lo in range(0, len(values), step):
                v = values[lo : lo + step]
                flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                d = flat.reshape(len(v), width) if width and len(flat) == len(v) * width else np.array([np.resize(x or [0.0], width) for x in v.to_pylist()])
                below = np.linalg.norm(d, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
                yield lo, lo + len(v), np.divide(d @ q.T, below, out=np.zeros_like(below), where=below > 0), None

        parts.append(_scan(vectors, vector, key, k, rows, score, group, False, id_kind, id_type))
    return _ranked(parts, vectors, queries, key, k)
