"""Near-duplicate records: an exact set-similarity self-join with adaptive multi-match prefixes.

Every record is the set of its distinct word shingles, ordered rarest first by a count sketch of fixed size. A record
whose prefix has n - ceil(t n) + l shingles shares at least l of them with each partner; l is chosen per record as the
cheapest trade of postings scanned against candidates to verify, so frequent wording gets longer prefixes and has to
match more often before a pair is looked at. Any consistent order keeps the join exact; the sketch only sets its cost.

Records of equal words are one class, and only classes are compared. A shingle held by many classes is spread over
a triangle of cells, so no task sees an unbounded list of postings. Pairs are verified on the words themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.shingles import TOKEN_BITS, mix, normal, shingle_tokens, slices
from strataline.operators.skew import hot_keys, salted_join
from strataline.session import cut_lineage, partitions, release

#: Records of a class of equal texts that are written out in all pairs.
EXPAND = 32
SKETCH_BITS = 22
BLOCKS = 64
CELL = 4096
WANTED_BITS = 25
MAX_MATCH = 6
#: Share of accidental partners left by each further shingle required, and cost of verifying one against scanning a posting.
DECAY, VERIFY = 0.3, 60.0
#: Postings or pairs that a task holds before it sends them on, and postings meant for one bucket.
FLUSH, BUCKET = 500_000, 1_000_000
#: Digests of texts that a task remembers to send copies only once, and tasks whose tables are added up at a time.
SEEN, LANES = 200_000, 64


def _class_ids(tables: list[str | None], texts: list[bytes]) -> np.ndarray:
    """128 bits of each text within its table, as two columns."""
    digests = b"".join(xxhash.xxh3_128_digest(t + b"\0" + (tbl or "").encode()) for tbl, t in zip(tables, texts))
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def _seeds(tables: list[str | None]) -> np.ndarray:
    of = {t: xxhash.xxh3_64_intdigest((t or "").encode()) for t in set(tables)}
    return np.array([of[t] for t in tables], np.uint64)


def _batches(batches: Iterator[pa.RecordBatch], min_words: int, once: bool = False) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray]]:
    """The rows of enough words, their normalised texts and class ids; with once without the copies that the task has just seen."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        texts = [normal(t) for t in batch.column("text").to_pylist()]
        keep = [k for k, t in enumerate(texts) if t.count(b" ") + 1 >= min_words]
        if not keep:
            continue
        rows, texts = batch.select(["tbl", "key"]).take(pa.array(keep)), [texts[k] for k in keep]
        ids = _class_ids(rows.column("tbl").to_pylist(), texts)
        if once:
            new = []
            for k, pair in enumerate(map(tuple, ids.tolist())):
                if pair not in seen:
                    seen.add(pair)
                    new.append(k)
            if len(seen) > SEEN:
                seen.clear()
            if not new:
                continue
            if len(new) < len(texts):
                rows, texts, ids = rows.take(pa.array(new)), [texts[k] for k in new], ids[new]
        yield rows, texts, ids


def prepare(records: DataFrame) -> DataFrame:
    return records.select(F.coalesce(F.col("tbl").cast("string"), F.lit("")).alias("tbl"), F.col("key").cast("string").alias("key"), F.col("text").cast("string").alias("text")).filter("key IS NOT NULL AND text IS NOT NULL")


# ---- order of the shingles -------------------------------------------------------------------------------------------


def _code(counts: np.ndarray) -> np.ndarray:
    c = counts.astype(np.float64)
    return np.where(c <= 127, c, np.minimum(255, 127 + 4 * np.log2(np.maximum(c, 127) / 127))).astype(np.uint8)


def _decode() -> np.ndarray:
    k = np.arange(256)
    return np.where(k <= 127, k, np.ceil(127 * 2.0 ** ((k - 127 + 1) / 4))).astype(np.int64)


def _parts(parts: list[bytes]) -> pa.RecordBatch:
    """One row a block, with the lane of this task."""
    lane = TaskContext.get().partitionId() // LANES
    return pa.record_batch([pa.array([lane] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["lane", "block", "part"])


def _gathered(rows: DataFrame, blocks: int, add) -> bytes:
    """Parts of a table of fixed size, added up by block and put together.

    The tasks of a lane are added up first and then the lanes, so that no task holds more than LANES parts of one block
    at first and one part a lane thereafter.
    """

    def lanes(table: pa.Table) -> pa.Table:
        return pa.table({"lane": table.column("lane")[:1], "block": table.column("block")[:1], "part": pa.array([add(table.column("part"))], pa.binary())})

    def whole(table: pa.Table) -> pa.Table:
        return pa.table({"block": table.column("block")[:1], "part": pa.array([add(table.column("part"))], pa.binary())})

    by_lane = rows.groupBy("lane", "block").applyInArrow(lanes, "lane int, block int, part binary")
    got = by_lane.groupBy("block").applyInArrow(whole, "block int, part binary").collect()  # as many rows as blocks
    at = {r.block: bytes(r.part) for r in got}
    width = len(next(iter(at.values()))) if at else 0
    return b"".join(at.get(b, b"\0" * width) for b in range(blocks))


def sketch(prepared: DataFrame, words: int, min_words: int) -> np.ndarray:
    """Number of shingles per cell, coded in a byte: 2**SKETCH_BITS bytes whatever the input.

    Counts up to 127 are exact, larger ones are told by a logarithmic code that is read back as its upper end, so adding
    up the tables of the tasks never counts too few; the code reaches to 5e11.
    """
    width, decode = (1 << SKETCH_BITS) // BLOCKS, _decode()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch, texts, _ in _batches(batches, min_words, once=True):
            seeds = _seeds(batch.column("tbl").to_pylist())
            for lo, hi in slices(texts):
                _, tok = shingle_tokens(texts[lo:hi], words, seeds[lo:hi])
                np.add.at(total, (tok >> np.uint64(TOKEN_BITS - SKETCH_BITS)).astype(np.int64), 1)
        if total.any():
            part = _code(total)
            yield _parts([part[b * width : (b + 1) * width].tobytes() for b in range(BLOCKS)])

    def add(parts: pa.ChunkedArray) -> bytes:
        total = np.zeros(width, np.int64)
        for x in parts:
            total += decode[np.frombuffer(x.as_py(), np.uint8)]
        return _code(total).tobytes()

    whole = _gathered(prepared.mapInArrow(count, "lane int, block int, part binary"), BLOCKS, add)
    return np.frombuffer(whole, np.uint8) if whole else np.zeros(1 << SKETCH_BITS, np.uint8)


# ---- prefixes --------------------------------------------------------------------------------------------------------


def choose_prefixes(doc: np.ndarray, est: np.ndarray, n: np.ndarray, threshold: float) -> np.ndarray:
    """Matches to require of each record: the count of least estimated cost. doc, est: by record, rarest shingle first."""
    start = np.concatenate(([0], np.cumsum(n)))
    hits = np.concatenate(([0.0], np.cumsum(np.maximum(est - 1, 0), dtype=np.float64)))
    base = n - np.ceil(threshold * n - 1e-9).astype(np.int64)
    best, cheapest = np.ones(len(n), np.int64), None
    for match in range(1, MAX_MATCH + 1):
        scanned = hits[start[:-1] + np.minimum(base + match, n)] - hits[start[:-1]]
        cost = scanned * (1 + VERIFY * DECAY ** (match - 1))
        if cheapest is None:
            cheapest = cost
        else:
            better = cost < cheapest
            best[better], cheapest = match, np.minimum(cost, cheapest)
    return np.minimum(best, np.maximum(1, n - base))


def _postings(ids: np.ndarray, texts: list[bytes], words: int, threshold: float, order: np.ndarray, decode: np.ndarray, seeds: np.ndarray | None = None):
    doc, tok = shingle_tokens(texts, words, seeds)
    if not len(doc):
        return None
    code = order[(tok >> np.uint64(TOKEN_BITS - SKETCH_BITS)).astype(np.int64)]
    keys = np.unique((doc.astype(np.uint64) << np.uint64(52)) | (code.astype(np.uint64) << np.uint64(44)) | tok)
    doc = (keys >> np.uint64(52)).astype(np.int64)
    code = ((keys >> np.uint64(44)) & np.uint64(255)).astype(np.int64)
    tok = keys & np.uint64((1 << TOKEN_BITS) - 1)
    est = decode[code]
    n = np.bincount(doc, minlength=len(texts))
    match = choose_prefixes(doc, est, n, threshold)
    pos = np.arange(len(doc)) - np.concatenate(([0], np.cumsum(n)))[doc]
    base = n - np.ceil(threshold * n - 1e-9).astype(np.int64)
    keep = (pos < (base + match)[doc]) & (code > 1)
    doc, tok, est, pos = doc[keep], tok[keep], est[keep], pos[keep]
    side = np.zeros(len(doc), np.uint8)
    hot = est > CELL
    if hot.any():  # a triangle of cells for each frequent shingle
        d, t, p = doc[hot], tok[hot], pos[hot]
        splits = -(-est[hot] // CELL)
        block = (mix(ids[d].view(np.uint64)) % splits.astype(np.uint64)).astype(np.int64)
        rep = np.repeat(np.arange(len(d)), splits)
        other = np.arange(len(rep)) - np.repeat(np.cumsum(splits) - splits, splits)
        i, j = np.minimum(block[rep], other), np.maximum(block[rep], other)
        cell = mix(t[rep] + (i.astype(np.uint64) << np.uint64(44)) + mix(j.astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - TOKEN_BITS)
        sides = np.where(i == j, 0, np.where(block[rep] == i, 1, 2)).astype(np.uint8)
        doc, tok = np.concatenate((doc[~hot], d[rep])), np.concatenate((tok[~hot], cell))
        pos, side = np.concatenate((pos[~hot], p[rep])), np.concatenate((side[~hot], sides))
    return doc, tok, pos, side, n, match


def postings(prepared: DataFrame, words: int, threshold: float, min_words: int, order: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, blob): the postings of many records in one row each, in columns."""
    shared = prepared.sparkSession.sparkContext.broadcast(order)
    decode = _decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            offset, cols = 0, []
            for ids, (doc, tok, pos, side, n, match) in held:
                cols.append((doc + offset, tok, pos, side, ids, n, match))
                offset += len(ids)
            doc, tok, pos, side, ids, n, match = (np.concatenate(c) for c in zip(*cols))
            bucket = (mix(tok) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            names, blobs = [], []
            for b in range(buckets):
                pick = by[cuts[b] : cuts[b + 1]]
                if not len(pick):
                    continue
                pick = pick[np.argsort(tok[pick], kind="stable")]
                docs, local = np.unique(doc[pick], return_inverse=True)
                steps = np.diff(tok[pick], prepend=np.uint64(0))
                names.append(b)
                blobs.append(b"".join(_column(x) for x in (ids[docs].view(np.uint64), n[docs], match[docs], local, steps, pos[pick], side[pick])))
            yield pa.record_batch([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for batch, texts, both in _batches(batches, min_words, once=True):
            all_ids, seeds = np.ascontiguousarray(both[:, 0]), _seeds(batch.column("tbl").to_pylist())
            for lo, hi in slices(texts):
                got = _postings(all_ids[lo:hi], texts[lo:hi], words, threshold, shared.value, decode, seeds[lo:hi])
                if got is not None:
                    held.append((all_ids[lo:hi], got))
                    size += len(got[0])
                if size > FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return prepared.mapInArrow(run, "bucket int, blob binary")


def _column(x: np.ndarray) -> bytes:
    """The whole numbers in as few bytes each as the largest needs, by planes; with a head to read them back."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x, np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T
    return np.array([width, len(x)], np.int64).tobytes() + planes.tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    at, cols = 0, []
    while at < len(blob):
        width, count = (int(x) for x in np.frombuffer(blob, np.int64, 2, at))
        planes = np.zeros((8, count), np.uint8)
        planes[:width] = np.frombuffer(blob, np.uint8, width * count, at + 16).reshape(width, count)
        cols.append(np.ascontiguousarray(planes.T).view(np.uint64).ravel())
        at += 16 + width * count
    ids, n, match, local, steps, pos, side = cols
    local = local.astype(np.int64)
    return np.cumsum(steps, dtype=np.uint64), ids.view(np.int64)[local], n.astype(np.int32)[local], match.astype(np.int8)[local], pos.astype(np.int32), side.astype(np.int8)


def _pairs(tok, ids, n, match, pos, side, threshold: float):
    """Pairs of records at a common posting that pass the length and the position filter, in bounded batches."""
    by = np.lexsort((ids, n, tok))
    tok, ids, n, match, pos, side = (x[by] for x in (tok, ids, n, match, pos, side))
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (ids[1:] != ids[:-1])
    tok, ids, n, match, pos, side = (x[new] for x in (tok, ids, n, match, pos, side))
    share = threshold / (1 + threshold)
    active, step, out, size = np.arange(len(tok)), 0, [], 0
    while len(active):
        step += 1
        active = active[active + step < len(tok)]
        j = active + step
        same = (tok[j] == tok[active]) & (n[active] >= threshold * n[j] - 1e-9)  # by length: no later one fits either
        active, j = active[same], j[same]
        need = np.ceil(share * (n[active] + n[j]) - 1e-9).astype(np.int64)
        least = np.minimum(np.minimum(match[active], match[j]), need)
        ok = (pos[active] <= n[active] - need + least - 1) & (pos[j] <= n[j] - need + least - 1)
        ok &= np.where((side[active] == 0) | (side[j] == 0), side[active] == side[j], side[active] != side[j])
        i, j, least = active[ok], j[ok], least[ok]
        out.append((np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), least.astype(np.int8)))
        size += len(i)
        if size > FLUSH:
            yield tuple(np.concatenate(c) for c in zip(*out))
            out, size = [], 0
    if size:
        yield tuple(np.concatenate(c) for c in zip(*out))


def candidates(blobs: DataFrame, threshold: float, buckets: int) -> DataFrame:
    """(a, b) of the classes that share as many prefix shingles as the less demanding of the two asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [_unpack(x.as_py()) for batch in batches for x in batch.column(1)]
        if not cols:
            return
        for a, b, least in _pairs(*(np.concatenate(c) for c in zip(*cols)), threshold):
            by = np.lexsort((b, a))
            a, b, least = a[by], b[by], least[by]
            first = np.ones(len(a), bool)
            first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            at = np.flatnonzero(first)
            counts = np.diff(np.append(at, len(a))).astype(np.int32)
            for lo in range(0, len(at), 100_000):
                k = slice(lo, lo + 100_000)
                yield pa.record_batch([pa.array(a[at[k]]), pa.array(b[at[k]]), pa.array(counts[k]), pa.array(least[at[k]].astype(np.int32))], names=["a", "b", "shared", "least"])

    met = blobs.repartitionById(buckets, F.col("bucket")).mapInArrow(run, "a long, b long, shared int, least int")
    return met.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("least").alias("least")).filter("shared >= least").select("a", "b")


# ---- verification ----------------------------------------------------------------------------------------------------


def _wanted(found: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the classes in candidate pairs: a sieve that lets a few others through."""
    width = (1 << WANTED_BITS) // 8 // BLOCKS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << WANTED_BITS, bool)
        seen = False
        for batch in batches:
            for c in range(2):
                bits[batch.column(c).to_numpy().view(np.uint64) >> np.uint64(64 - WANTED_BITS)] = seen = True
        if seen:
            packed = np.packbits(bits)
            yield _parts([packed[b * width : (b + 1) * width].tobytes() for b in range(BLOCKS)])

    def join(parts: pa.ChunkedArray) -> bytes:
        total = np.zeros(width, np.uint8)
        for x in parts:
            total |= np.frombuffer(x.as_py(), np.uint8)
        return total.tobytes()

    whole = _gathered(found.mapInArrow(mark, "lane int, block int, part binary"), BLOCKS, join)
    return np.frombuffer(whole or b"\0" * (width * BLOCKS), np.uint8)


def _classified(prepared: DataFrame, min_words: int, wanted: np.ndarray) -> DataFrame:
    """(tbl, key, id, id2, norm) of every record; norm only where the class may be in a candidate pair."""
    shared = prepared.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        for batch, texts, ids in _batches(batches, min_words):
            at = (np.ascontiguousarray(ids[:, 0]).view(np.uint64) >> np.uint64(64 - WANTED_BITS)).astype(np.int64)
            hit = (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            norm = pa.array([zlib.compress(t, 1) if h else None for t, h in zip(texts, hit)], pa.binary())
            yield pa.record_batch([batch.column("tbl"), batch.column("key"), pa.array(ids[:, 0].copy()), pa.array(ids[:, 1].copy()), norm], names=["tbl", "key", "id", "id2", "norm"])

    return prepared.mapInArrow(run, "tbl string, key string, id long, id2 long, norm binary")


def jaccard(left: bytes, right: bytes, words: int) -> float:
    """Of the word shingles of two packed texts."""
    sets = []
    for t in (left, right):
        w = zlib.decompress(t).split(b" ")
        sets.append(frozenset(zip(*(w[k:] for k in range(words)))))
    both = len(sets[0] & sets[1])
    union = len(sets[0]) + len(sets[1]) - both
    return both / union if union else 0.0


def _verify(words: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sim = [jaccard(x, y, words) for x, y in zip(batch.column("norm_l").to_pylist(), batch.column("norm_r").to_pylist())]
            keep = pa.array([s >= threshold for s in sim], pa.bool_())
            kept = pa.record_batch([batch.column("rep_l"), batch.column("rep_r"), pa.array(sim, pa.float64())], names=["rep_l", "rep_r", "similarity"])
            yield kept.filter(keep)

    return run


def links(records: DataFrame, words: int = 5, threshold: float = 0.8, min_words: int = 30) -> tuple[DataFrame, DataFrame]:
    """Classes of equal records and the links between them.

    records: tbl, key, text; records of different tbl are never compared, a null one counts as ""; other columns are ignored. Null keys and null,
    blank or shorter texts take no part. Repeated rows count once.

    Returns classes (tbl, key, id, id2) with a row for each row of enough words, (id, id2) naming its class, and links (rep_l, rep_r,
    similarity) between different classes, each told by the (tbl, key) of its least record, rep_l < rep_r. Rows of an
    empty table give empty results.
    """
    if min_words < words:
        raise ValueError("min_words must be at least words")
    prepared = prepare(records)
    order = sketch(prepared, words, min_words)
    shingles = int(np.bincount(order, minlength=256) @ _decode())
    buckets = max(partitions(records.sparkSession), -(-int(shingles * (1 - threshold)) // BUCKET))
    found = cut_lineage(candidates(postings(prepared, words, threshold, min_words, order, buckets), threshold, buckets))
    release(records.sparkSession)  # the postings
    classified = cut_lineage(_classified(prepared, min_words, _wanted(found)))
    texts = classified.filter("norm IS NOT NULL").groupBy("id", "id2").agg(F.min(F.struct("tbl", "key")).alias("rep"), F.first("norm").alias("norm"))
    left = texts.select(F.col("id").alias("a"), F.col("rep").alias("rep_l"), F.col("norm").alias("norm_l"))
    right = texts.select(F.col("id").alias("b"), F.col("rep").alias("rep_r"), F.col("norm").alias("norm_r"))
    rep = "struct<tbl: string, key: string>"
    verified = (
        found.join(left, "a").join(right, "b").filter("rep_l.tbl <=> rep_r.tbl")
        .select(F.least("rep_l", "rep_r").alias("rep_l"), F.greatest("rep_l", "rep_r").alias("rep_r"), "norm_l", "norm_r")
        .mapInArrow(_verify(words, threshold), f"rep_l {rep}, rep_r {rep}, similarity double")
    )
    return classified.select("tbl", "key", "id", "id2"), verified


CLASS = ["tbl", "id", "id2"]


def membership(classes: DataFrame) -> DataFrame:
    """(tbl, key, rep): one row per record; rep is the least key of the records of equal words."""
    reps = classes.groupBy(*CLASS).agg(F.min("key").alias("rep"))
    return salted_join(classes, reps, CLASS, hot_keys(classes, CLASS)).select("tbl", "key", "rep").distinct()


def pairs(records: DataFrame, words: int = 5, threshold: float = 0.8, min_words: int = 30, expand: int = EXPAND) -> DataFrame:
    """(left_key, right_key, similarity), left_key < right_key: the links between records.

    Every link between different texts is there. Of each class of equal texts the first `expand` records in order of
    key are written out in all their pairs and in all links of the class; any further record is told once, as a copy of
    the first. So a class of any size adds at most `expand` rows a record; groups() has the exact membership of all.
    """
    classes, verified = links(records, words, threshold, min_words)
    reps = classes.groupBy(*CLASS).agg(F.min("key").alias("rep"), F.max("key").alias("last")).filter("rep < last").drop("last")
    members = cut_lineage(salted_join(classes, reps, CLASS, hot_keys(classes, CLASS)).select("tbl", "key", "rep"))
    first = (
        members.groupBy("tbl", "rep", F.pmod(F.xxhash64("key"), F.lit(64)).alias("salt"))
        .agg(F.slice(F.array_sort(F.collect_set("key")), 1, expand).alias("keys"))
        .groupBy("tbl", "rep")
        .agg(F.slice(F.array_sort(F.flatten(F.collect_list("keys"))), 1, expand).alias("keys"))
    )
    star = members.filter("key > rep").select(F.col("rep").alias("l"), F.col("key").alias("r"))
    within = first.select(F.explode("keys").alias("l"), "keys").select("l", F.explode("keys").alias("r")).filter("l < r")
    copies = star.unionByName(within).distinct().select("l", "r", F.lit(1.0).alias("similarity"))
    side = first.select(F.struct("tbl", "rep").alias("rep"), "keys")
    across = (
        verified.join(side.select(F.col("rep").alias("rep_l"), F.col("keys").alias("keys_l")), "rep_l", "left")
        .join(side.select(F.col("rep").alias("rep_r"), F.col("keys").alias("keys_r")), "rep_r", "left")
        .select(F.explode(F.coalesce("keys_l", F.array("rep_l.key"))).alias("l"), F.coalesce("keys_r", F.array("rep_r.key")).alias("keys_r"), "similarity")
        .select("l", F.explode("keys_r").alias("r"), "similarity")
    )
    both = across.unionByName(copies)
    return both.select(F.least("l", "r").alias("left_key"), F.greatest("l", "r").alias("right_key"), "similarity")


def groups(records: DataFrame, words: int = 5, threshold: float = 0.8, min_words: int = 30) -> DataFrame:
    """(tbl, key, class_key, group_key, links): one row per record of enough words.

    class_key is the least key of the records of equal words, group_key the least key of all records connected by links,
    links the number of other classes its class is linked to. Labels spread by minimum over the links and by pointer
    jumping, each round written to the shared folder once; nothing is gathered by component, and joins on nodes of very
    many links or labels of very many nodes are spread over several tasks.
    """
    classes, verified = links(records, words, threshold, min_words)
    members = cut_lineage(membership(classes))
    edges = cut_lineage(verified.select("rep_l.tbl", F.col("rep_l.key").alias("l"), F.col("rep_r.key").alias("r")))
    del verified, classes
    release(records.sparkSession)  # the texts of the pairs
    both = edges.select("tbl", F.col("l").alias("node"), F.col("r").alias("near")).unionByName(edges.select("tbl", F.col("r").alias("node"), F.col("l").alias("near")))
    degree = both.groupBy("tbl", "node").agg(F.count("*").alias("links"))
    busy = hot_keys(both, ["tbl", "near"])
    label = cut_lineage(both.groupBy("tbl", "node").agg(F.least(F.first("node"), F.min("near")).alias("label")).withColumn("moved", F.lit(True)))
    while not label.filter("moved").isEmpty():
        label = label.select("tbl", "node", "label")
        spread = salted_join(both, label.select("tbl", F.col("node").alias("near"), F.col("label").alias("seen")), ["tbl", "near"], busy).groupBy("tbl", "node").agg(F.min("seen").alias("seen"))
        jump = label.select("tbl", F.col("node").alias("label"), F.col("label").alias("further"))
        step = salted_join(label.join(spread, ["tbl", "node"]), jump, ["tbl", "label"], hot_keys(label, ["tbl", "label"]), "left")
        least = F.least("label", "seen", F.coalesce("further", "label"))
        label = cut_lineage(step.select("tbl", "node", least.alias("label"), (least < F.col("label")).alias("moved")))
    label = label.select("tbl", F.col("node").alias("rep"), "label")
    copied = hot_keys(members, ["tbl", "rep"])
    tagged = salted_join(salted_join(members, label, ["tbl", "rep"], copied, "left"), degree.withColumnRenamed("node", "rep"), ["tbl", "rep"], copied, "left")
    return tagged.select("tbl", "key", F.col("rep").alias("class_key"), F.coalesce("label", "rep").alias("group_key"), F.coalesce("links", F.lit(0)).alias("links"))


def filing_records(chunks: DataFrame, diffs: DataFrame) -> DataFrame:
    """The records of the two tables: chunks by chunk_id, entries of section_diffs as `<diff_id>:<side>:<i>`."""
    parts = [chunks.select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("key"), "text")]
    sides = {"added": F.col("added"), "removed": F.col("removed"), "old": F.col("changed.old_text"), "new": F.col("changed.new_text")}
    for side, values in sides.items():
        one = diffs.select("diff_id", F.posexplode(values).alias("i", "text"))
        parts.append(one.select(F.lit("section_diffs").alias("tbl"), F.concat_ws(":", "diff_id", F.lit(side), "i").alias("key"), "text"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
