import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.llm import near_duplicates as N
from strataline.llm.shingles import normal, shingle_tokens
from strataline.operators.skew import hot_keys

WORDS = [f"w{k}" for k in range(400)]
STOCK = ["in", "our", "view", "the", "cost", "of", "sales", "rose", "as", "a", "result"]


def corpus(seed=3, families=25):
    r = random.Random(seed)
    out = {}
    for f in range(families):
        base = [r.choice(WORDS) if r.random() < 0.7 else r.choice(STOCK) for _ in range(r.randint(35, 70))]
        for v in range(r.randint(1, 4)):
            t = list(base)
            for _ in range(r.choice([0, 1, 3, 8, 14])):
                k = r.randrange(len(t))
                t[k : k + r.choice([0, 1])] = [r.choice(WORDS)]
            out[f"k{f:02}{v}"] = " ".join(t)
    return out


def expected(texts, words, threshold, least=30):
    sets = {}
    for k, t in texts.items():
        w = normal(t).split()
        if len(w) >= least:
            sets[k] = set(zip(*(w[i:] for i in range(words))))
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}


def frame(spark, rows):
    return spark.createDataFrame(rows, "tbl string, key string, text string")


@pytest.mark.parametrize("words, threshold", [(3, 0.5), (5, 0.8)])
def test_all_pairs_and_no_other(spark, words, threshold):
    texts = corpus()
    got = N.pairs(frame(spark, [("t", k, t) for k, t in texts.items()]), words, threshold)
    assert {(r.left_key, r.right_key) for r in got.collect()} == expected(texts, words, threshold)


def test_edge_cases(spark):
    long = " ".join(random.Random(1).choices(WORDS, k=60_000))
    base = " ".join(WORDS[:40])
    rows = [("t", "a", base), ("t", "a", base), ("t", "b", "  " + base.upper().replace(" ", "\n\t", 5)), ("u", "c", base), ("t", "d", None), ("t", None, base), ("t", "e", ""), ("t", "f", " ".join(WORDS[:29])), ("t", "g", long), ("t", "h", long + " end"), ("t", "i", base.replace("w1 ", "w1\u00a0"))]
    got = {(r.left_key, r.right_key) for r in N.pairs(frame(spark, rows), 3, 0.5).collect()}
    assert ("a", "b") in got and ("g", "h") in got and not any("c" in p for p in got) and not any(p[0] == p[1] for p in got)
    assert ("a", "i") in got  # the no-break space joins two words, the rest agrees


def test_clashing_columns_and_empty_tables(spark):
    texts = corpus(5, 4)
    extra = frame(spark, [("t", k, t) for k, t in texts.items()]).withColumns({c: F.lit(1) for c in ("id", "id2", "norm", "a", "b", "rep", "size", "bucket")})
    assert {(r.left_key, r.right_key) for r in N.pairs(extra, 3, 0.5).collect()} == expected(texts, 3, 0.5)
    assert N.pairs(frame(spark, []), 3, 0.5).count() == 0 and N.groups(frame(spark, []), 3, 0.5).count() == 0


def test_groups_are_the_connected_parts(spark):
    texts = corpus(9)
    links = expected(texts, 3, 0.5)
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.key: r.group_key for r in N.groups(frame(spark, [("t", k, t) for k, t in texts.items()]), 3, 0.5).collect()}
    assert got == {k: find(k) for k in texts}


def test_large_class_is_linked_to_its_first(spark):
    base = " ".join(WORDS[:40])
    got = {(r.left_key, r.right_key) for r in N.pairs(frame(spark, [("t", f"{k:02}", base) for k in range(12)]), 3, 0.5, expand=4).collect()}
    assert got == {("00", f"{k:02}") for k in range(1, 12)} | set(combinations(["00", "01", "02", "03"], 2))


def test_frequent_shingles_spread_over_cells(monkeypatch):
    """Every pair meets once per common shingle, however the postings are spread."""
    texts = [normal(" ".join(WORDS[:30] + [WORDS[100 + k % 50]] * 6)) for k in range(60)]
    ids = np.arange(60, dtype=np.int64) * 7919 - 90
    order = np.full(1 << N.SKETCH_BITS, N._code(np.array([60]))[0], np.uint8)

    def pairs(cell):
        monkeypatch.setattr(N, "CELL", cell)
        doc, tok, pos, side, n, match = N._postings(ids, texts, 3, 0.5, order, N._decode())
        seen = {}
        for a, b, _ in N._pairs(tok, ids[doc], n[doc], match[doc], pos, side, 0.5):
            for p in zip(a.tolist(), b.tolist()):
                seen[p] = seen.get(p, 0) + 1
        return seen

    assert pairs(4096) == pairs(7)


def test_shingle_of_fifty_thousand_records_is_spread(spark):
    """Counted by the sketch of several tasks, and split so that no list of postings is long."""
    n, words, threshold = 50_000, 3, 0.04
    df = spark.range(n, numPartitions=6).select(F.lit("t").alias("tbl"), F.format_string("k%05d", "id").alias("key"), F.concat_ws(" ", F.lit("net sales rose"), F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat_ws("x", "id", i))).alias("text"))
    order, decode = N.sketch(N.prepare(df), words, 30), N._decode()
    _, common = shingle_tokens([b"net sales rose"], words, N._seeds(["t"]))
    estimate = decode[order[int(common[0] >> np.uint64(N.TOKEN_BITS - N.SKETCH_BITS))]]
    assert n <= estimate <= 1.6 * n
    lists: dict[int, int] = {}
    texts = [normal("net sales rose " + " ".join(f"{k}x{i}" for i in range(1, 31))) for k in range(n)]
    ids = N._class_ids(["t"] * n, texts)[:, 0].copy()
    for lo in range(0, n, 4096):
        _, tok, _, _, _, _ = N._postings(ids[lo : lo + 4096], texts[lo : lo + 4096], words, threshold, order, decode, N._seeds(["t"] * len(texts[lo : lo + 4096])))
        for t, c in zip(*np.unique(tok, return_counts=True)):
            lists[t] = lists.get(t, 0) + int(c)
    assert sum(lists.values()) >= n and max(lists.values()) <= 2.5 * N.CELL


def test_common_shingle_through_candidates_in_bounded_memory(spark):
    """Postings of a shingle of all records, bucket by bucket: no pair comes out, and a bucket takes little memory."""
    import tracemalloc

    n, words, threshold, buckets = 12_000, 3, 0.04, 6
    df = spark.range(n, numPartitions=3).select(F.lit("t").alias("tbl"), F.format_string("k%05d", "id").alias("key"), F.concat_ws(" ", F.lit("net sales rose"), F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat_ws("x", "id", i))).alias("text"))
    p = N.prepare(df)
    order = N.sketch(p, words, 30)
    blobs = N.postings(p, words, threshold, 30, order, buckets).collect()
    assert max(len(r.blob) for r in blobs) < 2_000_000
    most = 0
    for b in range(buckets):
        own = [r.blob for r in blobs if r.bucket == b]
        tracemalloc.start()
        cols = [N._unpack(x) for x in own]
        found = sum(len(a) for a, _, _ in N._pairs(*(np.concatenate(c) for c in zip(*cols)), threshold)) if cols else 0
        most = max(most, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found == 0
    assert most < 200_000_000


def test_hot_class_and_star_of_links(spark, monkeypatch):
    """A class and a node with a large share of all rows, their joins salted."""
    monkeypatch.setattr(N, "hot_keys", lambda df, keys: hot_keys(df, keys, 20))
    base = WORDS[:40]
    rows = [("t", f"a{k:02}", " ".join(base)) for k in range(30)] + [("t", f"b{k:02}", " ".join(base[:36] + [f"v{k}"] * 4)) for k in range(30)]
    texts = {k: t for _, k, t in rows}
    got = {r.key: (r.class_key, r.group_key, r.links) for r in N.groups(frame(spark, rows), 3, 0.5).collect()}
    assert all(got[f"a{k:02}"] == ("a00", "a00", 30) for k in range(30)) and all(got[f"b{k:02}"] == (f"b{k:02}", "a00", 30) for k in range(30))
    assert {(r.left_key, r.right_key) for r in N.pairs(frame(spark, rows), 3, 0.5).collect()} == expected(texts, 3, 0.5)


def test_column_packing():
    for x in (np.array([0, 5, 2**44 - 1], np.uint64), np.zeros(3, np.int64), np.array([2**64 - 1], np.uint64)):
        raw = N._column(x)
        width, count = np.frombuffer(raw, np.int64, 2)
        planes = np.zeros((8, count), np.uint8)
        planes[:width] = np.frombuffer(raw, np.uint8, offset=16).reshape(width, count)
        assert (np.ascontiguousarray(planes.T).view(np.uint64).ravel() == x.astype(np.uint64)).all()


def test_hashes_don_t_depend_on_the_batch():
    a, b = normal("one two three four"), normal("zero one two three four five")
    together = shingle_tokens([b, a], 3)
    alone = shingle_tokens([a], 3)[1]
    assert set(alone.tolist()) == set(together[1][together[0] == 1].tolist()) and set(alone.tolist()) < set(together[1][together[0] == 0].tolist())
