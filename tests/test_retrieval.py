import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataline.operators import evaluation as E
from strataline.operators import packed as P
from strataline.operators import repeats
from strataline.operators import retrieval as R
from strataline.operators import scan as S

DOCS = {"a": "supply chain risk in glass manufacturing", "b": "supply of sand; supply of soda", "c": "legal matters", "d": "", "e": "risk risk risk"}
QUERIES = {"q1": "supply chain", "q2": "risk risk", "q3": "nothing here"}


def tokens(t):
    return re.findall("[a-z0-9]+", t.lower())


def brute(docs, queries):
    tf = {k: Counter(tokens(t)) for k, t in docs.items()}
    n, avg = len(docs), sum(len(tokens(t)) for t in docs.values()) / len(docs)
    df = Counter(w for c in tf.values() for w in c)
    out = {}
    for q, text in queries.items():
        for k, c in tf.items():
            s = sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)) for w in tokens(text) if c[w])
            if s > 0:
                out[q, k] = round(s, 6)
    return out


@pytest.fixture(scope="module")
def lists(spark):
    docs = spark.createDataFrame(list(DOCS.items()), "chunk_id string, text string")
    q = spark.createDataFrame(list(QUERIES.items()), "query_id string, text string")
    bm = R.bm25_scores(R.postings(docs), R.corpus_stats(docs), q).cache()
    dense = R.sparse_scores(R.hash_embedding(docs, dim=64), R.hash_embedding(q, key="query_id", dim=64)).cache()
    return docs, q, dense, bm


def test_bm25_against_brute_force(lists):
    assert {(r.query_id, r.chunk_id): r.score for r in lists[3].collect()} == pytest.approx(brute(DOCS, QUERIES), abs=2e-6)


def test_restricted_postings_give_the_same_scores(spark, lists):
    docs, q, _, bm = lists
    again = R.bm25_scores(R.postings(docs, terms=R.query_terms(q)), R.corpus_stats(docs), q)
    assert sorted(again.collect()) == sorted(bm.collect())


def test_empty_corpus(spark, lists):
    none = lists[0].limit(0)
    assert R.bm25_scores(R.postings(none), R.corpus_stats(none), lists[1]).count() == 0
    assert R.corpus_stats(none).first().avgdl == 0.0


def test_hash_embedding_by_hand(spark):
    import hashlib

    d = spark.createDataFrame([("x", "alpha beta alpha 42")], "chunk_id string, text string")
    for dim in (256, 100):
        want = Counter()
        for w in tokens("alpha beta alpha 42"):
            h = int(hashlib.md5(w.encode()).hexdigest(), 16)
            want[h % dim] += 1 if (h >> 8) & 1 else -1
        norm = math.sqrt(sum(v * v for v in want.values()))
        got = {r.idx: r.w for r in R.hash_embedding(d, dim=dim).collect()}
        assert got == pytest.approx({k: v / norm for k, v in want.items() if v})


def test_cosine_forms_agree(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.0, 0.0]), (2, [-1.0, 0.5]), (3, [2.0, 4.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = {(r.query_id, r.vec_id): r.score for r in S.best_by_vector(v, q, 9).collect()}
    x = v.crossJoin(q).select("query_id", "vec_id", R.cosine(F.col("vector"), F.col("embedding")).alias("s")).collect()
    assert got == pytest.approx({(r.query_id, r.vec_id): r.s for r in x}, abs=1e-6) and got[0, 1] == 0.0 and got[0, 3] == 1.0


def test_rrf_weighted_and_pass_through(spark):
    mk = lambda d: R.top(spark.createDataFrame([("q", k, float(v)) for k, v in d.items()], "query_id string, chunk_id string, score double"), 9, "chunk_id")
    get = lambda *a, **k: {r.chunk_id: r.fused for r in R.fuse(*a, **k).collect()}
    rrf = get(mk({"a": 3, "b": 2, "c": 1}), mk({"b": 3, "a": 2, "d": 1}))
    assert rrf["a"] == rrf["b"] == round(0.5 / 61 + 0.5 / 62, 6) and rrf["c"] == rrf["d"] == round(0.5 / 63, 6)
    w = get(mk({"a": 10, "b": 0}), mk({"a": 0, "b": 5}), method="weighted")
    assert w == {"a": 0.5, "b": 0.5}
    assert get(mk({"a": 7, "b": 7}), mk({"a": 1}), method="weighted") == {"a": 1.0, "b": 0.5}
    assert get(mk({"a": 1}).limit(0), mk({"a": 5, "b": 2})) == {"a": 5.0, "b": 2.0}
    with pytest.raises(ValueError):
        R.fuse(mk({"a": 1}), mk({"a": 1}), method="other")


def test_filters(spark):
    d = spark.createDataFrame([("1A", "2023"), ("7", "2024")], "item_number string, fiscal_year string")
    assert d.filter(R.metadata_filter({"item_number": ["1A", "3"], "fiscal_year": 2023})).count() == 1
    with pytest.raises(ValueError):
        R.metadata_filter({"colour": "red"})


def test_hybrid_ranks_and_rerank(lists):
    docs, q, dense, bm = lists
    h = R.hybrid(R.top(dense, 40, "chunk_id"), R.top(bm, 40, "chunk_id"), top_k=3)
    ranks = {}
    for r in h.collect():
        ranks.setdefault(r.query_id, []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())
    best = R.rerank(h, q, docs, 1, 3).filter("query_id = 'q1'").first()
    assert best.chunk_id == "a" and best.rerank == 1.0


def test_catalog_keeps_the_first_delivery(spark):
    d = spark.createDataFrame([("x", 2, "t"), ("x", 1, "t"), ("y", 3, "u")], "chunk_id string, ord long, text string")
    assert sorted((r.chunk_id, r.ord) for r in R.catalog(d).collect()) == [("x", 1), ("y", 3)]


# ---- metrics ---------------------------------------------------------------------------------------------------------


def test_ranking_metrics(spark):
    rows = [(["a", "b", "a", "c"], ["a", "c"], 3), (["x"], ["a"], 3), ([], ["a"], 3), (["a"], [], 3)]
    d = spark.createDataFrame(rows, "v array<string>, g array<string>, k int")
    v, g = F.col("v"), F.col("g")
    got = d.select(E.recall_at_k(v, g, 3), E.precision_at_k(v, g, 3), E.reciprocal_rank(v, g), E.average_precision(v, g, 4)).collect()
    assert tuple(got[0]) == pytest.approx((0.5, 2 / 3, 1.0, (1 + 2 / 3 + 3 / 4) / 2))
    assert [tuple(r) for r in got[1:]] == [(0.0,) * 4] * 3


def test_nearest_rank_rounds_halves_to_even(spark):
    d = spark.createDataFrame([(float(x),) for x in (5, 1, 4, 2, 3, 6)], "v double")
    assert E.nearest_rank(d, "v", 50).first().v == 3.0  # 2.5 rounds to 2
    assert E.nearest_rank(d, "v", 95).first().v == 6.0


def test_snapshot(spark):
    mk = lambda d: spark.createDataFrame(list(d.items()), "metric string, value double")
    r = {x.metric: x.status for x in E.snapshot_diff(mk({"mrr": 0.7, "hallucination_rate": 0.3, "new": 1.0, "map@k": 0.5}), mk({"mrr": 0.9, "hallucination_rate": 0.1, "old": 1.0, "map@k": 0.505})).collect()}
    assert r == {"mrr": "regression", "hallucination_rate": "regression", "new": "added", "old": "removed", "map@k": "ok"}


def test_weight_sweep_and_enforcement(spark):
    mk = lambda rows: spark.createDataFrame(rows, "query_id string, chunk_id string, score double")
    s = E.weight_sweep(mk([("q", "a", 1.0), ("q", "b", 0.0)]), mk([("q", "b", 1.0), ("q", "a", 0.0)]), spark.createDataFrame([("q", "b")], "query_id string, chunk_id string"), 0.25, 1).collect()
    assert [r.lexical_weight for r in s if r.best] == [0.75] and len(s) == 5
    cases = spark.createDataFrame([("c", "t", ["x", "y"], ["1A"]), ("all", None, ["x", "y"], []), ("none", "U", ["x"], ["1A"])], "case_id string, ticker string, expected_signals array<string>, expected_items array<string>")
    found = spark.createDataFrame([("T", "x"), ("V", "y")], "ticker string, signal_type string")
    rows = E.enforcement(cases, found, spark.createDataFrame([("z", "1A"), ("none", "1A")], "case_id string, item_number string"))
    assert {r.case_id: (r.signal_recall, r.evidence_recall) for r in rows.collect()} == {"c": (0.5, 0.0), "all": (1.0, 0.0), "none": (0.0, 1.0)}
    assert tuple(E.enforcement_means(rows).first()) == (3, 0.5, round(1 / 3, 6)) and tuple(E.enforcement_means(rows.limit(0)).first()) == (0, 0.0, 0.0)


def test_scans_agree_with_the_postings(lists):
    docs, q, dense, bm = lists
    for got, all_scores in ((S.best_by_words(docs, q, 3), bm), (S.best_by_hash(docs, q, 3, dim=64), dense)):
        want = R.top(all_scores, 3, "chunk_id")
        assert sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in got.collect()) == sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in want.collect())


def test_scan_blocks_groups_ties_and_nulls(spark, monkeypatch):
    docs = spark.createDataFrame([(f"c{k}", t, g) for k, (t, g) in enumerate([("kiln", "A"), ("kiln", "B"), ("kiln", "A"), ("pump", None), (None, "A"), ("", "B")])], "chunk_id string, text string, ticker string").withColumns({"score": F.lit(1), "rank": F.lit(1)})
    q = spark.createDataFrame([("a", "kiln", "A"), ("b", "kiln", None), ("c", "", None), ("d", None, "A"), ("e", "pump", "A")], "query_id string, text string, ticker string")
    got = lambda **k: {(r.query_id, r.chunk_id) for r in S.best_by_words(docs, q, 2, **k).collect()}
    assert got(group="ticker") == {("a", "c0"), ("a", "c2"), ("b", "c0"), ("b", "c1")}
    assert got() == {("a", "c0"), ("a", "c1"), ("b", "c0"), ("b", "c1"), ("e", "c3")}
    monkeypatch.setattr(S, "QUERIES", 1)
    assert got() == {("a", "c0"), ("a", "c1"), ("b", "c0"), ("b", "c1"), ("e", "c3")}
    assert S.best_by_words(docs.limit(0), q, 2).count() == 0 and S.best_by_words(docs, q.limit(0), 2).count() == 0 and S.best_by_hash(docs, q.limit(0), 2).count() == 0


def test_one_row_per_key(spark, monkeypatch):
    d = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z"), (None, 7, "u"), (None, 6, "v")], "k string, o int, v string")
    want = [("a", 1, "y"), ("b", 5, "z"), (None, 6, "v")]
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(repeats.one_per_key(d, "k", "o")) == sorted(want, key=str)
    assert rows(repeats.one_per_key(d, "k", "o", ["v"], last=True)) == sorted([("a", 2, "x"), ("b", 5, "z"), (None, 7, "u")], key=str)
    ties = d.unionByName(spark.createDataFrame([("a", 1, "w"), ("b", None, "q")], "k string, o int, v string"))
    assert {r.k: r.v for r in repeats.one_per_key(ties, "k", "o").collect()} == {"a": "w", "b": "q", None: "v"}
    monkeypatch.setattr(repeats, "FEW", 0)
    assert rows(repeats.one_per_key(d, "k", "o")) == sorted(want, key=str) and repeats.one_per_key(d.limit(0), "k", "o").count() == 0


def test_packed_postings_agree_with_rows(spark, lists, monkeypatch):
    """Several blocks, ties, null keys and texts, keys that aren't strings, repeated words, and queries in more than one scan."""
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    texts = [*DOCS.values(), None, "Risk\u212aapital risk", "supply supply", "the " * 300 + "kiln"] * 4
    numbered = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "chunk_id long, text string").repartition(3)
    named = numbered.withColumn("chunk_id", F.when(F.col("chunk_id") != 7, F.concat(F.lit("c"), "chunk_id")))
    q = spark.createDataFrame([*QUERIES.items(), ("q4", "the kiln of sand"), ("q5", None), (None, "Supply of risk")], "query_id string, text string")
    monkeypatch.setattr(P, "BLOCK", 5)
    for docs in (numbered, named, numbered.limit(0)):
        posts, stats = R.postings(docs), R.corpus_stats(docs)
        p = P.pack(docs).cache()
        assert rows(P.corpus_stats(p)) == rows(stats)
        want = R.term_stats(posts, stats)
        assert rows(P.term_stats(p, stats)) == rows(want)
        assert rows(P.unpacked(p, q)) == rows(R.postings(docs, terms=R.query_terms(q)).select("term", "chunk_id", "tf", "dl"))
        best = R.top(R.bm25_scores(posts, stats, q), 3, "chunk_id").select("query_id", "chunk_id", "score", "rank")
        assert rows(P.best_by_postings(p, want, stats, q, 3)) == rows(best)
        with monkeypatch.context() as m:
            m.setattr(S, "QUERIES", 2)
            m.setattr(S, "CELLS", 0)
            assert rows(P.best_by_postings(p, want, stats, q, 3)) == rows(best)
        assert P.best_by_postings(p, want, stats, q.limit(0), 3).count() == 0


def test_stored_index_moves_no_row_per_query_and_text(spark, tmp_path):
    """A word of all questions in all texts: neither postings nor pairs are shuffled one by one."""
    from strataline.plans import catalog

    texts, questions = 3000, 60
    c = spark.range(texts).select(F.col("id").alias("ord"), F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("the kiln of the glass works "), F.col("id") % 50).alias("text"))
    c.coalesce(1).write.parquet(str(tmp_path / "chunks.parquet"))
    e = spark.range(questions).select(F.concat(F.lit("q"), "id").alias("id"), F.concat(F.lit("the glass "), "id").alias("question"), F.lit("T").alias("ticker"))
    e.coalesce(1).write.parquet(str(tmp_path / "eval_cases.parquet"))
    sc = spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    told = lambda: {(s := x.apply(k)).stageId(): s.shuffleWriteRecords() for x in [stages()] for k in range(x.size())}
    before = max(told(), default=-1)
    got = catalog.QUERIES["stored_index_topk"](spark, str(tmp_path)).collect()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert len(got) == questions * 10
    best = {r.query_id: r.chunk_id for r in got if r["rank"] == 0}
    assert best["q7"] == "c1007" and best["q59"] == "c0"  # of the texts with 7 the least key; no text has 59
    assert 0 < max(n for stage, n in told().items() if stage > before) <= 2 * texts
