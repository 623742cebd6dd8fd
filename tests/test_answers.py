import random

import pytest
from pyspark.sql import functions as F

from strataline.functions import text as T
from strataline.operators import comparison as D
from strataline.operators import extraction as X
from strataline.operators import generation as G
from strataline.operators import signals as S
from strataline.operators import verification as V
from strataline.plans import catalog


@pytest.mark.parametrize(
    "claim, evidence, expected",
    [
        ("Debt fell to $1.5 billion.", "(in millions) debt 1,500", True), ("Debt fell to $1.5 billion.", "debt of $2.5 billion", False), ("Margin was 14%.", "a margin of 14.0 percent", True),
        ("Margin was 14%.", "a margin of 14", False), ("No figure at all.", "anything", True), ("It cost $5.", "no figure", False), ("50 bps", "50%", True), ("1.58bn", "1,577 million", True), ("zero 0", "0", True),
    ],
)
def test_figures(spark, claim, evidence, expected):
    d = spark.createDataFrame([(claim, evidence)], "c string, e string")
    assert d.select(T.figures_supported(F.col("c"), F.col("e"))).first()[0] is expected


def test_quote(spark):
    d = spark.createDataFrame([("a  b\nc", "a b c"), ("abc", "abd"), ("abc", ""), ("abc", None), (None, "x")], "t string, q string")
    assert [r[0] for r in d.select(T.contains_quote(F.col("t"), F.col("q"))).collect()] == [True, False, False, False, False]


def test_every_citation_is_judged(spark, tmp_path):
    chunks = [("c1", 1, "Sales\u00a0rose to \u201cten\u201d in M\u00fcnchen\u2003last year."), ("c2", 2, "plain text")]
    cited = [("q1", "c1", "rose to \u201cten\u201d in"), ("q2", "c1", "Sales rose\u202fto"), ("q3", "c1", "M\u00fcnchen  this"), ("q4", "c2", "plain\ntext"), ("q5", "c2", "\u00a0"), ("q6", "gone", "plain"), ("q7", "c2", None)]
    spark.createDataFrame(chunks, "chunk_id string, ord int, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame(cited, "citation_id string, chunk_id string, quote string").write.parquet(str(tmp_path / "citations.parquet"))
    got = {r.citation_id: r.in_chunk for r in catalog.QUERIES["quote_in_source"](spark, str(tmp_path)).collect()}
    plain = lambda x: " ".join((x or "").split())
    assert got == {k: bool(plain(q)) and plain(q) in plain(dict((i, t) for i, _, t in chunks).get(c)) for k, c, q in cited}


@pytest.fixture(scope="module")
def judged(spark):
    answers = spark.createDataFrame([("x", "Kilns in Hull produced glass worth 40 million. Penguins migrate southwards yearly. [1]"), ("y", "Sales were 9 million in Hull stores."), ("z", None)], "answer_id string, text string")
    ev = spark.createDataFrame([("x", 1, "c1", "Kilns in Hull produced glass worth 40 million. Other words."), ("x", 2, "c2", "Unrelated."), ("y", 1, "c3", "Sales were 7 million in Hull stores.")], "answer_id string, n int, chunk_id string, text string")
    return V.judge(answers, ev)


def test_judge_and_checks(judged):
    r = {(x.answer_id, x.claim_no): x for x in V.checked(judged).collect()}
    assert r["x", 0].verdict == "SUPPORTED" and r["x", 0].citation == 1 and r["x", 0].quote.startswith("Kilns")
    assert r["x", 1].verdict == "UNSUPPORTED" and r["x", 1].citation is None
    assert r["y", 0].valid_quote and not r["y", 0].numeric_ok and r["y", 0].verdict == "UNSUPPORTED"
    assert not any(k[0] == "z" for k in r)


def test_report_gate_and_best(judged):
    rep = {x.answer_id: x for x in V.report(judged).withColumn("f", V.fails_gate()).collect()}
    assert rep["x"].total == 2 and rep["x"].groundedness == 0.5 and rep["x"].f
    assert not {x.answer_id: x for x in V.report(judged).withColumn("f", V.fails_gate(0.5)).collect()}["x"].f
    assert {(x.answer_id, x.chunk_id, x.verdict) for x in V.best_verdicts(judged).collect()} >= {("x", "c1", "SUPPORTED")}
    with pytest.raises(ValueError):
        V.independent("m", "m")


def test_model_claims(spark):
    reply = 'Sure: {"claims": [{"claim": "a", "verdict": "supported", "citation": 2}, {"claim": "b", "verdict": "odd", "citation": 9}]} done'
    d = spark.createDataFrame([("x", reply), ("y", "no json")], "answer_id string, reply string")
    assert [(r.claim, r.verdict, r.citation) for r in V.parsed_claims(d, F.lit(3)).orderBy("claim_no").collect()] == [("a", "SUPPORTED", 2), ("b", "UNSUPPORTED", None)]


def test_answers_and_gates(spark):
    q = spark.createDataFrame([("q1", "What does the kiln in Hull make?"), ("q2", "zebra"), ("q3", "kiln")], "query_id string, text string")
    rows = [("q1", 1, "c1", "The kiln in Hull makes glass. It rains.", 0.4, 2.0, 0.02), ("q1", 2, "c2", "The kiln in Hull makes glass. A kiln is hot.", None, 1.0, 0.01), ("q2", 1, "c1", "The kiln.", 0.4, 2.0, 0.02)]
    c = spark.createDataFrame(rows, "query_id string, n int, chunk_id string, text string, dense double, bm25 double, fused double")
    a = {r.query_id: r for r in G.answer(q, c).collect()}
    assert a["q1"].answer.startswith("The kiln in Hull makes glass.") and a["q1"].answer.count("makes glass") == 1 and not a["q1"].abstained
    assert a["q2"].abstain_reason == "model reported insufficient evidence" and a["q3"].abstain_reason == "insufficient retrieval evidence"
    assert a["q1"].confidence == pytest.approx(0.5 + 0.3 + 0.1)
    assert [r[0] for r in spark.createDataFrame([("x [3] [1] [9] [3]",), ("none",)], "t string").select(G.cited_numbers(F.col("t"), F.lit(4))).collect()] == [[3, 1], [1]]


def test_extraction(spark):
    d = spark.createDataFrame([("a", "One. Two. Three. Four."), ("b", "")], "query_id string, t string")
    r = {x.query_id: x for x in X.validated(d.select("query_id", X.instance(F.col("t"), "litigation").alias("reply")), "litigation").collect()}
    assert r["a"].valid and [e.matter for e in r["a"].data.litigation] == ["One.", "Two.", "Three."] and r["b"].valid
    bad = spark.createDataFrame([('```json\n{"litigation": [{"matter": "m"}]}\n```',), ("{}",), ("text",)], "reply string")
    assert [x.error for x in X.validated(bad, "litigation").collect()] == ["missing required fields", "missing litigation", "no JSON"]
    with pytest.raises(KeyError):
        X.target("weather")


def test_signals(spark):
    d = spark.createDataFrame([("c1", "A Breach of COVENANT may occur; we fear litigation."), ("c2", None), ("c3", "calm")], "chunk_id string, text string")
    r = {(x.chunk_id, x.signal_type): x for x in S.detect(d).collect()}
    assert set(r) == {("c1", "liquidity"), ("c1", "litigation")} and r["c1", "liquidity"].phrase == "covenant" and "COVENANT" in r["c1", "liquidity"].snippet


def test_alignment_is_greedy_in_order_of_b():
    a = [{"x", "y", "z"}, {"x", "y", "w"}]
    b = [{"x", "y", "w"}, {"x", "y", "w", "v"}, {"q"}]
    assert D.align(a, b) == ([2], [(0, 1)], [])
    assert D.align([set()], []) == ([], [], [0]) and D.align([], [{"k"}]) == ([0], [], [])


def test_year_comparison(spark):
    unit = "The kiln in Hull was shut for repair during the whole of the month of May and nobody worked there at all."
    new = "A wholly different disclosure about ports, pilots, harbours, tides, cranes, containers and the weather in winter."
    rows = [("t", "1A", "2022", unit, 0), ("T", "1A", "2023", unit, 0), ("T", "1A", "2023", new, 900), ("T", "3", "2022", unit, 0), ("T", "UNKNOWN", "2023", unit, 0)]
    c = spark.createDataFrame([(f"c{k}", k, t, i, y, x, s, "10-K", f"{y}-03-01", f"acc{y}", "Title") for k, (t, i, y, x, s) in enumerate(rows)], "chunk_id string, ord int, ticker string, item_number string, fiscal_year string, text string, char_start int, filing_type string, filing_date string, accession string, section_title string")
    r = {x.item_number: x for x in D.compare_years(c).collect()}
    assert set(r) == {"1A", "3"} and list(r["1A"].added) == [new] and not r["1A"].changed and list(r["3"].removed) == [unit] and r["3"].similarity == 0.0
    s = D.summary(D.compare_years(c), "ticker").first()
    assert (s.sections_compared, s.added, s.removed, s.changed) == (2, 1, 1, 0)


def test_year_comparison_takes_all_filings(spark):
    units = [f"{w} " * 16 + f"{w}." for w in ("kilns", "harbours", "cranes")]
    rows = [("2022", "a1", "2022-03-01", units[0], 0), ("2022", "a2", "2022-09-01", units[1], 0), ("2023", "b1", "2023-03-01", units[2], 0), ("2023", "b2", "2023-09-01", units[1], 0)]
    c = spark.createDataFrame([(f"c{k}", k, "T", "1A", y, x, s, "10-K", d, f, "Title") for k, (y, f, d, x, s) in enumerate(rows)], "chunk_id string, ord int, ticker string, item_number string, fiscal_year string, text string, char_start int, filing_type string, filing_date string, accession string, section_title string")
    r = D.compare_years(c).first()
    assert list(r.added) == [units[2]] and list(r.removed) == [units[0]] and not r.changed
    one = D.compare_years(c, one_filing=True).first()
    assert not one.added and not one.removed


def test_alignment_equals_comparing_every_pair():
    r = random.Random(5)
    for _ in range(500):
        a, b = ([set(r.sample("abcdefgh", r.randint(0, 6))) for _ in range(r.randint(0, 9))] for _ in "ab")
        free, added, changed = list(range(len(a))), [], []
        for j, tb in enumerate(b):
            s = {i: len(a[i] & tb) / len(a[i] | tb) if a[i] | tb else 1.0 for i in free}
            best = max(free, key=lambda i: (s[i], -i), default=-1)
            if best < 0 or s[best] < D.CHANGED:
                added.append(j)
                continue
            free.remove(best)
            if s[best] < D.SAME:
                changed.append((best, j))
        assert D.align(a, b) == (added, changed, free)
