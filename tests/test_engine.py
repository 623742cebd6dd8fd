import importlib
import json

import pytest
from pyspark.sql import functions as F

from strataline import config
from strataline.plans.pipeline import Pipeline
from strataline.sources import filings as S
from strataline.sources import index as I
from strataline.streaming import ingest as ST

SF = "/root/testdata/sf0.001"
TEXT = "Item 1. Business\nQuillon makes bottle glass in Hull. The furnaces run on gas all year.\n\nItem 1A. Risk Factors\nA lawsuit about a covenant may constrain future liquidity. Gas prices may rise."


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("filings")
    d = root / "10-K" / "QGL"
    d.mkdir(parents=True)
    for year in ("23", "24"):
        (d / f"QGL_0000000001-{year}-000001.txt").write_text(TEXT if year == "23" else TEXT + " A new flood risk at the harbour of Grimsby threatens our warehouses and stocks.")
    (d / "QGL_0000000001-24-000001.json").write_text(json.dumps({"schema_version": 1, "metadata": {"ticker": "QGL", "company": "Quillon plc", "source_url": "http://x", "fiscal_year": "2024"}, "sections": []}))
    (d / "QGL_0000000001-23-000001.json").write_text("{broken")
    (d / "blank.txt").write_text(" \n")
    return str(root)


def test_scan_with_sidecars(spark, folder):
    r = {x.fiscal_year: x for x in S.read_filings(spark, folder).collect()}
    assert set(r) == {"2023", "2024"} and r["2024"].company == "Quillon plc" and r["2024"].source_url == "http://x" and r["2023"].company == "UNKNOWN" and r["2023"].ticker == "QGL"
    assert S.read_filings(spark, folder, max_files=1).count() == 1
    with pytest.raises(Exception):
        S.read_filings(spark, folder + "/nowhere").count()


def test_pipeline(spark, folder, tmp_path):
    p = Pipeline(spark, config.load(env={"STRATALINE_CHUNKING__MIN_CHARS": "20"}))
    p.build_index(str(tmp_path / "index"), folder)
    q = spark.createDataFrame([("q1", "Where does Quillon make glass?"), ("q2", "xylophone")], "query_id string, text string")
    a = {r.query_id: r for r in p.ask(q).collect()}
    assert not a["q1"].abstained and "Hull" in a["q1"].answer and a["q1"].groundedness == 1.0
    assert a["q2"].abstained
    assert {r.item_number for r in p.retrieve(q, {"item_number": "1A"}).join(p.tables["chunks"], "chunk_id").collect()} == {"1A"}
    assert p.extract(q.filter("query_id = 'q1'"), "risk_factors").first().valid
    m = p.monitor("2023", "2024").first()
    assert m.new_risk_factors == 1 and m.signals == 2 and not m.going_concern
    with pytest.raises(ValueError):
        I.read_index(spark, str(tmp_path / "index"), I.VectorSpace(dim=64))
    with pytest.raises(ValueError):
        Pipeline(spark, answerer="none")


def test_settings_hooks_and_log(spark, folder, tmp_path, monkeypatch):
    from strataline.plans import pipeline as P

    said = lambda queries, context: queries.select("query_id", F.lit("Quillon makes bottle glass in Hull. [1]").alias("answer"))
    monkeypatch.setitem(P.ANSWERERS, "own", said)
    c = config.overlaid(config.load(env={}), {"chunking": {"min_chars": 20}, "audit": {"path": str(tmp_path / "log")}})
    p = Pipeline(spark, c, answerer="own")
    p.build_index(str(tmp_path / "index"), folder)
    q = spark.createDataFrame([("q1", "Where does Quillon make glass?")], "query_id string, text string")
    r = p.ask(q).first()
    assert r.answer == "Quillon makes bottle glass in Hull. [1]" and r.n_citations == 1 and not r.abstained
    p.extract(q, "risk_factors")
    assert {x.event for x in spark.read.json(str(tmp_path / "log")).collect()} == {"answer", "extraction"}
    for key, value, reason in (("min_evidence_score", 2.0, "insufficient retrieval evidence"), ("min_citations", 3, "too few grounded citations"), ("abstain_below_confidence", 1.1, "low confidence")):
        own = Pipeline(spark, config.overlaid(c, {"generation": {key: value}, "audit": {"path": ""}}), answerer="own")
        own.load_index(str(tmp_path / "index"))
        assert own.ask(q).first().abstain_reason == reason


def test_extraction_falls_back_without_its_item(spark, folder, tmp_path):
    p = Pipeline(spark, config.load(env={"STRATALINE_CHUNKING__MIN_CHARS": "20"}))
    p.build_index(str(tmp_path / "index"), folder)
    q = spark.createDataFrame([("q1", "glass furnaces gas lawsuit")], "query_id string, text string")
    risk = p.extract(q, "risk_factors").first()
    assert {r.risk for r in risk.data.risk_factors} <= set(TEXT.split("\n")[-1].replace(". ", ".|").split("|")) | {"A new flood risk at the harbour of Grimsby threatens our warehouses and stocks."} | {"Item 1A.", "Risk Factors\nA lawsuit about a covenant may constrain future liquidity."}
    assert p.extract(q, "litigation").first().valid  # no item 3 there


def test_evaluate_and_command_line(spark, folder, tmp_path, capsys):
    from strataline import cli

    cases = [{"id": "c1", "question": "Where does Quillon make glass?", "relevant_items": ["1"], "ticker": "qgl"}, {"id": "c2", "question": "lawsuit covenant", "relevant_passages": ["a lawsuit about a covenant may constrain"]}, {"id": "c3", "question": "xylophone", "answerable": False}]
    (tmp_path / "cases.json").write_text(json.dumps(cases))
    (tmp_path / "enforce.json").write_text(json.dumps([{"id": "e1", "description": "covenant lawsuit", "expected_signals": ["litigation", "liquidity"], "expected_items": ["1A"]}, {"id": "e2", "description": "x", "ticker": "NONE", "expected_signals": ["litigation"], "expected_items": []}]))
    (tmp_path / "c.json").write_text(json.dumps({"chunking": {"min_chars": 20}}))
    run = lambda *a: cli.main(["--config", str(tmp_path / "c.json"), "--index", str(tmp_path / "index"), *a])
    run("index", folder)
    assert run("evaluate", str(tmp_path / "cases.json"), "--save-baseline", str(tmp_path / "base")) == 0
    m = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert m["n_cases"] == 3 and m["recall_at_k"] == round(2 / 3, 6) and m["abstention_recall"] == 1.0 and m["hallucination_rate"] == 0.0 and m["citation_correctness"] > 0 and m["lexical_groundedness"] == 1.0 and m["p95_latency_ms"] > 0
    assert run("--text", "evaluate", str(tmp_path / "cases.json"), "--baseline", str(tmp_path / "base")) == 0
    assert "ok         mrr" in capsys.readouterr().out
    run("enforce", str(tmp_path / "enforce.json"))
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"n_cases": 2, "signal_recall": 0.5, "evidence_retrieval_recall": 0.5}
    run("--text", "compare", "qgl", "2023", "2024", "--items", "1a")
    assert "+ Gas prices may rise. A new flood risk" in capsys.readouterr().out
    run("ask", "Where does Quillon make glass?", "--ticker", "QGL")
    assert "Hull" in capsys.readouterr().out


def test_demo_from_the_command_line(tmp_path, capsys, spark):
    from strataline import cli

    (tmp_path / "c.json").write_text(json.dumps({"chunking": {"min_chars": 20}}))
    assert cli.main(["--config", str(tmp_path / "c.json"), "--index", str(tmp_path / "i"), "demo"]) == 0
    out = capsys.readouterr().out
    assert "d7: No answer" in out and "bottles and jars" in out and "n_cases                  7" in out and "going_concern" in out


def test_model_judges_are_reachable(spark, folder, tmp_path, monkeypatch):
    from strataline.operators import verification as V
    from strataline.plans import pipeline as P

    reply = json.dumps({"claims": [{"claim": "Quillon makes bottle glass in Hull.", "verdict": "supported", "citation": "1", "quote": "Quillon makes bottle glass in Hull."}, {"claim": "x", "verdict": "maybe", "citation": "99"}]})
    monkeypatch.setitem(P.JUDGES, "reply", V.model_judge(lambda answers, evidence: answers.select("answer_id", F.lit(f"Here: {reply}").alias("reply"))))
    p = Pipeline(spark, config.load(env={"STRATALINE_CHUNKING__MIN_CHARS": "20", "STRATALINE_VERIFICATION__REPAIR": "false"}), judge="reply")
    p.build_index(str(tmp_path / "index"), folder)
    r = p.ask(spark.createDataFrame([("q1", "Where does Quillon make glass?")], "query_id string, text string")).first()
    assert r.groundedness == 0.5 and r.abstain_reason == "insufficient grounding"


def test_metadata_round_trip(spark):
    f = spark.createDataFrame([("T", 7)], "ticker string, cik int")
    back = S.from_metadata_json(S.metadata_json(f).select(F.regexp_replace("metadata", r"\{", '{"extra": "x", ').alias("metadata"))).first()
    assert back.ticker == "T" and back.cik == "7" and back.company == "UNKNOWN" and back.source_url == ""


def test_selected_filings_provenance_sidecars_and_checkpoint(spark, tmp_path):
    cols = "ticker string, company string, cik string, filing_type string, filing_date string, fiscal_year string, accession string, source_url string, source_path string, text string"
    f = spark.createDataFrame([("T", "C", "7", t, d, "2022", a, "", "p", TEXT) for t, d, a in (("10-K", "2022-03-01", "a1"), ("10-K", "2023", "a2"), ("10-Q", "2023-05-01", "a3"), ("10-K", "2021-03-01", "a4"))], cols)
    one = lambda **k: S.select_filings(f, ["10-K", "10-Q"], **k).first().accession
    assert one() == "a1" and one(year=2023) == "a3" and one(end="2021-12-31") == "a4" and one(start="2022-03-01", end="2022-03-01") == "a1"
    raw = spark.createDataFrame([("T", None, 7, "10-K", "2023-02-01", "2022-12-31", "1-2-3", None, "p"), ("U", "U Inc", None, None, None, None, None, None, None)], "ticker string, company string, cik int, form string, filing_date string, period string, accession string, source_url string, source_path string")
    r = {x.ticker: x for x in S.provenance(raw).collect()}
    assert r["T"].fiscal_year == "2022" and r["T"].company == "T" and r["T"].source_url.endswith("/7/123/1-2-3-index.htm") and r["U"].fiscal_year == r["U"].filing_date == "UNKNOWN" and r["U"].source_url == ""
    S.write_sidecars(f.limit(1), str(tmp_path / "cars"))
    car = spark.read.schema(S.SIDECAR).json(str(tmp_path / "cars")).first()
    assert car.metadata.ticker == "T" and [s.item_number for s in car.sections] == ["1", "1A"]
    ck = S.Checkpoint(spark, str(tmp_path / "ck"))
    assert ck.done().count() == 0
    ck.mark(f)
    ck.mark(f)
    assert ck.done().count() == 4 and sum(x.n for x in ck.counts().collect()) == 4
    ck.clear()
    assert ck.done().count() == 0


def test_review_sheet_and_settings_files(spark, tmp_path):
    a = spark.createDataFrame([("q1", "why?", None), ("q2", "how?", "so")], "query_id string, question string, gold string")
    I.write_review(I.review_sheet(a, 5), str(tmp_path / "r"))
    assert "correctness" in spark.read.json(str(tmp_path / "r/json")).columns and "## q2" in "\n".join(x.value for x in spark.read.text(str(tmp_path / "r/text")).collect())
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("retrieval:\n  top_k: 3\n")
    assert config.load(str(tmp_path / "s.yaml"), env={}).retrieval.top_k == 3


def test_years_are_compared_by_annual_reports(spark):
    risk = [f"{w} " * 16 + f"{w}." for w in ("kilns", "cranes", "ports")]
    rows = [("2023", "a", "2023-03-01", "10-K", risk[0]), ("2024", "b", "2024-03-01", "10-K", risk[1]), ("2024", "c", "2024-11-01", "8-K", risk[2]), ("2024", "d", "2024-12-01", "10-K/A", risk[2])]
    p = Pipeline(spark)
    p.tables = {"chunks": spark.createDataFrame([(f"c{k}", k, "T", "1A", y, x, 0, f, d, a, "Title") for k, (y, a, d, f, x) in enumerate(rows)], "chunk_id string, ord int, ticker string, item_number string, fiscal_year string, text string, char_start int, filing_type string, filing_date string, accession string, section_title string")}
    r = p.compare_years("2023", "2024").first()
    assert list(r.added) == [risk[1]] and list(r.removed) == [risk[0]]
    for forms in (None, ["10-K", "10-Q", "8-K"], ["8-K"]):
        m = p.monitor("2023", "2024", forms).first()
        assert (m.new_risk_factors, m.removed_risk_factors) == (1, 1)


def test_floor_above_one_abstains(spark, folder, tmp_path):
    c = config.overlaid(config.load(env={}), {"verification": {"groundedness_floor": 1.01}, "chunking": {"min_chars": 20}})
    p = Pipeline(spark, c)
    p.build_index(str(tmp_path / "index"), folder)
    r = p.ask(spark.createDataFrame([("q1", "Where does Quillon make glass?")], "query_id string, text string")).first()
    assert r.abstained and r.abstain_reason == "insufficient grounding"


def test_upsert_and_stores(spark, tmp_path):
    mk = lambda rows: spark.createDataFrame(rows, "chunk_id string, ord long, text string")
    u = I.upsert(mk([("a", 1, "old"), ("b", 2, "keep")]), mk([("a", 3, "new"), ("a", 4, "newer")]))
    assert {(r.chunk_id, r.text) for r in u.collect()} == {("a", "newer"), ("b", "keep")}
    m = spark.createDataFrame([("mrr", 0.5), ("mean_latency_ms", 3.0)], "metric string, value double")
    I.save_baseline(m, str(tmp_path / "b"))
    assert [r.metric for r in I.load_baseline(spark, str(tmp_path / "b")).collect()] == ["mrr"] and I.load_baseline(spark, str(tmp_path / "none")) is None
    for _ in range(2):
        I.append_audit(spark, str(tmp_path / "audit"), "answer", m)
    assert spark.read.json(str(tmp_path / "audit")).count() == 4
    assert I.review_sheet(m.select(F.col("metric").alias("query_id")), 1).count() == 1


def test_small_sources(spark, tmp_path):
    assert S.year_range(["2021-2023", "2025"]) == [2021, 2022, 2023, 2025]
    done = spark.createDataFrame([("AB", "10-K", "2021")], "ticker string, filing_type string, fiscal_year string")
    assert S.work_list(spark, ["ab", "cd"], ["10-K"], [2021], done).count() == 1
    page = spark.createDataFrame([('<table id="t"><tr><td><a>AB</a></td><td>1</td></tr><tr><td>CD</td></tr></table>',), (None,)], "html string")
    assert [r.cells for r in S.html_first_column(page, "t").collect()] == [["AB", "CD"], None]
    (tmp_path / "cases.json").write_text(json.dumps([{"id": "c1", "question": "q"}]))
    c = S.read_cases(spark, str(tmp_path / "cases.json")).first()
    assert c.answerable and c.relevant_items == []


def test_stream_equals_batch(spark, tmp_path):
    f = spark.read.parquet(f"{SF}/filings.parquet").limit(20)
    f.repartition(3).write.parquet(str(tmp_path / "in"))
    s = ST.stream_filings(spark, str(tmp_path / "in"), f.schema, 1)
    ST.ingest(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = ST.upserted(spark, str(tmp_path / "out"))
    from strataline.operators.chunking import chunk_filings

    want = chunk_filings(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(r.chunk_id for r in got.collect()) == sorted(r.chunk_id for r in want.collect())
    e = spark.read.parquet(f"{SF}/events.parquet")
    assert ST.windowed_events(e).agg(F.sum("n")).first()[0] == e.count()


def test_rate_limit(spark):
    r = spark.createDataFrame([(1, "c", 0.0), (2, "c", 0.0), (3, "c", 0.1), (4, "c", 9.0)], "request_id int, client string, ts double")
    assert [x.start for x in ST.admitted(r, 8.0).orderBy("request_id").collect()] == [0.0, 0.125, 0.25, 9.0]


def test_config():
    c = config.load(env={"STRATALINE_RETRIEVAL__TOP_K": "5", "STRATALINE_VERIFICATION__REPAIR": "false", "OTHER": "1"})
    assert c.retrieval.top_k == 5 and c.verification.repair is False and config.coerced("0.5") == 0.5
    with pytest.raises(ValueError):
        config.overlaid(c, {"colour": {}})


def test_entry(spark):
    e = importlib.import_module("__spark_entry__")
    assert e.entry(spark).columns == ["query_id", "chunk_id", "score", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
