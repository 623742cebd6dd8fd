"""A small made-up corpus with cases, for demonstrations and smoke tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataline.sources.filings import CASES, META

_QUILLON = """Item 1. Business
Quillon Glass makes bottles and jars at three furnaces in Hull. It sells to breweries in nine countries.

Item 1A. Risk Factors
The furnaces run on gas, and a rise in its price would hurt margins. One brewery buys a fifth of all bottles.{more}

Item 3. Legal Proceedings
{suit}

Item 7. Management's Discussion and Analysis
Net sales were {sales} million, compared with 81 million a year before, because of higher prices for jars."""
_TREGG = """Item 1. Business
Tregg Ferries runs six ferries between Dover and the islands, and leases the quay from the county.

Item 1A. Risk Factors
Without additional financing there is substantial doubt about the ability to continue as a going concern. A covenant of the loan limits further debt.

Item 9A. Controls and Procedures
Controls over fuel purchases were not effective at the end of the year; a remediation plan has begun."""
_FILINGS = [
    ("QGL", "Quillon Glass plc", "11", "10-K", "2023-03-01", "2022", "0000000011-23-000001", _QUILLON.format(more="", suit="None.", sales="88")),
    ("QGL", "Quillon Glass plc", "11", "10-K", "2024-03-01", "2023", "0000000011-24-000001", _QUILLON.format(more=" A flood at the Humber could stop all three furnaces for months and destroy the stock of finished bottles held beside them.", suit="A former dealer has filed a lawsuit alleging that its contract was ended without cause, and seeks four million in damages.", sales="97")),
    ("TRG", "Tregg Ferries Ltd", "12", "10-K", "2024-04-01", "2023", "0000000012-24-000001", _TREGG),
]
_QUESTIONS = [
    ("d1", "What does Quillon Glass make?", ["1"], "QGL", True), ("d2", "What would hurt the margins of the furnaces?", ["1A"], "QGL", True), ("d3", "Which lawsuit did a former dealer file?", ["3"], "QGL", True), ("d4", "How large were net sales?", ["7"], "QGL", True),
    ("d5", "Is there doubt about going concern?", ["1A"], "TRG", True), ("d6", "Were controls over fuel purchases effective?", ["9A"], "TRG", True), ("d7", "xylophone zeppelin?", [], None, False),
]
_ENFORCEMENT = [
    ("e1", "going concern and covenant of the loan", ["going_concern", "liquidity"], ["1A"], "TRG"), ("e2", "lawsuit of a dealer", ["litigation"], ["3"], "QGL"), ("e3", "controls not effective", ["material_weakness"], ["9A"], None),
]


def filings(spark: SparkSession) -> DataFrame:
    rows = [(*r[:7], "", f"demo/{r[3]}/{r[0]}_{r[6]}.txt", r[7]) for r in _FILINGS]
    return spark.createDataFrame(rows, ", ".join(f"{m} string" for m in (*META, "text")))


def cases(spark: SparkSession) -> DataFrame:
    rows = [(i, q, items, [], t, ok, None, None, "demo", None) for i, q, items, t, ok in _QUESTIONS]
    return spark.createDataFrame(rows, CASES)


def enforcement_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_ENFORCEMENT, "case_id string, description string, expected_signals array<string>, expected_items array<string>, ticker string")
