"""Command line: index, ask, extract, compare, monitor, evaluate and enforce."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import functions as F

from strataline.config import load
from strataline.operators import evaluation
from strataline.plans import demo, render
from strataline.plans.pipeline import COMPARED, Pipeline
from strataline.session import get_session
from strataline.sources import filings
from strataline.sources import index as store

_LOG = logging.getLogger("strataline")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strataline")
    p.add_argument("--config")
    p.add_argument("--index", required=True, help="folder of the index")
    p.add_argument("--log-level")
    p.add_argument("--text", action="store_true", help="print text instead of JSON lines")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index")
    a.add_argument("dirs", nargs="+")
    a.add_argument("--max-files", type=int)
    for name in ("ask", "extract"):
        a = sub.add_parser(name)
        a.add_argument("what", help="a question, or the name of a target")
        a.add_argument("--ticker")
        a.add_argument("--item", action="append")
        a.add_argument("--form", action="append")
        a.add_argument("--top-k", type=int)
    for name in ("compare", "monitor"):
        a = sub.add_parser(name)
        a.add_argument("ticker")
        a.add_argument("year_a")
        a.add_argument("year_b")
        a.add_argument("--form", action="append")
        a.add_argument("--items", action="append") if name == "compare" else a.add_argument("--compare-form", default=COMPARED)
    a = sub.add_parser("evaluate")
    a.add_argument("cases", help="JSON file")
    a.add_argument("-k", type=int)
    a.add_argument("--retrieval-only", action="store_true")
    a.add_argument("--baseline", help="folder of saved metrics to compare with")
    a.add_argument("--save-baseline", help="folder to save the metrics in")
    sub.add_parser("demo", help="index the made-up corpus and measure its cases")
    a = sub.add_parser("enforce")
    a.add_argument("cases", help="JSON file")
    a.add_argument("-k", type=int)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = get_session()
    pipe = Pipeline(spark, load(args.config))
    if args.log_level:
        logging.basicConfig(level=args.log_level.upper(), format="%(asctime)s %(levelname)s %(name)s %(message)s")
    _LOG.info("%s with index %s", args.command, args.index)
    if args.command == "demo":
        pipe.index_filings(demo.filings(spark), args.index)
        q = demo.cases(spark).select(F.col("id").alias("query_id"), F.col("question").alias("text"), "ticker", "relevant_items", "relevant_passages", "answerable")
        print("\n\n".join(f"{r.query_id}: {render.answer(r)}" for r in pipe.ask(q, hits=pipe.retrieve(q, own_ticker=True)).orderBy("query_id").collect()))
        print("\n" + render.metrics(pipe.evaluate(q)[1].first()))
        print("\n" + render.metrics(pipe.enforcement(demo.enforcement_cases(spark))[1].first()))
        print("\n" + render.metrics(pipe.monitor("2022", "2023", tickers=["QGL"]).first()))
        return 0
    if args.command == "index":
        tables = pipe.build_index(args.index, *args.dirs, max_files=args.max_files)
        print(tables["index_meta"].first().chunk_count)
        return 0
    pipe.load_index(args.index)
    if args.command in ("ask", "extract"):
        where = {k: v for k, v in (("ticker", args.ticker), ("item_number", args.item), ("filing_type", args.form)) if v}
        ask = args.command == "ask"
        q = spark.createDataFrame([("q", args.what if ask else args.what.replace("_", " "))], "query_id string, text string")
        out = pipe.ask(q, hits=pipe.retrieve(q, where or None, args.top_k)) if ask else pipe.extract(q, args.what, where, top_k=args.top_k)
        show = render.answer if ask else None
    elif args.command == "compare":
        out, show = pipe.compare_years(args.year_a, args.year_b, args.form, [args.ticker], args.items).orderBy("item_number"), render.difference
    elif args.command == "monitor":
        out, show = pipe.monitor(args.year_a, args.year_b, args.form, args.compare_form, [args.ticker]), render.metrics
    elif args.command == "evaluate":
        cases = filings.read_cases(spark, args.cases).select(F.col("id").alias("query_id"), F.col("question").alias("text"), "ticker", "relevant_items", "relevant_passages", "answerable")
        _, out = pipe.evaluate(cases, args.k, not args.retrieval_only)
        out, show = spark.createDataFrame(out.collect(), out.schema), render.metrics  # one row
        told = evaluation.as_metrics(out)
        if args.baseline:
            if (base := store.load_baseline(spark, args.baseline)) is None:
                print("no baseline", file=sys.stderr)
            else:
                diff = evaluation.snapshot_diff(told.filter(~F.col("metric").endswith("_latency_ms")), base)
                print(render.snapshot(diff))
                if not diff.filter("status = 'regression'").isEmpty():
                    return 1
        if args.save_baseline:
            store.save_baseline(told, args.save_baseline)
    else:
        cases = filings.read_enforcement_cases(spark, args.cases).withColumnRenamed("id", "case_id")
        _, out = pipe.enforcement(cases, args.k)
        show = render.metrics
    if args.text and show:
        rows = out.collect()
        print("\n\n".join(map(show, rows)))
        return 0
    lines = out.toJSON().collect()
    print("\n".join(lines))
    return 1 if args.command == "extract" and not any('"valid":true' in r for r in lines) else 0


if __name__ == "__main__":
    sys.exit(main())
