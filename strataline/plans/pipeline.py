"""The engine as one object: build or load an index, then ask, extract, compare and monitor over tables of queries."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.config import Config
from strataline.operators import chunking, comparison, evaluation, extraction, generation, packed, retrieval, signals, verification
from strataline.session import cut_lineage
from strataline.sources import index as store
from strataline.sources.filings import read_filings

#: Pluggable models by name: an embedder maps (texts, key, dim, mode) to (key, idx, w), an answerer (queries, context) to (query_id, answer), a judge (answers, evidence) to claims.
EMBEDDERS: dict[str, Callable[..., DataFrame]] = {"hashing": retrieval.hash_embedding}
ANSWERERS: dict[str, Callable[..., DataFrame]] = {"extractive": generation.extract}
JUDGES: dict[str, Callable[..., DataFrame]] = {"lexical": verification.judge}

#: The form that years are compared by.
COMPARED = "10-K"


class Pipeline:
    def __init__(self, spark: SparkSession, config: Config | None = None, answerer: str = "extractive", judge: str = "lexical"):
        for name, known in ((answerer, ANSWERERS), (judge, JUDGES)):
            if name not in known:
                raise ValueError(f"unknown model {name!r}; known are {sorted(known)}")
        self.spark, self.config = spark, config or Config()
        if self.config.embedding.backend not in EMBEDDERS:
            raise ValueError(f"unknown embedder {self.config.embedding.backend!r}")
        verification.independent(judge, answerer)
        self.embed, self.answerer, self.judge = EMBEDDERS[self.config.embedding.backend], ANSWERERS[answerer], JUDGES[judge]
        self.info = store.VectorSpace(self.config.embedding.backend, self.config.embedding.dim)
        self.tables: dict[str, DataFrame] = {}

    def build_index(self, path: str, *dirs: str, max_files: int | None = None) -> dict[str, DataFrame]:
        return self.index_filings(read_filings(self.spark, *dirs, max_files=max_files), path)

    def index_filings(self, filings: DataFrame, path: str) -> dict[str, DataFrame]:
        c = self.config.chunking
        chunks = chunking.chunk_filings(filings, c.max_chars, c.overlap_chars, c.min_chars, c.by_sections)
        return self.index_chunks(chunks.withColumn("ord", F.xxhash64("chunk_id")), path)

    def index_chunks(self, chunks: DataFrame, path: str) -> dict[str, DataFrame]:
        store.write_index(chunks, path, self.info, self.embed(retrieval.catalog(chunks), dim=self.info.dim))
        return self.load_index(path)

    def load_index(self, path: str) -> dict[str, DataFrame]:
        self.tables = store.read_index(self.spark, path, self.info)
        return self.tables

    def retrieve(self, queries: DataFrame, where: dict[str, object] | None = None, top_k: int | None = None, own_ticker: bool = False) -> DataFrame:
        """Hits of each query; a filter keeps the statistics of the whole corpus.

        With own_ticker a query with a ticker sees only its chunks, in any case of letters, one without sees all.
        """
        t, r = self.tables, self.config.retrieval
        allowed = t["chunks"].filter(retrieval.metadata_filter(where)).select("chunk_id") if where else None

        def keep(scores: DataFrame) -> DataFrame:
            if allowed is not None:
                scores = scores.join(allowed, "chunk_id", "left_semi")
            if own_ticker:
                scores = scores.join(t["chunks"].select("chunk_id", F.upper("ticker").alias("_has")), "chunk_id").join(queries.select("query_id", F.upper(F.nullif(F.col("ticker"), F.lit(""))).alias("_wants")), "query_id")
                scores = scores.filter("_wants IS NULL OR _wants = _has").drop("_has", "_wants")
            return scores

        lexical = retrieval.top(keep(retrieval.bm25_scores(packed.unpacked(t["postings"], queries), t["corpus_stats"], queries)), r.candidate_k, "chunk_id")
        dense = retrieval.top(keep(retrieval.sparse_scores(t["vectors"], self.embed(queries, key="query_id", dim=self.info.dim, mode="query"))), r.candidate_k, "chunk_id")
        k = top_k or r.top_k
        pool = max(3 * k, r.candidate_k) if r.rerank else k
        hits = retrieval.hybrid(dense, lexical, top_k=pool, method=r.fusion, dense_weight=r.dense_weight, lexical_weight=r.bm25_weight, k=r.rrf_k)
        return retrieval.rerank(hits, queries, t["chunks"], k, pool) if r.rerank else hits

    def log(self, event: str, payloads: DataFrame) -> None:
        """Adds to the audit log; nothing without a path of one in the settings."""
        if self.config.audit.path:
            store.append_audit(self.spark, self.config.audit.path, event, payloads)

    def context(self, hits: DataFrame) -> DataFrame:
        return generation.context_of(hits, self.tables["chunks"], self.config.generation.max_context_chunks)

    def ask(self, queries: DataFrame, where: dict[str, object] | None = None, hits: DataFrame | None = None) -> DataFrame:
        """One row per query: answer, confidence, abstained and why, and the groundedness of its claims.

        Answers that fail verification are repaired once by leaving out their unsupported claims, kept if that is no
        worse, and abstain if they still fail. hits are those of an earlier retrieval. Each answer is logged.
        """
        out = cut_lineage(self._answers(queries, cut_lineage(self.context(self.retrieve(queries, where) if hits is None else hits))))
        self.log("answer", out)
        return out

    def _answers(self, queries: DataFrame, context: DataFrame) -> DataFrame:
        g, v = self.config.generation, self.config.verification
        answers = cut_lineage(generation.answer(queries, context, self.answerer, g.min_evidence_score, g.min_citations, g.abstain_below_confidence, g.quote_chars))
        if not v.enabled:
            return answers
        evidence = context.select(F.col("query_id").alias("answer_id"), "n", "chunk_id", "text")
        asked = answers.select(F.col("query_id").alias("answer_id"), F.when(~F.col("abstained"), F.col("answer")).otherwise("").alias("text"))
        judged = cut_lineage(verification.checked(self.judge(asked, evidence)))
        first = verification.report(judged)
        if v.repair:
            kept = judged.filter(~F.col("verdict").isin("UNSUPPORTED", "CONTRADICTED")).groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_no", "claim"))), lambda c: c["claim"]), " ").alias("repaired"))
            fails = first.filter(verification.fails_gate(v.groundedness_floor, v.abstain_on_contradiction)).select("answer_id")
            fixed = kept.join(fails, "answer_id", "left_semi")
            second = verification.report(verification.checked(self.judge(fixed.select("answer_id", F.col("repaired").alias("text")), evidence))).select("answer_id", F.col("groundedness").alias("g2"), F.col("contradicted").alias("c2"))
            first = first.join(fixed, "answer_id", "left").join(second, "answer_id", "left")
            better = F.col("g2").isNotNull() & (F.col("g2") >= F.col("groundedness")) & (F.col("c2") <= F.col("contradicted"))
            first = first.withColumns({"repaired": F.when(better, F.col("repaired")), "groundedness": F.when(better, F.col("g2")).otherwise(F.col("groundedness")), "contradicted": F.when(better, F.col("c2")).otherwise(F.col("contradicted"))})
        else:
            first = first.withColumn("repaired", F.lit(None).cast("string"))
        told = first.withColumn("fails", verification.fails_gate(v.groundedness_floor, v.abstain_on_contradiction)).select(F.col("answer_id").alias("query_id"), "groundedness", "fails", "repaired", F.col("contradicted").alias("n_contradicted"))
        j = answers.join(told, "query_id", "left")
        late = ~F.col("abstained") & F.coalesce("fails", F.lit(False))
        reason = F.when(F.col("abstained"), F.col("abstain_reason")).when(late & (F.col("n_contradicted") > 0), "contradicted by cited evidence").when(late, "insufficient grounding")
        value = F.when(F.col("groundedness").isNull(), F.col("confidence")).otherwise(generation.verified_confidence(F.col("confidence"), F.col("groundedness")))
        return j.select("query_id", F.coalesce("repaired", "answer").alias("answer"), "evidence_score", "n_citations", value.alias("confidence"), (F.col("abstained") | late).alias("abstained"), reason.alias("abstain_reason"), "groundedness")

    def extract(self, queries: DataFrame, target: str, where: dict[str, object] | None = None, constrain: bool = True, top_k: int | None = None) -> DataFrame:
        """(query_id, data, valid, error): the target read from the chunks retrieved for each query.

        Retrieval is held to the preferred item of the target, unless the filter names items; queries that find nothing
        there are retrieved again without. Each extraction is logged.
        """
        where = dict(where or {})
        if constrain and "item_number" not in where:
            first = cut_lineage(self.retrieve(queries, where | {"item_number": [extraction.preferred_item(target)]}, top_k))
            rest = queries.join(first.select("query_id").distinct(), "query_id", "left_anti")
            hits = first.unionByName(self.retrieve(rest, where or None, top_k))
        else:
            hits = self.retrieve(queries, where or None, top_k)
        out = cut_lineage(extraction.extract(hits, self.tables["chunks"], target))
        self.log("extraction", out.select("query_id", F.lit(target).alias("target"), "valid", "error"))
        return out

    def compare_years(self, year_a: str, year_b: str, forms: list[str] | None = None, tickers: list[str] | None = None, items: list[str] | None = None) -> DataFrame:
        """Annual reports are compared unless other forms are named; of the named tickers and items only, which are read by themselves."""
        c = self.tables["chunks"]
        if tickers:
            c = c.filter(F.upper("ticker").isin(*[t.upper() for t in tickers]))
        if items:
            c = c.filter(F.upper("item_number").isin(*[i.upper() for i in items]))
        return comparison.compare_years(c, year_a, year_b, forms or [COMPARED])

    def evaluate(self, cases: DataFrame, k: int | None = None, generate: bool = True) -> tuple[DataFrame, DataFrame]:
        """Rows of measures by case and the roll-up of one row.

        cases: query_id, text, ticker, relevant_items, relevant_passages, answerable. The cases are retrieved and
        answered as one table; latency is its time over their number. Without generate only retrieval is measured.
        """
        k = k or self.config.retrieval.top_k
        began = time.time()
        hits = cut_lineage(self.retrieve(cases, top_k=k, own_ticker=True))
        each = (time.time() - began) * 1000 / max(1, cases.count())
        if not generate:
            r = evaluation.relevance(cases, hits, self.tables["chunks"])
            v, g = F.col("values"), F.col("gold")
            rows = r.select("query_id", evaluation.recall_at_k(v, g, k).alias("recall"), evaluation.reciprocal_rank(v, g).alias("rr"), evaluation.average_precision(v, g, k).alias("ap"))
            return rows, rows.agg(F.count("*").alias("n_cases"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(n) for c, n in (("recall", "recall_at_k"), ("rr", "mrr"), ("ap", "map_at_k"))])
        context = cut_lineage(self.context(hits))
        answers = cut_lineage(self._answers(cases, context))
        rows = evaluation.case_rows(cases, hits, self.tables["chunks"], answers, context, k, self.judge).withColumn("latency_ms", F.lit(round(each, 3)))
        rows = cut_lineage(rows)
        return rows, evaluation.roll_up(rows, lexical=self.judge is verification.judge)

    def enforcement(self, cases: DataFrame, k: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Signals and items found for each case (case_id, description, ticker, expected_signals, expected_items), and their means."""
        c = self.tables["chunks"]
        found = signals.detect(c).join(c.select("chunk_id", "ticker"), "chunk_id").select("ticker", "signal_type")
        q = cases.select(F.col("case_id").alias("query_id"), F.col("description").alias("text"), "ticker")
        items = self.retrieve(q, top_k=k, own_ticker=True).join(c.select("chunk_id", "item_number"), "chunk_id").select(F.col("query_id").alias("case_id"), "item_number")
        rows = cut_lineage(evaluation.enforcement(cases, found, items))
        return rows, evaluation.enforcement_means(rows)

    def monitor(self, year_a: str, year_b: str, forms: list[str] | None = None, compare_form: str = COMPARED, tickers: list[str] | None = None) -> DataFrame:
        """New risks, new litigation and signals of year B by ticker; without chunks of the forms in year B any form counts.

        forms are those of the signals; the years are compared by compare_form alone.
        """
        c = self.tables["chunks"].withColumn("ticker", F.upper("ticker"))
        if tickers:
            c = c.filter(F.col("ticker").isin(*[t.upper() for t in tickers]))
        current = c.filter(F.col("fiscal_year") == str(year_b))
        if forms:
            wanted = current.filter(F.col("filing_type").isin(*forms))
            current = wanted.unionByName(current.join(wanted.select("ticker").distinct(), "ticker", "left_anti").select(wanted.columns))
        s = signals.detect(current).join(current.select("chunk_id", "ticker"), "chunk_id")
        return signals.monitor(self.compare_years(year_a, year_b, [compare_form], tickers), s)
