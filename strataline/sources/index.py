"""The index as a folder of Parquet tables, guarded by the fingerprint of its embedder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.operators import packed, retrieval

TABLES = ("chunks", "postings", "term_stats", "corpus_stats", "vectors", "index_meta")
FORMAT = 3


@dataclass(frozen=True)
class VectorSpace:
    """What the vectors of an index mean; indexes of different spaces don't mix."""

    kind: str = "hashing"
    dim: int = 256

    @property
    def label(self) -> str:
        return f"{self.kind}, {self.dim} cells"


def write_index(chunks: DataFrame, path: str, info: VectorSpace = VectorSpace(), vectors: DataFrame | None = None) -> None:
    """All tables of the index; each file of the postings lies ordered by term, so that a query reads few pages. Overwrites."""
    spark = chunks.sparkSession
    retrieval.catalog(chunks).write.mode("overwrite").parquet(f"{path}/chunks")
    c = spark.read.parquet(f"{path}/chunks")
    packed.pack(c).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    p = spark.read.parquet(f"{path}/postings")
    packed.corpus_stats(p).write.mode("overwrite").parquet(f"{path}/corpus_stats")
    packed.term_stats(p, spark.read.parquet(f"{path}/corpus_stats")).write.mode("overwrite").parquet(f"{path}/term_stats")
    v = retrieval.hash_embedding(c, dim=info.dim) if vectors is None else vectors
    v.write.mode("overwrite").parquet(f"{path}/vectors")
    meta = c.agg(F.count("*").alias("chunk_count")).select(F.lit(FORMAT).alias("format"), F.lit(info.label).alias("space"), "chunk_count")
    meta.write.mode("overwrite").parquet(f"{path}/index_meta")


def read_index(spark: SparkSession, path: str, expected: VectorSpace | None = None) -> dict[str, DataFrame]:
    """The tables of an index; another format or embedder than expected is an error."""
    meta = spark.read.parquet(f"{path}/index_meta").first()
    if meta.format != FORMAT:
        raise ValueError(f"index format {meta.format}, expected {FORMAT}")
    if expected is not None and meta.space != expected.label:
        raise ValueError(f"index was built with {meta.space}, not {expected.label}")
    return {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of both by key; those of new win, of repeated keys in new the one of largest ord."""
    latest = new.groupBy(key).agg(F.max(F.struct("ord", *[c for c in new.columns if c not in (key, "ord")])).alias("r")).select(key, "r.*")
    return old.join(latest.select(key), key, "left_anti").unionByName(latest)


def append_audit(spark: SparkSession, path: str, event: str, payloads: DataFrame) -> None:
    """Appends one JSON line per row of payloads: event_id, event, ts and the row as payload."""
    e = payloads.select(F.to_json(F.struct(*payloads.columns)).alias("payload"))
    e.select(F.expr("uuid()").alias("event_id"), F.lit(event).alias("event"), F.current_timestamp().alias("ts"), "payload").write.mode("append").json(path)


def save_baseline(metrics: DataFrame, path: str) -> None:
    """Metrics without latencies, in order of name."""
    metrics.filter(~F.col("metric").endswith("_latency_ms")).orderBy("metric").coalesce(1).write.mode("overwrite").json(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """The saved metrics, or None where nothing was saved; a folder that can't be read is an error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    b = spark.read.schema("metric string, value double").json(path).filter("metric IS NOT NULL")
    return None if b.isEmpty() else b


SCORES = ("correctness", "groundedness", "completeness", "citations_score")


def review_sheet(answers: DataFrame, size: int, seed: int = 7) -> DataFrame:
    """A sample of answers for human review, chosen by seeded hash, with empty scores to fill in.

    Whatever columns answers has (question, gold answer, context) come along.
    """
    h = F.xxhash64("query_id", F.lit(seed))
    blank = F.lit(None).cast("int")
    return answers.orderBy(h, "query_id").limit(size).withColumns({k: blank for k in SCORES})


def write_review(sheet: DataFrame, path: str) -> None:
    """The sheet as JSON lines below path/json, nulls kept, and as Markdown with a form to fill in below path/text."""
    sheet.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/json")
    told = [F.concat(F.lit(f"**{c}**: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in sheet.columns if c not in (*SCORES, "query_id")]
    form = [F.lit(f"- {c}: ____") for c in SCORES]
    text = F.concat_ws("\n\n", F.concat(F.lit("## "), "query_id"), *told, F.concat_ws("\n", *form))
    sheet.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/text")
