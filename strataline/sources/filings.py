"""Filings on disk: text files with provenance from a sidecar or from their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataline.functions.text import first_truthy
from strataline.operators import chunking

META = ("ticker", "company", "cik", "filing_type", "filing_date", "fiscal_year", "accession", "source_url", "source_path")
SIDECAR = (
    "schema_version int, metadata struct<" + ", ".join(f"{m}: string" for m in META) + ">, sections array<struct<item_number: string, title: string, char_start: int, char_end: int>>, _bad string"
)


def read_filings(spark: SparkSession, *dirs: str, pattern: str = "*.txt", default_form: str = "10-K", max_files: int | None = None) -> DataFrame:
    """Filings below the folders: the metadata, text, sections (null without a sidecar) and dir.

    Blank files are left out; max_files counts per folder in order of path. A missing folder is an error of the reader.
    A sidecar `<stem>.json` with metadata wins over the file name, field by field; a malformed one counts as absent.
    """
    path = F.col("_metadata.file_path")
    texts = None
    for d in dirs:
        one = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(d, wholetext=True).select(path.alias("path"), F.col("value").alias("text"), F.lit(d).alias("dir"))
        texts = one if texts is None else texts.unionByName(one)
    if texts is None:
        raise ValueError("no folder named")
    texts = texts.filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").withColumn("stem", F.regexp_replace("path", r"\.[^./]*$", ""))
    if max_files is not None:
        texts = texts.withColumn("r", F.row_number().over(Window.partitionBy("dir").orderBy("path"))).filter(F.col("r") <= max_files).drop("r")
    cars = None
    for d in dirs:
        one = spark.read.schema(SIDECAR).option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(d, multiLine=True, mode="PERMISSIVE").select("*", path.alias("p"))
        cars = one if cars is None else cars.unionByName(one)
    cars = cars.filter("metadata IS NOT NULL AND _bad IS NULL").select(F.regexp_replace("p", r"\.[^./]*$", "").alias("stem"), "metadata", "sections").dropDuplicates(["stem"])
    j = texts.join(cars, "stem", "left").withColumns({"m": chunking.filename_metadata(F.col("path")), "form": chunking.inferred_form(F.col("path"), default_form)})
    known = {"filing_type": F.col("form"), "source_path": F.col("path"), "source_url": F.lit(""), "company": F.lit("UNKNOWN")}
    value = lambda k: F.coalesce(first_truthy(F.col(f"metadata.{k}")), known[k] if k in known else F.col(f"m.{k}"))
    return j.select(*[value(k).alias(k) for k in META], "text", "sections", "dir")


def select_filings(filings: DataFrame, forms: list[str], year: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The filing of each ticker that a reader would fetch: of the first form in the list that has one in the period, the latest.

    year is that of the filing date, start and end are dates that count in; dates that aren't whole never fall in a
    period, and come last without one. Ties go to the largest accession.
    """
    day = F.to_date(F.when(F.col("filing_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("filing_date")))
    keep = F.col("filing_type").isin(*forms)
    if year is not None:
        keep = keep & (F.year("_day") == year)
    if start is not None:
        keep = keep & (F.col("_day") >= F.lit(start).cast("date"))
    if end is not None:
        keep = keep & (F.col("_day") <= F.lit(end).cast("date"))
    place = F.coalesce(*[F.when(F.col("filing_type") == f, F.lit(k)) for k, f in enumerate(forms)], F.lit(len(forms)))
    w = Window.partitionBy("ticker").orderBy(place, F.col("_day").desc_nulls_last(), F.col("accession").desc())
    found = filings.withColumn("_day", day).filter(keep).withColumn("_r", F.row_number().over(w)).filter("_r <= 1")
    return found.drop("_r", "_day")


def provenance(raw: DataFrame) -> DataFrame:
    """The metadata of downloaded filings, all strings: ticker, company, cik, form, filing_date, period, accession, source_url and source_path as they came.

    The fiscal year is that of the period of report, else that of the filing date; what is absent reads UNKNOWN, but the
    company reads like the ticker and accession, url and path are empty.
    """
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    unknown = F.lit("UNKNOWN")
    cik, date = F.coalesce(text("cik"), unknown), F.coalesce(text("filing_date"), unknown)
    year = F.coalesce(F.substring(text("period"), 1, 4), F.when(date != "UNKNOWN", F.substring(date, 1, 4)), unknown)
    accession = F.coalesce(text("accession"), F.lit(""))
    return raw.select(
        "ticker", F.coalesce(text("company"), F.col("ticker")).alias("company"), cik.alias("cik"), F.coalesce(text("form"), unknown).alias("filing_type"), date.alias("filing_date"), year.alias("fiscal_year"),
        accession.alias("accession"), source_url(F.coalesce(text("source_url"), F.lit("")), cik, F.coalesce(F.nullif(accession, F.lit("")), unknown)).alias("source_url"), F.coalesce(text("source_path"), F.lit("")).alias("source_path"),
    )


def write_sidecars(filings: DataFrame, path: str) -> None:
    """One JSON line for each filing: its metadata and the places of its sections, as read_filings takes them. Adds to what is there."""
    places = chunking.sections(filings.select("accession", "text"))
    ends = places.select("accession", F.struct("item_number", "title", "char_start", (F.col("char_start") + F.length("section_text")).alias("char_end")).alias("s"))
    cut = ends.groupBy("accession").agg(F.array_sort(F.collect_list(F.struct(F.col("s.char_start").alias("at"), "s"))).alias("l")).select("accession", F.transform("l", lambda x: x["s"]).alias("sections"))
    rows = filings.join(cut, "accession", "left").select(F.lit(1).alias("schema_version"), F.struct(*META).alias("metadata"), "sections")
    rows.write.mode("append").json(path)


def metadata_json(rows: DataFrame) -> DataFrame:
    """rows with `metadata`: the metadata columns that are there, as a JSON object of strings."""
    known = [F.col(m).cast("string").alias(m) for m in META if m in rows.columns]
    return rows.withColumn("metadata", F.to_json(F.struct(*known)))


def from_metadata_json(rows: DataFrame, column: str = "metadata") -> DataFrame:
    """rows with the metadata columns read from a JSON object; unknown keys fall away, absent ones read UNKNOWN (url and path are empty)."""
    m = F.from_json(column, ", ".join(f"{k} string" for k in META))
    empty = lambda k: F.lit("") if k in ("source_url", "source_path") else F.lit("UNKNOWN")
    return rows.withColumns({k: F.coalesce(m[k], empty(k)) for k in META})


def source_url(url, cik, accession):
    """The url as it is, else the index page of the filing by cik and accession; empty where they aren't known."""
    number = cik.try_cast("long")
    made = F.format_string("https://www.sec.gov/Archives/edgar/data/%d/%s/%s-index.htm", number, F.replace(accession, F.lit("-"), F.lit("")), accession)
    return F.coalesce(F.nullif(url, F.lit("")), F.when(number.isNotNull() & (accession != "UNKNOWN"), made), F.lit(""))


CASES = "id string, question string, relevant_items array<string>, relevant_passages array<string>, ticker string, answerable boolean, gold_answer string, category string, source string, doc string"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from a JSON list; answerable defaults to true, lists to empty. Gold answers are kept."""
    c = spark.read.schema(CASES).json(path, multiLine=True)
    none = F.array().cast("array<string>")
    return c.withColumns({"answerable": F.coalesce("answerable", F.lit(True)), "relevant_items": F.coalesce("relevant_items", none), "relevant_passages": F.coalesce("relevant_passages", none)})


def read_enforcement_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, description string, expected_signals array<string>, expected_items array<string>, ticker string, source_url string").json(path, multiLine=True)


def html_first_column(pages: DataFrame, table_id: str, html: str = "html") -> DataFrame:
    """pages with `cells`: the text of the first cell of each row of the table with the id."""
    body = F.regexp_extract(html, rf"(?is)<table[^>]*id=[\"']{table_id}[\"'][^>]*>(.*?)</table>", 1)
    rows = F.regexp_extract_all(body, F.lit(r"(?is)<tr[^>]*>\s*<td[^>]*>(.*?)</td>"), F.lit(1))
    return pages.withColumn("cells", F.transform(rows, lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>", ""))))


def year_range(specs: list[str]) -> list[int]:
    """["2021-2023", "2025"] as sorted years."""
    out: set[int] = set()
    for s in specs:
        lo, _, hi = s.partition("-")
        out |= set(range(int(lo), int(hi or lo) + 1))
    return sorted(out)


def work_list(spark: SparkSession, tickers: list[str], forms: list[str], years: list[int], done: DataFrame | None = None) -> DataFrame:
    """Form, ticker and year to fetch, without what is done already."""
    t = spark.createDataFrame([(x.upper(),) for x in sorted(set(tickers))], "ticker string")
    return open_work(t, forms, [str(x) for x in years], done)


def open_work(tickers: DataFrame, forms: list[str], years: list[str], done: DataFrame | None = None) -> DataFrame:
    """Every form and year, which are given lists, of every row of tickers, without what is done."""
    of = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    work = tickers.withColumn("filing_type", of(forms)).withColumn("fiscal_year", of(years))
    return work if done is None else work.join(done.select("ticker", "filing_type", "fiscal_year"), ["ticker", "filing_type", "fiscal_year"], "left_anti")


class Checkpoint:
    """Which fetches are done, as a table that is only added to; a cleared one holds nothing."""

    KEY = "ticker string, filing_type string, fiscal_year string, accession string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def mark(self, done: DataFrame) -> None:
        done.select("ticker", "filing_type", "fiscal_year", "accession").write.mode("append").parquet(self.path)

    def done(self) -> DataFrame:
        """The marked rows, each once; none where nothing was marked."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(self.KEY).parquet(self.path).distinct() if there else self.spark.createDataFrame([], self.KEY)

    def counts(self) -> DataFrame:
        return self.done().groupBy("filing_type", "fiscal_year").agg(F.countDistinct("accession").alias("n"))

    def clear(self) -> None:
        self.spark.createDataFrame([], self.KEY).write.mode("overwrite").parquet(self.path)
