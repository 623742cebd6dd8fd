"""Sources mixed to target weights: hierarchical budgets over a domain, language, source tree and seeded epochs.

Sizes are tokens of a public tokenizer. Only sums by leaf come to the driver (at most the sources of the mixes times
LANGUAGES); documents are chosen where they are, in an order given by a seeded hash, without sorting a leaf in one task.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataline.session import cut_lineage

# Languages told apart; all others count as "other".
LANGUAGES = ("en", "de", "fr", "es", "und", "other")
# The domain of each source; a source that isn't here is a domain of its own.
DOMAINS = {
    "filing_text": "regulatory", "exhibit_scan": "regulatory", "enforcement_release": "regulatory", "earnings_call": "investor", "investor_letter": "investor",
    "analyst_note": "investor", "newswire": "public", "press_archive": "public", "web_crawl": "public", "qa_forum": "public", "glossary": "public",
}
BUCKETS = 4096


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


_loaded: dict = {}


def _encoding(path: str, pattern: str):
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def source_name(c: F.Column) -> F.Column:
    """One spelling of a source: lower case, trimmed, underscores; unknown where null or blank."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")
    return F.when(F.coalesce(s, F.lit("")) == "", "unknown").otherwise(s)


def sized(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, lang, tokens) of the documents with text; null and blank ones have nothing to use."""
    import public_tokenizers

    path, pattern = tokenizer or default_tokenizer(), public_tokenizers.PATTERN
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path, pattern)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("source"), batch.column("lang"), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "tokens"])

    lang = F.lower(F.trim(F.coalesce("lang", F.lit("und"))))
    d = documents.filter(F.col("text").isNotNull() & (F.length(F.trim("text")) > 0)).select(
        "doc_id", "text", source_name(F.col("source")).alias("source"), F.when(lang.isin(*LANGUAGES), lang).otherwise("other").alias("lang")
    )
    return d.mapInArrow(run, f"doc_id {kind}, source string, lang string, tokens long")


def water_fill(budget: float, weights: dict, capacity: dict) -> dict:
    """The budget by weight, none above its capacity; what one can't take goes to its siblings by weight."""
    out = dict.fromkeys(weights, 0.0)
    open_ = {k for k in weights if weights[k] > 0 and capacity[k] > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if out[k] + left * weights[k] / total >= capacity[k]}
        if not full:
            for k in open_:
                out[k] += left * weights[k] / total
            return out
        for k in full:
            left -= capacity[k] - out[k]
            out[k] = capacity[k]
        open_ -= full
    return out


def budgets(leaves: dict[tuple[str, str], int], targets: list[dict], total: int, domains: dict[str, str] | None = None) -> list[dict]:
    """Tokens for each leaf of each mix.

    leaves: tokens by (source, lang); targets: rows of mix_name, source, target_share, max_repeats, size_ratio. Shares
    of a mix are taken relative to their sum, so percent work too; a negative or null share counts as 0, repeated rows
    of a source in a mix add up. A source without documents leaves a shortage to its siblings.
    """
    domains = DOMAINS if domains is None else domains
    by_mix: dict[str, dict[str, dict]] = defaultdict(dict)
    for t in targets:
        row = by_mix[t["mix_name"]].setdefault(t["source"], {"share": 0.0, "repeats": 0, "ratio": 0.0})
        row["share"] += max(0.0, t["target_share"] or 0.0)
        row["repeats"] = max(row["repeats"], t["max_repeats"] or 0)
        row["ratio"] = max(row["ratio"], t["size_ratio"] or 0.0)
    size = defaultdict(int)
    for (source, _), n in leaves.items():
        size[source] += n
    out = []
    for mix, rows in sorted(by_mix.items()):
        shares = sum(r["share"] for r in rows.values()) or 1.0
        tree: dict[str, dict[str, dict[str, tuple[float, float]]]] = defaultdict(lambda: defaultdict(dict))
        for source, r in rows.items():
            domain = domains.get(source, source)
            mine = {lang: n for (s, lang), n in leaves.items() if s == source and n > 0}
            for lang, n in mine.items():
                tree[domain][lang][source] = (r["share"] / shares * n / size[source], float(r["repeats"] * n))
            if not mine:
                tree[domain]["und"][source] = (r["share"] / shares, 0.0)
        weight = lambda node: node[0] if isinstance(node, tuple) else sum(map(weight, node.values()))
        room = lambda node: node[1] if isinstance(node, tuple) else sum(map(room, node.values()))

        def share_out(node, budget: float, path: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], float]]:
            if isinstance(node, tuple):
                yield path, budget
                return
            given = water_fill(budget, {k: weight(v) for k, v in node.items()}, {k: room(v) for k, v in node.items()})
            for k, v in node.items():
                yield from share_out(v, given[k], (*path, k))

        ratio = max(r["ratio"] for r in rows.values())
        for (domain, lang, source), tokens in share_out(tree, ratio * total, ()):
            n = leaves.get((source, lang), 0)
            epochs = int(tokens // n) if n else 0
            out.append({"mix_name": mix, "domain": domain, "lang": lang, "source": source, "share": rows[source]["share"] / shares, "budget": tokens, "available": n, "epochs": epochs, "rest": tokens - epochs * n if n else 0.0})
    return out


_PLAN = "mix_name string, domain string, lang string, source string, share double, budget double, available long, epochs int, rest double"


def _plan(docs: DataFrame, targets: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    rows = [r.asDict() for r in targets.select("mix_name", source_name(F.col("source")).alias("source"), "target_share", "max_repeats", "size_ratio").collect()]
    named = {r["source"] for r in rows}
    sums = docs.groupBy(F.when(F.col("source").isin(*named), F.col("source")).alias("source"), F.when(F.col("source").isin(*named), F.col("lang")).alias("lang")).agg(F.sum("tokens").alias("n")).collect()
    total = sum(r.n for r in sums)
    plan = budgets({(r.source, r.lang): r.n for r in sums if r.source}, rows, total) if rows else []
    return spark.createDataFrame([tuple(p[k.split()[0]] for k in _PLAN.split(", ")) for p in plan], _PLAN)


def select(documents: DataFrame, targets: DataFrame, seed: int = 17, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Chosen documents and the report.

    documents: doc_id, text, lang, source; targets: mix_name, source, target_share, max_repeats, size_ratio; other
    columns are ignored. Each leaf runs through whole epochs as often as its budget allows, then takes the head of one
    more in an order hashed from the seed, up to the document that meets the budget at its middle. No document is used
    more than max_repeats times. Documents without text are never chosen; an empty table gives empty results and shares
    of 0.

    Returns chosen (mix_name, doc_id, source, lang, tokens, uses) and report (mix_name, source, target_share, budget,
    tokens, actual_share, documents, shortage, mix_fill). mix_fill is the size of the whole mix over the size wanted: under
    1 where the repeats of all its sources don't suffice.
    """
    docs = cut_lineage(sized(documents, tokenizer))
    plan = cut_lineage(_plan(docs, targets))
    h = F.xxhash64(F.col("doc_id"), F.col("mix_name"), F.lit(seed))
    rows = docs.join(plan, ["source", "lang"]).withColumns({"h": h, "bucket": F.shiftrightunsigned(h, 52).cast("int")})
    leaf = ["mix_name", "source", "lang"]
    sums = rows.filter("rest > 0").groupBy(*leaf, "bucket", "rest").agg(F.sum("tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*leaf).orderBy("bucket"))  # at most BUCKETS rows a leaf
    cut = sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n")).filter((F.col("before") <= F.col("rest")) & (F.col("upto") > F.col("rest")))
    edge = cut.select(*leaf, F.col("bucket").alias("edge"), "before")
    placed = rows.join(edge, leaf, "left")
    within = Window.partitionBy(*leaf, "bucket").orderBy("h", "doc_id")
    sure = placed.filter(F.col("edge").isNull() | (F.col("bucket") != F.col("edge"))).withColumn("more", ((F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge")))).cast("int"))
    at = placed.filter("bucket = edge").withColumn("mid", F.col("before") + F.sum("tokens").over(within) - F.col("tokens") / 2)
    at = at.withColumn("more", (F.col("mid") <= F.col("rest")).cast("int")).drop("mid")
    chosen = sure.unionByName(at).withColumn("uses", F.col("epochs") + F.col("more")).filter("uses > 0").select("mix_name", "doc_id", "source", "lang", "tokens", "uses")
    got = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"))
    wanted = plan.groupBy("mix_name", "source").agg(F.max("share").alias("target_share"), F.sum("budget").alias("budget"))
    whole = F.nullif(F.sum("tokens").over(Window.partitionBy("mix_name")), F.lit(0))
    report = wanted.join(got, ["mix_name", "source"], "left").na.fill(0, ["tokens", "documents"]).withColumn("actual_share", F.coalesce(F.col("tokens") / whole, F.lit(0.0)))
    size = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first().t
    ratios = targets.groupBy("mix_name").agg(F.max("size_ratio").alias("ratio"))
    report = report.join(ratios, "mix_name", "left").withColumn("mix_fill", F.round(F.coalesce(whole / F.nullif(F.col("ratio") * size, F.lit(0.0)), F.lit(0.0)), 6))
    return chosen, report.select("mix_name", "source", "target_share", "budget", "tokens", "actual_share", "documents", F.greatest(F.lit(0.0), F.col("target_share") - F.col("actual_share")).alias("shortage"), "mix_fill")
