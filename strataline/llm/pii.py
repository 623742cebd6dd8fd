"""Personal information in free text: bootstrapped contextual extraction and typed placeholders.

One pass over the texts takes every span that could name or identify a person, with the words around it, and counts the
words in lower case. Spans of certain form are seeds. Over the graph of contexts (the words beside a span) and instances
(name words; forms of numbers, mail and street addresses) scores spread for a few rounds in Spark: a context is as good
as the known instances in it, an instance as good as the contexts it stands in; so contexts learned from seeds reveal
instances nobody listed, and these further contexts. Words that mostly occur in lower case are negative seeds for names.
Every row of the result has its score from the graph.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.markup import STOP_WORDS
from strataline.operators.skew import hot_keys, salted_join
from strataline.session import cut_lineage

ROUNDS = 3
#: Distinct instances that a context needs before it is scored, and the score from which context and instance count.
SUPPORT, CERTAIN = 3, 0.6
#: Score of an instance that nothing is known of yet.
UNKNOWN = 0.3
#: Times that a word occurs in lower case for each time within what may be a name, from which it is none.
COMMON = 1.0

_UP = "".join(chr(c) for c in range(0x41, 0x250) if chr(c).isupper())
_LOW = "".join(chr(c) for c in range(0x61, 0x250) if chr(c).islower())
_N = f"[{_UP}](?:[{_UP}{_LOW}]|['’](?=[{_UP}{_LOW}]))*[{_UP}{_LOW}](?:-[{_UP}][{_UP}{_LOW}'’]*)*"
# Titles before names, particles within them, parts of firm names.
TITLES = "Mr Mrs Ms Miss Mx Dr Prof Professor Sir Dame Lord Lady Rev Hon Judge Justice Herr Frau M Mme Mlle Monsieur Madame Sr Sra Srta Señor Señora Don Doña".split()
PARTICLES = "de del della di da van von der den la le Mac Mc al el ter ten bin ibn".split()
FIRM_WORDS = frozenset(
    """Inc Corp Corporation Co Company LLC LLP LP Ltd Limited plc PLC N.V NV S.A SA AG GmbH SE Group Holdings Bancorp Capital Partners Advisors Advisers Associates Trust Fund Bank Ventures
    Management Securities Insurance Foundation University Logistics Energy Networks Robotics Mining Foods Apparel Marine Systems Materials Instruments Properties Therapeutics Law Legal Counsel""".split()
)
_TITLE = r"(?:(?<![\w.])(?:%s)\.?[ \t]+)" % "|".join(TITLES)
_PARTICLE = r"(?:(?:%s)[ \t]+)" % "|".join(PARTICLES + [p.upper() for p in PARTICLES])
#: A short word in capitals before a particle ("ID de", "SSN von"): a label, no given name.
_LABEL = f"[{_UP}]{{2,4}}[ \\t]+(?:{'|'.join(PARTICLES)})[ \\t]+[{_UP}]"
_PLAIN = f"(?:(?!{_LABEL}){_PARTICLE}{{0,2}}{_N})"
NAME = re.compile(
    f"(?=[{_UP}])(?<!\\w)(?P<title>{_TITLE}(?:{_TITLE})?)?(?<![\\w@.'’-])(?P<name>(?!{_LABEL})(?:{_N}|[{_UP}]\\.)(?:[ \\t]+(?:[{_UP}]\\.[ \\t]*)+{_PARTICLE}{{0,2}}{_N}|[ \\t]+{_PLAIN}){{1,3}}|(?(title){_PARTICLE}{{0,2}}{_N}|(?!)))(?![\\w@])"
)
LISTED = re.compile(f"(?=[{_UP}a-z])(?<![\\w&,-])(?P<family>{_PARTICLE}{{0,2}}{_N}), (?P<given>{_N}(?:[ \\t][{_UP}]\\.)?)(?=;|\\s*$|[ \\t]*\\n)", re.M)

#: How an entry of a list of names ends; texts without one hold none.
_LISTED_END = re.compile(f", [{_UP}][^\\s,;]*(?:[ \\t][{_UP}]\\.)?(?:;|[ \\t]*(?:\\n|$))")

EMAIL = re.compile(
    r"(?<![\w.+%-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)+(?<![.-])"
    r"|(?<![\w.+%-])[\w.+%-]+[ \t]*[\[({<][ \t]*(?:at|AT|@)[ \t]*[\])}>][ \t]*[\w-]+(?:(?:[ \t]*[\[({<][ \t]*(?:dot|DOT|\.)[ \t]*[\])}>][ \t]*|\.)[\w-]+)+"
    r"|(?<![\w.+%-])[\w.+%-]+[ \t]+(?:at|AT)[ \t]+[\w-]+(?:[ \t]+(?:dot|DOT)[ \t]+[\w-]+)+"
)
#: What a text with a mail address holds.
_MAIL_MARKS = ("@", "(at", "[at", "{at", "<at", "( at", "[ at", "{ at", "< at", " dot ", "dot]", "dot)", "\tdot\t")
NUMBER = re.compile(r"(?<![\w$€£@/])(?<![\w][.,-])(?P<number>(?:[A-Z]{1,2}(?=\d)|(?!ID|NO|NI|IN|TO|AT|OF|ON|BY|NR)[A-Z]{2} (?=\d\d ))?(?:\+|\()?\d(?:[ ().\-–/]{0,2}[0-9]){5,}(?:[ -]?[A-Z](?!\w))?)(?![\w%])")
#: Digits enough for a number.
_DIGITS = re.compile(r"\d(?:[ ().\-–/]{0,2}[0-9]){5}")
# Kinds of streets in the four languages.
_US = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Way|Boulevard|Blvd|Place|Pl|Terrace|Ter|Square|Sq|Circle|Cir|Close|Crescent|Parkway|Pkwy|Highway|Hwy|Row|Mews|Gardens|Grove|Walk"
_CITY = rf"(?:(?:North|South|East|West|Upper|Lower|Fort|Port|New|Saint|St\.)[ \t])?{_N}(?:[ \t](?:Bay|Springs|Valley|County|City|Falls|Hills))?"
_POSTAL = rf"(?:,[ \t]*\d{{4,5}}[ \t]+{_N}(?:[ \t](?:Bay|Springs|Valley|County))?)?"
#: A number before a capital letter, where an English address may start, and the flat that may stand before it.
_NUMBERED = re.compile(rf"(?<![\w.,$-])\d{{1,5}}[A-Za-z]?,?[ \t]+(?=[{_UP}])")
_ENGLISH = re.compile(
    rf"\d{{1,5}}[A-Za-z]?,?[ \t]+(?:{_N}[ \t]+){{1,3}}(?:{_US}|{_US.upper()})(?:\b\.?)(?:,[ \t]*(?:Apt\.?|Apartment|Unit|Flat|Suite|#)[ \t]*\d+[A-Za-z]?)?(?:(?:,[ \t]|,?\n){_CITY}(?=[.,;)\s]|$))?"
)
_FLAT = re.compile(r"(?:Flat|Unit|Apt\.?|Apartment|Suite|Floor|No\.)[ \t]*\d+[A-Za-z]?,[ \t]*$")
# Kinds of German streets, and prepositions that start the names of some.
_GERMAN_STREETS = tuple("straße strasse gasse weg allee platz ring damm ufer Straße Strasse Gasse Weg Allee Platz Ring Damm Ufer STRASSE GASSE WEG ALLEE PLATZ".split())
_PREPOSITION = re.compile(rf"(?<!\w)(?:Am|Beim|Im|Zum|Zur|An[ ](?:der|den|dem)|In[ ](?:der|den)|Auf[ ](?:der|dem)|Unter[ ]den|Hinter[ ](?:der|dem))[ \t]+(?=[{_UP}])")
_DIGIT_RUN = re.compile(r"\d+")
#: What before a number makes it a part of something else.
_GLUED = frozenset("_.,$-")
# What a text with a Spanish address holds.
_SPANISH_MARKS = "Calle Avenida Avda Plaza Paseo Camino Ronda Travesía C/".split()
_GERMAN = re.compile(
    rf"(?=[{_UP}])(?<!\w)(?:(?:{_N}[ \t]){{0,2}}[{_UP}][{_UP}{_LOW}-]*(?:straße|strasse|gasse|weg|allee|platz|ring|damm|ufer|STRASSE|GASSE|WEG|ALLEE|PLATZ)[ \t]+\d{{1,4}}[ \t]?[a-z]?\b{_POSTAL}"
    rf"|(?:{_N}[ \t]){{1,2}}(?:Straße|Strasse|Gasse|Weg|Allee|Platz|Ring|Damm|Ufer)[ \t]+\d{{1,4}}[ \t]?[a-z]?\b{_POSTAL}"
    rf"|(?:Am|Beim|Im|Zum|Zur|An[ ](?:der|den|dem)|In[ ](?:der|den)|Auf[ ](?:der|dem)|Unter[ ]den|Hinter[ ](?:der|dem))[ \t]+(?:(?:{_N}[ \t]+){{2}}\d{{1,4}}[a-z]?\b|{_N}[ \t]+\d{{1,4}}[a-z]?(?=,[ \t]*\d{{4,5}}[ \t])){_POSTAL})"
)
_FRENCH = re.compile(
    rf"(?<![\w.,$-])\d{{1,4}}(?:[ \t]?(?:bis|ter|quater|[A-D]))?,?[ \t]+(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours|route|square|passage)[ \t]+(?:(?:de[ \t]la|de[ \t]l['’]|du|des|de|d['’])[ \t]*)?(?:{_N}[ \t]?){{1,3}}{_POSTAL}"
)
_SPANISH = re.compile(rf"(?<!\w)(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Ronda|Travesía|C/)[ \t]+(?:(?:de[ \t]las|de[ \t]los|de[ \t]la|del|de)[ \t]+)?(?:{_N}[ \t]?){{1,3}},?[ \t]*(?:n\.?º[ \t]*)?\d{{1,4}}{_POSTAL}")


_STREET_KIND = re.compile(rf"(?i)\b({_US}|rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours|route|square|passage|calle|avenida|avda|plaza|paseo|camino|ronda|travesía)\b|(straße|strasse|gasse|weg|allee|platz|ring|damm|ufer)\b")


def _address_form(language: str, place: str) -> str:
    """Instance of an address in the graph: its language, its kind of street, and whether a postal code or a place follows."""
    m = _STREET_KIND.search(place)
    street = (m[1] or m[2]).lower() if m else "-"
    return f"{language} {street} {'code' if re.search(r'[,\n][ \t]*[0-9]{4,5} ', place) else 'place' if re.search(rf',[ \n][ \t]*[{_UP}]', place) else 'bare'}"


def addresses(text: str) -> list[tuple[int, int, str]]:
    """Places and forms of the street addresses of a text, in order, none within another.

    All forms have a number, so the patterns are tried at the numbers of the text, the German ones where a street or a
    preposition of one stands.
    """
    out, german = [], _PREPOSITION.search(text) is not None
    for m in _DIGIT_RUN.finditer(text):
        at = m.start()
        before = text[at - 1 : at]
        if before in (" ", "\t"):
            end = at - 1
            while end and text[end - 1] in " \t":
                end -= 1
            german = german or text.endswith(_GERMAN_STREETS, 0, end)
        elif before.isalnum() or before in _GLUED:
            continue
        if hit := _NUMBERED.match(text, at) and _ENGLISH.match(text, at):
            lo = max(0, at - 20)
            flat = _FLAT.search(text[lo:at])
            out.append((lo + flat.start() if flat else at, hit.end(), "english"))
        elif hit := _FRENCH.match(text, at):
            out.append((*hit.span(), "french"))
    if german:
        out += [(*m.span(), "german") for m in _GERMAN.finditer(text)]
    if any(k in text for k in _SPANISH_MARKS):
        out += [(*m.span(), "spanish") for m in _SPANISH.finditer(text)]
    kept: list[tuple[int, int, str]] = []
    for lo, hi, language in sorted(out):
        if not kept or lo >= kept[-1][1]:
            place = text[lo:hi].rstrip()
            kept.append((lo, lo + len(place), _address_form(language, place)))
    return kept


_WORD = re.compile(r"\w+(?:['’-]\w+)*\.?|[^\w\s]")
# Words before numbers of firms, filings, securities and batches.
NOT_PERSONAL = frozenset("cusip isin accession file commission employer employee-no order invoice batch run lot section rule item page patent registration docket case contract permit serial figure table series version po sku ein".split())
#: Words that label a number as personal and so end the reach of a word of NOT_PERSONAL before them.
LABELS = re.compile(
    r"\b(?:tel|tel[eé]fono|t[eé]l[eé]phone|telefon|telephone|phone|mobile?|m[oó]vil|portable|handy|cell|fax|call|reached|desk|ssn|social security|national insurance|insurance number|ni no|nin|dni|nie|passport|tax id|sozialversicherung\w*|steuer-?id\w*|ausweis\w*)\b",
    re.I,
)
#: Where a clause ends before a number: sentence ends, semicolons, empty lines and lines that start anew.
_CLAUSE = re.compile(rf"(?<!\b[Nn]o)(?<!\b[Nn]r)(?<!\b[Nn]os)[.!?][\"'”’)\]]*\s+(?=[{_UP}])|;|\n[ \t]*\n|\n(?=[ \t]*[{_UP}])")
#: Words of a context that label nothing by themselves.
_BARE = frozenset("number numbers no nr nos is was of the a to and code id".split())
#: Forms that are sure: the seeds among the instances of the graph.
SEED_SHAPES = {
    "email": re.compile(r"^mail x@x(\.x)*$|^mail x\s*[\[({<]\s*@\s*[\])}>]"),
    "address": re.compile(r"^street .* (code|place)$|^street (german|french|spanish) "),
    "phone": re.compile(r"^\+0|^\([0Z]00\) ?000[-. ]0000|^000[-.]000[-.]0000$|^Z00-000-000-0000$|^Z00 0000 0000$|^Z0+ 000"),
    "id": re.compile(r"^[0Z]00[- ]00[- ]0000$|^AA ?00 ?00 ?00 ?A$|^[0Z]0 000 000 000$|^A0000000$|^[0Z]0000000-?A$"),
}


def shape(number: str) -> str:
    """Letters as A, digits as 0, a zero in front as Z."""
    plain = re.sub(r"\d", "0", re.sub(r"[A-Z]", "A", number))
    return "Z" + plain[1:] if number[0] == "0" else plain


def _left(text: str, at: int) -> tuple[str, str]:
    """The last two words before a place, and the last four, digits as 0."""
    words = [re.sub(r"\d+", "0", w.lower()) for w in _WORD.findall(text[max(0, at - 48) : at])]
    return " ".join(words[-2:]), " ".join(words[-6:])


def _blocked(text: str, at: int, left: str) -> str:
    """Whether a word labels the number at a place as not personal: "" no, "?" unless its context is known as personal, "!" yes."""
    clause = _CLAUSE.split(text[max(0, at - 48) : at])[-1]
    words = list(_WORD.finditer(clause))[-6:]
    if not words:
        return ""
    near = clause[words[0].start() :].lower()
    last = max((m.start() for m in re.finditer(r"[a-z-]+", near) if m[0] in NOT_PERSONAL), default=-1)
    if last < 0 or any(m.start() > last for m in LABELS.finditer(near)):
        return ""
    own = set(re.findall(r"[^\W\d_][\w-]*", left)) - _BARE
    return "?" if own and not own & NOT_PERSONAL else "!"


def _right(text: str, at: int) -> str:
    line = text[at : at + 40]
    if not line.strip() or line[:1] == "\n":
        return "$"
    return " ".join(re.sub(r"\d+", "0", w.lower()) for w in _WORD.findall(line)[:2])


_FIRM_AFTER = re.compile(rf"[ \t]*(?:&|,[ \t]+{_N}[ \t]+(?:&|and[ \t]+Partners)|(?:[ \t]*[-&][ \t]*{_N})?[ \t]+(?:{'|'.join(re.escape(w) for w in sorted(FIRM_WORDS))})\b)")


def spans(text: str) -> list[tuple[str, int, int, str, str, str, bool]]:
    """Every candidate: kind (email, address, number, name, listed, titled), start, end, instance, left, right, seed."""
    out = []
    taken: list[tuple[int, int]] = []
    free = lambda lo, hi: not any(lo < b and a < hi for a, b in taken)
    low = text.lower()
    if any(k in low for k in _MAIL_MARKS):
        for m in EMAIL.finditer(text):
            spelled = re.sub(r"[\w.+%-]+", "x", re.sub(r"(?i)\b(at|dot)\b", lambda k: "@" if k[1].lower() == "at" else ".", m[0]))
            out.append(("email", m.start(), m.end(), "mail " + spelled, _left(text, m.start())[0], "", False))
            taken.append(m.span())
    for lo, hi, form in addresses(text):
        if free(lo, hi):
            out.append(("address", lo, hi, "street " + form, _left(text, lo)[0], "", False))
            taken.append((lo, hi))
    for m in NUMBER.finditer(text) if _DIGITS.search(text) else ():
        lo, hi = m.span("number")
        if free(lo, hi):
            left, _ = _left(text, lo)
            form = shape(m["number"])
            sure = any(p.search(form) for p in SEED_SHAPES.values())
            out.append(("number", lo, hi, form, left, "" if sure else _blocked(text, lo, left), False))
            taken.append((lo, hi))
    for m in LISTED.finditer(text) if _LISTED_END.search(text) else ():
        if free(*m.span()) and m["family"].split()[-1] not in FIRM_WORDS:
            out.append(("listed", m.start(), m.end(), m["given"].split()[0] + " " + m["family"], "<list>", "<list>", False))
            taken.append(m.span())
    for m in NAME.finditer(text):
        lo, hi = m.span("name")
        name = m["name"]
        words = name.split()
        if not m["title"] and len(words) < 2 or not free(lo, hi):
            continue
        if not m["title"] and (words[0].lower() in _PLACES or words[-1].lower() in _PLACES):
            continue
        if not m["title"] and any(w.endswith(("'s", "’s")) or (len(w) == 2 and w[1] != "." and w.isupper()) for w in words):
            continue
        if _FIRM_AFTER.match(text, hi) or any(w.strip(".,") in FIRM_WORDS for w in words):
            continue
        left, further = _left(text, m.start())
        if re.search(r"[&-] ?$", further[-2:]):
            continue
        out.append(("titled" if m["title"] else "name", lo, hi, name, "<title>" if m["title"] else left, _right(text, hi), bool(m["title"])))
    return out


#: Distinct words in lower case that a task counts before it sends them on.
VOCABULARY = 200_000
_LOWER = re.compile("[a-zß-ÿ]{3,}")


def candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The spans of all texts, and rows of kind lower: how often (lo) a task met a word (instance) in lower case."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["doc_key", "kind", "lo", "hi", "instance", "left", "right", "seed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        types, sent = None, 0

        def told() -> pa.RecordBatch:
            task = f"{TaskContext.get().partitionId()}.{sent}"  # keeps equal counts of several tasks apart
            n = len(words)
            cols = ([None] * n, ["lower"] * n, list(words.values()), [0] * n, list(words), [task] * n, [""] * n, [False] * n)
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for batch in batches:
            types = (batch.schema.types[0], pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(k, *s) for s in spans(t)]
                words.update(_LOWER.findall(t))
            cols = list(zip(*rows)) or [()] * 8
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=names)
            if len(words) > VOCABULARY:
                yield told()
                words.clear()
                sent += 1
        if words:
            yield told()

    return docs.select(F.col(key), F.col(text)).filter(F.col(text).isNotNull()).mapInArrow(run, f"doc_key {kind}, kind string, lo int, hi int, instance string, left string, right string, seed boolean")


def _spread(edges: DataFrame, seeds: DataFrame, kinds: list[str], rounds: int) -> tuple[DataFrame, DataFrame]:
    """Scores of contexts and instances for each kind. edges: context, instance, n; seeds: instance and a score a kind (clamped)."""
    scores, contexts = seeds, None
    mean = lambda k: (F.sum(F.coalesce(k, F.lit(UNKNOWN)) * F.log1p("n")) / F.sum(F.log1p("n"))).alias(k)
    for _ in range(rounds):
        contexts = edges.join(scores, "instance", "left").groupBy("context").agg(*[mean(k) for k in kinds], F.count("*").alias("support")).filter(F.col("support") >= SUPPORT).drop("support")
        learned = edges.join(contexts, "context").groupBy("instance").agg(*[mean(k) for k in kinds]).join(seeds.select("instance"), "instance", "left_anti")
        scores = cut_lineage(seeds.unionByName(learned))
    return cut_lineage(contexts), scores


def name_words(instance: F.Column) -> F.Column:
    """The words of a name in lower case, without initials and particles."""
    words = F.split(F.lower(instance), r"[ \t]+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*[p.lower() for p in PARTICLES]))


def found(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(key, pii_type, char_start, char_end): one row for each occurrence.

    Types are email, phone, id, address and name. Null and blank texts give no rows, equal rows the rows of one; other
    columns are ignored; an empty table gives none.
    """
    spots = cut_lineage(candidates(docs, key, text).distinct())
    # forms: contexts against the forms of numbers, mail and street addresses
    kinds = ["phone", "id", "email", "address"]
    formed = spots.filter("kind IN ('number', 'email', 'address')")
    edges = cut_lineage(formed.filter("right = ''").groupBy("instance", F.col("left").alias("context")).agg(F.count("*").alias("n")))
    busy_left = hot_keys(edges.withColumnRenamed("context", "left"), ["left"], weight="n")
    busy_form = hot_keys(edges, ["instance"], weight="n")
    sure = {k: F.col("instance").rlike(p.pattern) for k, p in SEED_SHAPES.items()}
    seeds = edges.select("instance").distinct().select("instance", *[F.when(sure[k], 1.0).otherwise(0.0).alias(k) for k in kinds]).filter(" OR ".join(f"{k} = 1.0" for k in kinds))
    ctx, inst = _spread(edges, cut_lineage(seeds), kinds, rounds)
    left = ctx.select(F.col("context").alias("left"), *[F.col(k).alias(f"{k}_ctx") for k in kinds])
    form = inst.select("instance", *[F.col(k).alias(f"{k}_inst") for k in kinds])
    n = salted_join(salted_join(formed, left, ["left"], busy_left, "left"), form, ["instance"], busy_form, "left")
    own = {"phone": "number", "id": "number", "email": "email", "address": "address"}
    value = {k: F.when(F.col("kind") == own[k], F.coalesce(F.when(F.col("right") == "", F.greatest(f"{k}_ctx", f"{k}_inst")).otherwise(F.col(f"{k}_ctx")), F.lit(0.0))).otherwise(0.0) for k in kinds}
    typed = n.filter("right <> '!'").withColumns({f"_{k}": v for k, v in value.items()}).withColumn("best", F.greatest(*[f"_{k}" for k in kinds])).filter(F.col("best") >= CERTAIN)
    by_ctx = lambda k: F.coalesce(F.col(f"{k}_ctx"), F.lit(0.0))
    as_id = (F.col("_id") > F.col("_phone")) | ((F.col("_id") == F.col("_phone")) & (by_ctx("id") > by_ctx("phone")))
    kind = F.when(F.col("kind") != "number", F.col("kind")).when(as_id, "id").otherwise("phone")
    shaped = typed.select("doc_key", kind.alias("pii_type"), F.col("lo").alias("char_start"), F.col("hi").alias("char_end"))
    # names: contexts on either side against the words of the names
    names = spots.filter("kind IN ('name', 'titled', 'listed')")
    worded = names.withColumn("words", name_words(F.col("instance")))
    sides = worded.select(F.explode("words").alias("instance"), F.array(F.concat(F.lit("L "), "left"), F.concat(F.lit("R "), "right")).alias("c"), "seed")
    edges = sides.select("instance", F.explode("c").alias("context")).filter(F.col("context").rlike("^[LR] .*[a-zß-ÿ]{2}") & (F.col("context") != "L <title>")).groupBy("context", "instance").agg(F.count("*").alias("n"))
    edges = cut_lineage(edges)
    capital = worded.select(F.explode("words").alias("instance"), "seed").groupBy("instance").agg(F.count("*").alias("upper"), F.max("seed").alias("titled"))
    lower = spots.filter("kind = 'lower'").groupBy("instance").agg(F.sum("lo").alias("lower"))
    known = cut_lineage(capital.join(lower, "instance", "left")).withColumn("common", F.coalesce("lower", F.lit(0)) >= COMMON * F.col("upper"))
    listed = F.array_contains(F.array(*[F.lit(w) for w in _NOT_NAMES]), F.col("instance"))
    seeds = known.withColumn("name", F.when(listed | F.col("common"), 0.0).when(F.col("titled"), 1.0)).filter("name IS NOT NULL").select("instance", "name")
    ctx, word = _spread(edges, seeds, ["name"], rounds)
    each = worded.select("doc_key", "lo", F.explode("words").alias("instance"))
    busy_word = hot_keys(known, ["instance"], weight="upper")
    known = salted_join(each, word.withColumnRenamed("name", "score"), ["instance"], busy_word, "left").groupBy("doc_key", "lo").agg(F.min(F.coalesce("score", F.lit(-1.0))).alias("least"), F.avg(F.coalesce("score", F.lit(UNKNOWN))).alias("mean"))
    lctx = ctx.filter("context LIKE 'L %'").select(F.expr("substring(context, 3)").alias("left"), F.col("name").alias("lv"))
    rctx = ctx.filter("context LIKE 'R %'").select(F.expr("substring(context, 3)").alias("right"), F.col("name").alias("rv"))
    side = lambda k, name: hot_keys(edges.filter(f"context LIKE '{k} %'").select(F.expr("substring(context, 3)").alias(name), "n"), [name], weight="n")
    judged = salted_join(salted_join(worded.join(known, ["doc_key", "lo"], "left"), lctx, ["left"], side("L", "left"), "left"), rctx, ["right"], side("R", "right"), "left")
    by_words = (F.col("least") >= CERTAIN) | ((F.col("mean") >= CERTAIN) & (F.greatest(F.coalesce("lv", F.lit(0.0)), F.coalesce("rv", F.lit(0.0))) >= CERTAIN))
    by_context = (F.coalesce("lv", F.lit(0.0)) >= 0.8) & (F.coalesce("rv", F.lit(0.0)) >= 0.8) & (F.coalesce("least", F.lit(-1.0)) != 0.0)
    by_context = by_context & F.col("left").rlike("[a-zß-ÿ]{2}") & (F.col("instance") != F.upper("instance"))
    kept = judged.filter(F.col("seed") | by_words | by_context)
    named = kept.select("doc_key", F.lit("name").alias("pii_type"), F.col("lo").alias("char_start"), F.col("hi").alias("char_end"))
    return shaped.unionByName(named).distinct().withColumnRenamed("doc_key", key)


# Words that open or close names of places.
PLACE_PARTS = "north south east west upper lower fort port new saint bay springs valley county city falls hills depot road street avenue".split()
# Names of months and days, which no text has in lower case, and words before item and note numbers.
CALENDAR = "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split()
HEADINGS = "section item rule note table class act part exhibit schedule".split()
_PLACES = frozenset(PLACE_PARTS + HEADINGS) | STOP_WORDS
_NOT_NAMES = sorted({*PLACE_PARTS, *CALENDAR, *HEADINGS, *STOP_WORDS})


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text with a typed placeholder in the place of each occurrence and nothing else changed, and their number.

    Texts without any come back as they are, nulls as null. Equal keys are taken to have equal texts.
    """
    hits = found(docs, key, text)
    rows = hits.groupBy(key).agg(F.collect_list(F.struct("char_start", "char_end", "pii_type")).alias("hits"))
    j = docs.select(key, text).join(rows, key, "left")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n = [], []
            for t, found_here in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts, at = [], 0
                for h in sorted(found_here or [], key=lambda h: h["char_start"]):
                    if h["char_start"] >= at:
                        parts.append(t[at : h["char_start"]] + f"[{h['pii_type'].upper()}]")
                        at = h["char_end"]
                out.append(t if t is None else "".join(parts) + t[at:])
                n.append(len(found_here or []))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string()), pa.array(n, pa.int32())], names=[key, "redacted", "n_found"])

    return j.mapInArrow(run, f"`{key}` {kind}, redacted string, n_found int")
