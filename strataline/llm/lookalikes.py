"""One consistent form for texts that look alike: a confusables skeleton.

The skeleton decomposes, replaces every character by the prototype it looks like, and decomposes again; texts of equal
skeleton are one group. Letters of another script count as look-alikes only within a word that also has Latin letters,
so words wholly in another script stay themselves.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and the Latin letter each one looks like.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "а": "a", "в": "b", "г": "r", "е": "e", "з": "3", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "һ": "h", "ӏ": "l", "Ӏ": "I", "ь": "b",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "γ": "y", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j",
    # Armenian
    "ո": "n", "ս": "u", "օ": "o", "հ": "h", "զ": "q", "ց": "g", "յ": "j", "Տ": "S", "Օ": "O", "Լ": "L",
    # Cherokee and Coptic
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "Ⲏ": "H", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T",
    # Latin letters outside the alphabet
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "L", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
}
# Hyphens other than the ordinary.
HYPHENS = "‐‑⁃﹣－֊᠆"
# Signs that are invisible though not of the category of format characters.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ"

_FORMS = {"<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<small>", "<vertical>"}


@lru_cache(maxsize=None)
def kind(ch: str) -> str:
    """How a character looks like another: form, mark, space, hyphen, invisible or letter; empty if it doesn't."""
    o, category = ord(ch), unicodedata.category(ch)
    if o < 0x7F:
        return ""
    if category == "Zs":
        return "space"
    if ch in HYPHENS:
        return "hyphen"
    if category == "Cf" or ch in INVISIBLE or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF:
        return "invisible"
    if category in ("Mn", "Me") and (0x300 <= o <= 0x36F or 0x1AB0 <= o <= 0x1AFF or 0x1DC0 <= o <= 0x1DFF or 0x20D0 <= o <= 0x20FF or 0xFE20 <= o <= 0xFE2F):
        return "mark"
    tag = unicodedata.decomposition(ch).split(" ")[0]
    if tag in _FORMS or 0xFB00 <= o <= 0xFB06 or 0xFB13 <= o <= 0xFB17 or 0x2160 <= o <= 0x217F:
        return "form"
    return "letter" if ch in LOOKALIKES else ""


@lru_cache(maxsize=None)
def prototype(ch: str) -> str:
    """What a character looks like, letters of other scripts aside."""
    k = kind(ch)
    if k == "space":
        return " "
    if k == "hyphen":
        return "-"
    if k == "invisible":
        return ""
    return unicodedata.normalize("NFKC", ch) if k == "form" else ch


@lru_cache(maxsize=None)
def script(ch: str) -> str:
    if not ch.isalpha():
        return ""
    name = unicodedata.name(ch, "")
    if name.startswith(("LATIN", "FULLWIDTH LATIN", "FEMININE ORDINAL", "MASCULINE ORDINAL", "MODIFIER LETTER", "MATHEMATICAL", "SCRIPT", "DOUBLE-STRUCK", "KELVIN", "ANGSTROM", "MICRO")):
        return "latin"
    return "other"


_WORD = re.compile(r"[^\W\d_]+")
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")
#: A text read in the wrong encoding shows the lead byte of a sequence as one of these letters.
_MISREAD = re.compile("[ÂÃÄÅÐÑ][\x80-\xbfŒ-Ÿˆ˜–-›€™]")


def skeleton(text: str) -> str:
    """Decomposed, by prototypes, decomposed again. Equal for texts that look alike."""
    if text.isascii():
        return text
    plain = "".join(map(prototype, unicodedata.normalize("NFD", text)))

    def latin(m: re.Match) -> str:
        word = m[0]
        if word.isascii() or not any(script(c) == "other" for c in word) or not any(script(c) == "latin" for c in word):
            return word
        return "".join(LOOKALIKES.get(c, c) for c in word)

    return unicodedata.normalize("NFD", _WORD.sub(latin, plain))


def canonical(text: str) -> str:
    """The skeleton in composed form: the one consistent form that is kept and shown."""
    return text if text.isascii() else unicodedata.normalize("NFC", skeleton(text))


def findings(text: str) -> list[str]:
    """The kinds of look-alikes in a value, sorted. Wrongly decoded sequences aren't any."""
    if text.isascii():
        return []
    found = set()
    rest = _MISREAD.sub(" ", text)
    for ch in set(_NOT_ASCII.findall(rest)):
        k = kind(ch)
        if k and k != "letter":
            found.add(k)
    if any(script(c) == "other" for c in set(_NOT_ASCII.findall(rest))):
        bare = "".join(prototype(c) for c in rest if kind(c) in ("", "letter", "form", "mark"))
        for word in _WORD.findall(bare):
            if not word.isascii() and any(script(c) == "other" for c in word) and any(script(c) == "latin" for c in word):
                found.add("letter")
                break
    return sorted(found)


#: Signs that are fine as they are; the rest of the text beyond ASCII is looked at closely.
_FINE = "[^\\x00-\\x7E¡-¬®-˿–—‘-„•…€™]"


def forms(values: DataFrame) -> DataFrame:
    """The consistent form of each value and what it held.

    values: record_id, field_name, value; other columns are ignored. Null values are dropped, empty ones stay as they
    are, repeated rows are kept. Only values beyond plain characters leave the JVM; an empty table gives no rows.

    Returns record_id, field_name, form (composed), skeleton_id (equal for values of equal skeleton), kinds.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("value").to_pylist()
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([canonical(t) for t in texts], pa.string()), pa.array([skeleton(t) for t in texts], pa.string()), pa.array([findings(t) for t in texts], pa.list_(pa.string()))],
                names=["record_id", "field_name", "form", "skeleton", "kinds"],
            )

    v = values.select(F.col("record_id").cast("string").alias("record_id"), F.col("field_name").cast("string").alias("field_name"), F.col("value").cast("string").alias("value")).filter("value IS NOT NULL")
    beyond = F.octet_length("value") > F.length("value")
    plain = v.filter(~beyond).select("record_id", "field_name", F.col("value").alias("form"), F.col("value").alias("skeleton"), F.array().cast("array<string>").alias("kinds"))
    rest = v.filter(beyond).mapInArrow(run, "record_id string, field_name string, form string, skeleton string, kinds array<string>")
    return plain.unionByName(rest).select("record_id", "field_name", "form", F.sha2("skeleton", 256).alias("skeleton_id"), "kinds")


def found(values: DataFrame) -> DataFrame:
    """(record_id, field_name) of the values that hold a look-alike; columns and special cases as in forms()."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("value").to_pylist()
            kinds = [findings(t) for t in values]
            keep = [bool(k) and ("mark" in k or "letter" in k or skeleton(t) != unicodedata.normalize("NFD", t)) for k, t in zip(kinds, values)]
            yield batch.select(["record_id", "field_name"]).filter(pa.array(keep, pa.bool_()))

    v = values.select(F.col("record_id").cast("string").alias("record_id"), F.col("field_name").cast("string").alias("field_name"), F.col("value").cast("string").alias("value"))
    return v.filter((F.octet_length("value") > F.length("value")) & F.col("value").rlike(_FINE)).mapInArrow(run, "record_id string, field_name string").distinct()


def groups(formed: DataFrame) -> DataFrame:
    """skeleton_id, size, form (the least): how many values look alike, counted before they meet; no group is gathered."""
    return formed.groupBy("skeleton_id").agg(F.count("*").alias("size"), F.min("form").alias("form"))


def quotes_in_chunks(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """citation_id, field_name, in_chunk: whether the quote stands in its chunk under the consistent form.

    White space counts as one space each way. An empty or null quote gives false, a chunk_id without a chunk false.
    """
    texts = chunks.groupBy("chunk_id").agg(F.max("text").alias("text"))
    j = citations.select("citation_id", "chunk_id", "quote", "support_quote").join(texts, "chunk_id", "left")

    def flat(t: str | None) -> str:
        return " ".join(canonical(t or "").split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, hits = [], [], []
            for c, text, *both in zip(*(batch.column(k).to_pylist() for k in ("citation_id", "text", "quote", "support_quote"))):
                whole = flat(text)
                for name, q in zip(("quote", "support_quote"), both):
                    ids.append(c)
                    names.append(name)
                    hits.append(bool(q and q.strip()) and flat(q) in whole)
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(names, pa.string()), pa.array(hits, pa.bool_())], names=["citation_id", "field_name", "in_chunk"])

    return j.mapInArrow(run, "citation_id string, field_name string, in_chunk boolean")
