"""Markup left in texts: recognised, removed, its structure kept.

A text is cut into blocks at line breaks and block-level markup. Pass one classifies each block by stop-word density,
length and link density; pass two gives short ambiguous blocks the label of the nearest decided block. Blocks are then
converted by their label: syntax in noise isn't markup and stays, code and formulas keep their text.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Function words of the four languages of the tables.
STOP_WORDS = frozenset(
    """the of and to in for a an as is are was were be been by that this on with from or our we at may its which not any has have had will than into against under
    over after before until during between through because while although whereas however so such each other it they their he she his her no all also can could would
    der die das und in zu von mit für auf ist im den des ein eine nicht dem als auch werden wurde wir
    le la les des et en du un une pour dans est que qui par sur au aux ne pas plus nous
    el los las y de que en un una por con para se del al es no su""".split()
)
# Names of HTML elements.
TAGS = (
    "a abbr address article aside b base big blockquote body br button caption center cite code col colgroup dd del dfn div dl dt em embed fieldset figcaption figure "
    "font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol option p param pre "
    "q s samp script section select small span strike strong style sub sup svg table tbody td textarea tfoot th thead title tr tt u ul var video"
).split()
_TAG = r"</?(?:%s|[a-z][\w-]*:[a-z][\w-]*)(?:\s[^<>]*)?/?>" % "|".join(TAGS)
# LaTeX commands that take no argument.
_BARE = (
    "item alpha beta gamma delta epsilon theta lambda mu pi rho sigma tau phi omega Delta Sigma Omega sum prod int frac sqrt times cdot leq geq neq approx infty partial "
    "ldots dots hline toprule midrule bottomrule noindent newpage clearpage centering maketitle tableofcontents par quad qquad newline linebreak pagebreak bigskip medskip "
    "smallskip left right small large Large footnotesize bf it em tt rm textbackslash LaTeX TeX S P dag ddag copyright pounds"
)

PATTERNS: dict[str, list[str]] = {
    "html": [
        r"(?i)" + _TAG,
        r"<!--|-->|<!DOCTYPE\b|<!\[CDATA\[|<\?xml\b",
        r"&(?:[A-Za-z][A-Za-z0-9]+|#\d+|#[xX][0-9A-Fa-f]+);",
    ],
    "markdown": [
        r"(?m)^ {0,3}#{1,6}[ \t]+\S",
        r"(?m)^(?=[^\n]*[^\W\d_]{2})[^\n|<=-][^\n]*\n(?:={4,}|-{4,})[ \t]*$",
        r"(?<![\w*\\])\*\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*\*(?![\w*])",
        r"(?:(?<=[\s(\"“])|^)__(?=[^\W_])(?!(?:NO)?TOC__|[A-Z]+__)[^_\n=]+?(?<=[\w.,;:!?)])__(?=[\s.,;:!?)]|$)",
        r"(?<![\w*\\])\*(?=[^\W_])[^*\n]*?(?<=[\w.,;:!?)])\*(?![\w*])",
        r"(?:(?<=[\s(\"“])|^)_(?=[^\W\d_])[^_\n=]*?(?<=[^\W\d_])[.,;:!?]?_(?=[\s.,;:!?)]|$)",
        r"!?\[[^\[\]\n]+\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)",
        r"(?m)^ {0,3}\[[^\[\]\n^]+\]:[ \t]*\S+",
        r"\[\^\w+\]",
        r"(?m)^ {0,3}(?:```|~~~)[\w+-]*[ \t]*$",
        r"(?<![`\\])`[^`\s\n][^`\n]*`(?!`)",
        r"(?m)^ {0,3}>[ \t]+(?=\*\*|[A-Z\"“(])",
        r"(?m)^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{3,}:?[ \t]*\|[ \t]*$",
        r"(?m)^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]",
        r"(?<![\w~])~~(?=[^\s~])[^~\n]+~~(?![\w~])",
        r"(?m)^ {0,3}(?:\*[ \t]?){3,}$",
    ],
    "wiki": [
        r"\[\[[^\[\]\n]+\]\]",
        r"\{\{[^{}\n]+\}\}",
        r"(?<!')'''?(?=[^\s'])[^'\n]*(?:'(?!')[^'\n]*)*(?<=[^\s'])'''?(?!')",
        r"(?m)^(={2,6})[ \t]*[^=\n][^\n]*?[ \t]*\1[ \t]*$",
        r"(?m)^\{\|[^\n]*$|^\|\}[ \t]*$|^\|-[^\n-]*$",
        r"__(?:NO)?(?:TOC|EDITSECTION|FORCETOC|INDEX|NOINDEX|GALLERY|NOGALLERY)__",
        r"\[https?://[^\s\]]+ [^\]\n]+\]",
        r"(?i)<ref(?:\s[^<>]*)?/?>|</ref>|</?nowiki>|<references ?/>",
        r"#REDIRECT\b",
        r"(?<!~)~{3,5}(?=\s|$)(?!\n)",
    ],
    "latex": [
        r"(?<![\w:\\])\\(?:[A-Za-z]+\*?)(?:\[[^\]\n]*\])?\{",
        r"\\(?:begin|end)\{[a-zA-Z*]+\}",
        r"(?<![\w:\\])\\(?:%s)(?![A-Za-z\\])" % "|".join(_BARE.split()),
        r"(?<![\\\w])\\[$%&#_](?=[\s\d\w.,;)]|$)|(?<=\d)\\%",
        r"(?m)\\\\(?:\[\d[^\]\n]*\])?[ \t]*(?:\\hline)?[ \t]*$",
        r"\\\(|\\\)|\\\[(?=[^\n]*[\w\\])|\\\]",
        r"\$(?=[^$\n]*[\\^_])[^$\n\s](?:[^$\n]*[^$\n\s])?\$(?!\d)",
        r"``[^`'\n]+''",
        r"[A-Za-z.]~\\(?:ref|cite|eqref)",
    ],
}
_COMPILED = {k: [re.compile(p) for p in ps] for k, ps in PATTERNS.items()}
_ENTITY = re.compile(PATTERNS["html"][2])
#: A text without any of these can hold no syntax.
SUSPECT = r"[<>&#*_`|\\\[\]{}~]|''|==|----"

_TOKEN = re.compile(r"\S+")
_LINK = re.compile(r"(?i)https?://\S+|www\.\S+|\[\[[^\]]*\]\]|\]\([^)]*\)|<a\s[^>]*>")
_SYMBOLS = re.compile(r"[^\w\s.,;:'\"()$%–—’“”•-]")


def _hits(kind: str, text: str) -> Iterator[re.Match]:
    for p in _COMPILED[kind]:
        for m in p.finditer(text):
            if p.pattern == _ENTITY.pattern and html.unescape(m[0]) == m[0]:
                continue
            yield m


def _spans(text: str) -> list[tuple[int, int, str]]:
    return sorted((m.start(), m.end(), k) for k in PATTERNS for m in _hits(k, text))


_ENVIRONMENTS = "equation|align|displaymath|eqnarray|gather|verbatim|lstlisting"
_EDGE = re.compile(
    rf"(?im)(?P<fence>^ {{0,3}}(?:```|~~~).*$)|<(?P<close>/?)(?P<tag>pre|script|style|ref|tr|h[1-6])\b[^<>]*>|\\(?P<role>begin|end)\{{(?P<env>{_ENVIRONMENTS})\*?\}}|(?P<left>\\\[)|(?P<right>\\\])|(?P<open><!--)|(?P<shut>-->)"
)
#: What a construct of several lines holds, where it isn't running text.
_HELD = {"pre": "code", "fence": "code", "verbatim": "code", "lstlisting": "code", "[": "formula"} | {k: "formula" for k in ("equation", "align", "displaymath", "eqnarray", "gather")}


def _constructs(text: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of constructs that stay in one block, in order, none within another; each mark is looked at once."""
    opens: list[tuple[int, int, str]] = []
    closes: dict[str, list[int]] = {}
    for m in _EDGE.finditer(text):
        if m["fence"]:
            opens.append((m.start(), m.end(), "fence"))
            closes.setdefault("fence", []).append(m.end())
        elif m["tag"]:
            if m["close"]:
                closes.setdefault(m["tag"].lower(), []).append(m.end())
            elif not m[0].endswith("/>"):
                opens.append((m.start(), m.end(), m["tag"].lower()))
        elif m["env"]:
            (closes.setdefault(m["env"], []).append(m.end()) if m["role"] == "end" else opens.append((m.start(), m.end(), m["env"])))
        elif m["left"] or m["open"]:
            opens.append((m.start(), m.end(), "[" if m["left"] else "<!--"))
        else:
            closes.setdefault("[" if m["right"] else "<!--", []).append(m.end())
    out: list[tuple[int, int, str]] = []
    at = 0
    for lo, hi, name in opens:
        if lo < at:
            continue
        ends = closes.get(name, [])
        k = bisect.bisect_right(ends, hi)
        if k < len(ends):
            at = ends[k]
            out.append((lo, at, name))
    return out


def classify(blocks: list[str], bare: list[str]) -> list[str]:
    """text, structure or noise for each block; bare is the block without its recognised syntax."""
    labels: list[str] = []
    for block, rest in zip(blocks, bare):
        tokens = _TOKEN.findall(rest)
        solid = sum(map(len, tokens))
        signs = rest.replace("|", " ").replace("!", " ") if rest.lstrip()[:1] in ("|", "!") else rest  # a row of a table
        symbols = len(_SYMBOLS.findall(signs)) / solid if solid else 0.0
        words = [t.strip(".,;:!?()\"'").lower() for t in tokens]
        density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        links = sum(len(m[0]) for m in _LINK.finditer(block)) / max(1, len(block))
        if not solid and block.strip():
            labels.append("structure")  # nothing but syntax
        elif symbols > 0.25 and density < 0.1 and solid > 3:
            labels.append("noise")
        elif density >= 0.15 and len(tokens) >= 6:
            labels.append("text")
        elif links > 0.5 or (block != rest and solid):
            labels.append("structure")
        elif len(tokens) >= 12:
            labels.append("structure")
        else:
            labels.append("")  # short and ambiguous
    before, after = _nearest(labels), _nearest(labels[::-1])[::-1]
    out = list(labels)
    for k, x in enumerate(labels):
        if not x:
            lo, hi = before[k], len(labels) - 1 - after[k] if after[k] >= 0 else -1
            near = lo if hi < 0 or (lo >= 0 and k - lo <= hi - k) else hi
            out[k] = labels[near] if near >= 0 else "text"
    return out


def _nearest(labels: list[str]) -> list[int]:
    """Place of the last decided label up to each place, -1 where there is none."""
    out, last = [], -1
    for k, x in enumerate(labels):
        last = k if x else last
        out.append(last)
    return out


def labelled(text: str) -> list[tuple[str, str, set[str]]]:
    """(block, label, kinds of syntax in it) of a text, in order; the blocks make up the text.

    Blocks end at line breaks outside of syntax and of constructs of several lines. Labels are text, structure, noise,
    code and formula. Time grows with the length of the text and the number of marks in it, up to a logarithm.
    """
    spans = _spans(text)
    whole = _constructs(text) if spans else []
    if not spans:
        return [(text, "text", set())] if text else []
    closed: list[list[int]] = []  # stretches without an edge, merged
    for lo, hi, _ in sorted([*spans, *whole]):
        if closed and lo < closed[-1][1]:
            closed[-1][1] = max(closed[-1][1], hi)
        else:
            closed.append([lo, hi])
    edges, k = [0], 0
    at = text.find("\n")
    while at >= 0:
        while k < len(closed) and closed[k][1] <= at:
            k += 1
        if not (k < len(closed) and closed[k][0] < at + 1 and at + 1 < closed[k][1]):
            edges.append(at + 1)
        at = text.find("\n", at + 1)
    if edges[-1] < len(text):
        edges.append(len(text))
    cuts = list(zip(edges, edges[1:]))
    starts = [lo for lo, _ in cuts]
    inside: list[list[tuple[int, int, str]]] = [[] for _ in cuts]
    for x in spans:
        inside[bisect.bisect_right(starts, x[0]) - 1].append(x)
    held = {bisect.bisect_right(starts, lo) - 1: _HELD[name] for lo, _, name in whole if name in _HELD}
    bare = []
    for (lo, hi), own in zip(cuts, inside):
        keep, place = [], lo
        for a, b, _ in own:
            if b <= hi and b > place:
                keep.append(text[place : max(place, a)])
                place = b
        bare.append("".join(keep) + text[place:hi])
    blocks = [text[lo:hi] for lo, hi in cuts]
    labels = classify(blocks, bare)
    return [(block, held.get(i, label), {k for _, _, k in own}) for i, (block, label, own) in enumerate(zip(blocks, labels, inside))]


def residues(text: str) -> list[str]:
    """The kinds of markup with syntax left in blocks that aren't noise."""
    return sorted({k for _, label, kinds in labelled(text) if label != "noise" for k in kinds})


# ---- cleaning --------------------------------------------------------------------------------------------------------

_RULES: list[tuple[str, str]] = [  # in this order; \x01 opens and \x02 closes a block mark: kind, level
    (r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>|<\?xml[^>]*\?>", ""),
    (r"(?is)<(script|style)\b[^>]*>.*?</\1>", ""),
    (r"(?is)<pre[^>]*>\s*(?:<code[^>]*>)?(.*?)(?:</code>)?\s*</pre>", "\n\x01code\x02\\1\n\x01end\x02\n"),
    (r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1>", "\n\x01h\\1\x02\\2\n"),
    (r"(?i)<li\b[^>]*>", "\n\x01li\x02"),
    (r"(?i)</t[dh]>\s*(?=<t[dh]\b)", "\t"),
    (r"(?i)<tr\b[^>]*>", "\n\x01tr\x02"),
    (r"(?i)<br\s*/?>|</?(?:p|div|ul|ol|li|tr|table|blockquote|section|article|hr|body|html|thead|tbody|dl|dd|dt)\b[^<>]*>", "\n"),
    (r"(?i)<ref(?:\s[^<>]*)?/>|<ref(?:\s[^<>]*)?>[^<]*</ref>|</?nowiki>|<references ?/>", ""),
    (r"(?i)" + _TAG, ""),
    (r"(?m)^ {0,3}(?:```|~~~)[\w+-]*[ \t]*\n((?:(?!```|~~~).*\n?)*?) {0,3}(?:```|~~~)[ \t]*$", "\x01code\x02\\1\n\x01end\x02"),
    (r"(?s)\\begin\{(?:verbatim|lstlisting)\}(?:\[[^\]]*\])?\n?(.*?)\\end\{(?:verbatim|lstlisting)\}", "\n\x01code\x02\\1\n\x01end\x02\n"),
    (r"(?s)\\begin\{(equation|align|displaymath|eqnarray|gather)\*?\}(.*?)\\end\{\1\*?\}", "\n\x01formula\x02\\2\n\x01end\x02\n"),
    (r"(?s)\\\[(.*?)\\\]", "\n\x01formula\x02\\1\n\x01end\x02\n"),
    (r"(?m)^[ \t]*\\hline[ \t]*$\n?", ""),
    (r"\\(?:begin|end)\{[a-zA-Z*]+\}(?:\[[^\]]*\])?(?:\{[lcrp|@{}. \d]*\})?", "\n"),
    (r"\\(?:part|chapter)\*?\{([^{}]*)\}", "\n\x01h1\x02\\1\n"),
    (r"\\section\*?\{([^{}]*)\}", "\n\x01h2\x02\\1\n"),
    (r"\\sub(?:sub)?section\*?\{([^{}]*)\}", "\n\x01h3\x02\\1\n"),
    (r"[ \t]*\\item\b(?:\[[^\]]*\])?[ \t]*", "\n\x01li\x02"),
    (r"\\href\{[^{}]*\}\{([^{}]*)\}", "\\1"),
    (r"~?\\(?:label|index|vspace|hspace|bibliography|bibliographystyle|usepackage|documentclass|includegraphics)\*?(?:\[[^\]]*\])?\{[^{}]*\}", ""),
    (r"~?\\(?:cite|ref|eqref|pageref)[a-z]*\*?(?:\[[^\]]*\])?\{([^{}]*)\}", " [\\1]"),
    (r"(?<![\w:\\])\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", "\\1"),
    (r"(?<![\w:\\])\\(?:noindent|centering|newpage|clearpage|maketitle|par|bigskip|medskip|smallskip|toprule|midrule|bottomrule)(?![A-Za-z])[ \t]*", ""),
    (r"(?m)^(.*?)[ \t]*\\\\[ \t]*$", "\x01tr\x02\\1"),
    (r"(?<![\\\w])\\([$%&#_{}])|(?<=\d)\\(%)", "\\1\\2"),
    (r"``([^`'\n]*)''", '"\\1"'),
    (r"(?m)^\{\|[^\n]*$\n?|^\|\}[ \t]*$\n?|^\|-[^\n]*$\n?", ""),
    (r"(?m)^!(?!\[)[ \t]*(.*)$", "\x01tr\x02\\1"),
    (r"__(?:NO)?(?:TOC|EDITSECTION|FORCETOC|INDEX|NOINDEX)__", ""),
    (r"(?m)^(={2,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*$", "\x01h2\x02\\2"),
    (r"\[\[(?:File|Image|Category):[^\[\]\n]*\]\]", ""),
    (r"\[\[:?(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]", "\\1"),
    (r"\{\{(?:convert|as of|nowrap|lang)\|([^{}|\n]*)(?:\|([^{}\n]*))?\}\}", "\\1 \\2"),
    (r"\{\{[^{}\n]*\}\}", ""),
    (r"\[https?://[^\s\]]+ ([^\]\n]+)\]", "\\1"),
    (r"'''?(?=[^\s'])([^\n]*?)(?<=[^\s'])'''?(?!')", "\\1"),
    (r"(?m)^(?=[^\n]*[^\W\d_]{2})([^\n|<=\x01-][^\n]*)\n(?:={4,}|-{4,})[ \t]*$", "\x01h2\x02\\1"),
    (r"(?m)^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*$", "\x01h2\x02\\2"),
    (r"(?m)^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*$\n?", ""),
    (r"(?m)^[ \t]*\|(.*?)\|?[ \t]*$", "\x01tr\x02\\1"),
    (r"!\[([^\[\]\n]*)\]\([^()\s]*(?:\s+\"[^\"\n]*\")?\)", "\\1"),
    (r"\[([^\[\]\n]+)\]\([^()\s]*(?:\s+\"[^\"\n]*\")?\)", "\\1"),
    (r"(?<![\w*\\])(\*\*|__|~~)(?=[^\s*_])([^*\n]+?)\1(?![\w*])", "\\2"),
    (r"(?<![\w*\\])\*(?=[^\W_])([^*\n]*?)(?<=[\w.,;:!?)])\*(?![\w*])", "\\1"),
    (r"(?<![\w_\\/.])_(?=[^\W_])([^_\n]*?)_(?![\w_])", "\\1"),
    (r"(?<![`\\])`([^`\s\n][^`\n]*)`(?!`)", "\\1"),
    (r"(?m)^ {0,3}>[ \t]+", ""),
    (r"(?m)^[ \t]*[*+-][ \t]+(?=\S)", "\x01li\x02"),
]
_CLEAN = [(re.compile(p), r) for p, r in _RULES]
_MARK = re.compile("\x01([a-z]+\\d?)\x02")


def blocks_of(text: str) -> list[dict]:
    """kind (heading, item, row, code, formula, text), level and text of each block of a text, markup removed.

    Blocks are classified first; those of noise stay as they are, the others are converted.
    """
    return _blocks(labelled(text.replace("\x01", "").replace("\x02", "")))


def _blocks(parts: list[tuple[str, str, set[str]]]) -> list[dict]:
    out: list[dict] = []
    for block, label, _ in parts:
        if not block.strip():
            continue
        if label == "noise" or not _SYNTAX.search(block):
            out += [{"kind": "text", "level": 0, "text": x.strip().replace("\xa0", " ")} for x in block.split("\n") if x.strip()]
        else:
            out += _converted(block)
    return out


def unmarked(text: str) -> str:
    """The clean text where there is markup in it, else the text as it is."""
    parts = labelled(text.replace("\x01", "").replace("\x02", ""))
    return joined(_blocks(parts)) if any(label != "noise" and kinds for _, label, kinds in parts) else text


_SYNTAX = re.compile(SUSPECT + r"|^[ \t]*[*+!-][ \t]|-{3,}|~|\t", re.M)


def _converted(t: str) -> list[dict]:
    for p, r in _CLEAN:
        t = p.sub(r, t)
    t = html.unescape(t).replace("\xa0", " ")
    out: list[dict] = []
    held: dict | None = None
    for line in t.split("\n"):
        m = _MARK.match(line.lstrip())
        mark, rest = (m[1], _MARK.sub("", line.lstrip()[m.end() :])) if m else ("", _MARK.sub("", line))
        if held is not None:
            if mark == "end":
                held["text"] = held["text"].strip("\n")
                if held["text"].strip():
                    out.append(held)
                held = None
                if rest.strip():
                    out.append({"kind": "text", "level": 0, "text": rest.strip()})
            else:
                held["text"] += ("\n" if held["text"] else "") + rest
        elif mark in ("code", "formula"):
            held = {"kind": mark, "level": 0, "text": rest}
        elif (body := rest.strip()) and mark != "end":
            if mark == "tr":
                cells = re.split(r"\s*(?:\|\||!!|\||(?<!\\)&|\t)\s*", body)
                out.append({"kind": "row", "level": 0, "text": "\t".join(c for c in cells if c)})
            else:
                kind = "heading" if mark.startswith("h") and mark[1:].isdigit() else "item" if mark == "li" else "text"
                out.append({"kind": kind, "level": int(mark[1:]) if kind == "heading" else 0, "text": body})
    if held is not None and held["text"].strip():
        out.append(held)
    return out


def clean(text: str) -> str:
    """The plain text: headings and paragraphs on their own, items after a bullet, cells between tabs, code and formulas as they are."""
    return joined(blocks_of(text))


def joined(blocks: list[dict]) -> str:
    out, before = [], ""
    for b in blocks:
        line = "• " + b["text"] if b["kind"] == "item" else b["text"]
        out.append(("\n" if b["kind"] in ("item", "row") and b["kind"] == before else "\n\n") + line if out else line)
        before = b["kind"]
    return "".join(out)


def found(docs: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, markup): one row for each kind of markup that left syntax in the text.

    Null and blank texts give no rows, equal rows give one, an empty table none; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, m) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in residues(t)]
            keys, kinds = zip(*rows) if rows else ((), ())
            yield pa.record_batch([pa.array(keys, batch.schema.types[0]), pa.array(kinds, pa.string())], names=[key, "markup"])

    kind = df_type(docs, key)
    return docs.select(key, text).filter(F.col(text).rlike(SUSPECT)).mapInArrow(run, f"`{key}` {kind}, markup string").distinct()


def df_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def cleaned(docs: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """key, clean_text, blocks: every row's text without markup, and its structure.

    Texts without any suspect sign come back as one text block, unchanged; null stays null with no blocks, blank
    becomes empty; repeated rows are kept.
    """
    block = "array<struct<kind: string, level: int, text: string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        typ = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())]))
        for batch in batches:
            blocks = [blocks_of(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([joined(b) for b in blocks], pa.string()), pa.array(blocks, typ)], names=[key, "clean_text", "blocks"])

    d = docs.select(key, text)
    suspect = F.coalesce(F.col(text).rlike(SUSPECT), F.lit(False))
    plain = d.filter(~suspect).select(key, F.when(F.trim(text) == "", "").otherwise(F.col(text)).alias("clean_text"))
    one = F.array(F.struct(F.lit("text").alias("kind"), F.lit(0).alias("level"), F.col("clean_text").alias("text")))
    plain = plain.withColumn("blocks", F.when(F.coalesce(F.col("clean_text"), F.lit("")) == "", F.array().cast(block)).otherwise(one.cast(block)))
    return plain.unionByName(d.filter(suspect).mapInArrow(run, f"`{key}` {df_type(docs, key)}, clean_text string, blocks {block}"))
