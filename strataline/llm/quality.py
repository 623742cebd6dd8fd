"""Statistics that tell natural prose from lists, tables and junk, and boosted trees over them.

A text is cut into segments (lines, long ones every SEGMENT bytes at a space). Statistics of all segments of a batch are
taken at once from its bytes. Trees trained on the weakly labelled segments of all texts, and calibrated on a holdout
checked by hand, give each segment a class from its own statistics and those around it; the class that holds more than
half of the characters of a text is its kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm import markup
from strataline.llm.boosting import Boosted, fit_all
from strataline.llm.holdout import HELD_TITLES, SEGMENTS, TITLES
from strataline.session import cut_lineage

SEGMENT = 240
CLASSES = ("prose", "list", "table", "junk")
#: Expected share of the characters of a text, or probability of a title, from which its kind counts.
MAJORITY = 0.5

FEATURES = (
    "bytes", "words", "word_len", "stop", "letters", "digits", "symbols", "spaces", "beyond", "upper", "vowels", "numbers", "mixed", "short", "novowel", "leaders",
    "bullet", "ends", "commas", "tabs", "gaps", "repeats", "title", "bigrams", "separators", "money", "whole",
)


def _lut(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[list(chars)] = 1
    return out


_LOWER, _UPPER, _DIGIT = _lut(range(97, 123)), _lut(range(65, 91)), _lut(range(48, 58))
_LETTER = _LOWER + _UPPER
_VOWEL = _lut(b"aeiouyAEIOUY")
_BEYOND = _lut(range(128, 256))
_SPACE = _lut(b" \t\r\n\x0b\x0c")
_ODD = _lut(b"#<>@\\^_|~*+=/{}[]`;&!?")
_NUMERIC = _lut(b"0123456789$%(),.-+")
_CODE = np.full(256, 26, np.int64)
for _k in range(26):
    _CODE[97 + _k] = _CODE[65 + _k] = _k
_BULLETS = tuple(x.encode() for x in ("•", "–", "—", "▪", "◦", "‣", "·", "●", "■", "-", "*"))
_NUMBERED = re.compile(rb"(?:\(?(?:[0-9]{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)]|[0-9]{1,3}\.[0-9]{1,3})[ \t]+(?=[A-Za-z(])")


def _flag(chars: bytes) -> np.ndarray:
    return _lut(chars).astype(np.int64)


#: Flags of three kinds of bytes in one number each, for running sums of three counts at once.
_PACKED = [
    _LETTER.astype(np.int64) | _DIGIT.astype(np.int64) << 21 | _VOWEL.astype(np.int64) << 42, _NUMERIC.astype(np.int64) | _ODD.astype(np.int64) << 21 | _SPACE.astype(np.int64) << 42,
    _BEYOND.astype(np.int64) | _UPPER.astype(np.int64) << 21 | _flag(b",") << 42, _flag(b"\t") | _flag(b"|\xbb") << 21 | _flag(b"$") << 42,
]


def _running(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


class Segments:
    """Byte ranges of the segments of some texts, with the text each one is of."""

    def __init__(self, texts: list[str]):
        raw = [t.replace("\r", "\n").encode("utf-8", "replace") for t in texts]
        self.a = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        lens = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        offsets = np.concatenate(([0], np.cumsum(lens)))
        ends = np.flatnonzero(self.a == 10)
        starts = np.concatenate(([0], ends[:-1] + 1))
        long = np.flatnonzero(ends - starts > SEGMENT * 3 // 2)
        if len(long):  # cut long lines at spaces
            cuts = []
            for k in long:
                lo, hi = int(starts[k]), int(ends[k])
                at = lo + SEGMENT
                while at < hi - SEGMENT // 2:
                    spaces = np.flatnonzero(self.a[at : min(at + SEGMENT // 2, hi)] == 32)
                    at += int(spaces[0]) if len(spaces) else 0
                    cuts.append(at)
                    at += SEGMENT
            cuts = np.array(cuts, np.int64)
            starts = np.sort(np.concatenate((starts, cuts)))
            ends = np.sort(np.concatenate((ends, cuts)))
        filled = ends > starts
        self.starts, self.ends = starts[filled], ends[filled]
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        self.whole = (self.starts == 0) | (self.a[np.maximum(self.starts - 1, 0)] == 10)

    def texts(self) -> list[str]:
        b = self.a.tobytes()
        return [b[lo:hi].decode("utf-8", "replace") for lo, hi in zip(self.starts, self.ends)]


_BASE = np.uint64(1099511628211)


def _stop_hashes() -> np.ndarray:
    return np.array(sorted(_word_hash(w.encode()) for w in markup.STOP_WORDS), np.uint64)


def _word_hash(w: bytes) -> int:
    h = 0
    for b in w:
        h = (h * 1099511628211 + b + 1) & (2**64 - 1)
    return h


def statistics(s: Segments, bigrams: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each segment."""
    a, lo, hi = s.a, s.starts, s.ends
    n = len(lo)
    if not n:
        return np.zeros((0, len(FEATURES)))
    size = (hi - lo).astype(np.float64)

    def sums(*flags: np.ndarray) -> np.ndarray:
        """Running sums of up to three arrays of 0 and 1 in one pass, in 21 bits each; differences of them are exact below 2 million."""
        packed = np.zeros(len(a), np.int64)
        for k, f in enumerate(flags):
            packed |= f.astype(np.int64) << (21 * k)
        return _running(packed)

    def parts(total: np.ndarray, first: np.ndarray, end: np.ndarray, n: int = 3) -> list[np.ndarray]:
        d = total[end] - total[first]
        return [((d >> (21 * k)) & 0x1FFFFF).astype(np.float64) for k in range(n)]

    # words
    space = _SPACE[a] > 0
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    ws, we = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    seg = np.searchsorted(lo, ws, side="right") - 1
    ok = (seg >= 0) & (ws < hi[np.maximum(seg, 0)])
    ws, we, seg = ws[ok], we[ok], seg[ok]
    words = np.bincount(seg, minlength=n).astype(np.float64)
    some = np.maximum(words, 1)

    wl = (we - ws).astype(np.float64)
    kinds, more, marks, signs = _running(_PACKED[0][a]), _running(_PACKED[1][a]), _running(_PACKED[2][a]), _running(_PACKED[3][a])
    letters, digits, vowels = parts(kinds, ws, we)
    (numeric,) = parts(more, ws, we, 1)
    s_letters, s_digits, s_vowels = parts(kinds, lo, hi)
    _, s_odd, s_cells = parts(more, lo, hi)
    s_beyond, s_upper, s_commas = parts(marks, lo, hi)
    s_tabs, s_bars, s_money = parts(signs, lo, hi)
    share = lambda mask: np.bincount(seg, mask.astype(np.float64), n) / some
    number = (digits > 0) & (numeric == wl)
    # hash of each word, in lower case without a sign at its end, for stop words and repeats
    low = a + ((a >= 65) & (a <= 90)) * np.uint8(32)
    tail = _LETTER[a[np.maximum(we - 1, 0)]] == 0
    core = np.minimum(we - ws - tail, 16)
    order = np.argsort(-core.astype(np.int8), kind="stable")  # long ones first, so that those with a k-th letter stand together
    first, longer = ws[order], np.cumsum(np.bincount(core, minlength=17)[::-1])[::-1]
    sorted_h = np.zeros(len(ws), np.uint64)
    for k in range(int(core.max()) if len(core) else 0):
        on = sorted_h[: longer[k + 1]]
        on *= _BASE
        on += low[first[: len(on)] + k]
        on += np.uint64(1)
    h = np.empty_like(sorted_h)
    h[order] = sorted_h
    stops = _stop_hashes()
    stop = (stops[np.minimum(np.searchsorted(stops, h), len(stops) - 1)] == h) & (letters > 0)
    pair = np.zeros(len(ws), np.uint64)
    pair[1:] = h[1:] * _BASE + h[:-1]
    of = s.doc[seg].astype(np.uint64) << np.uint64(44)
    distinct = np.unique(of | (pair >> np.uint64(20)))
    per_doc_words = np.bincount(s.doc[seg], minlength=int(s.doc.max()) + 1)
    per_doc_pairs = np.bincount((distinct >> np.uint64(44)).astype(np.int64), minlength=len(per_doc_words))
    repeats = np.where(per_doc_words >= 15, 1 - per_doc_pairs / np.maximum(per_doc_words, 1), 0)[s.doc]
    # letters in a row
    code = _CODE[a]
    both = (code[:-1] < 26) & (code[1:] < 26)
    known = np.zeros((27, 27))
    known[:26, :26] = bigrams[:26, :26]
    logp = np.concatenate((known.ravel()[27 * code[:-1] + code[1:]], [0]))
    pair_flag = np.concatenate((both, [False]))
    total = np.concatenate(([0.0], np.cumsum(logp, dtype=np.float64)))
    last = hi - 1
    for _ in range(3):
        last = np.where((last > lo) & space[last], last - 1, last)
    first = lo
    for _ in range(4):
        first = np.where((first < hi - 1) & space[first], first + 1, first)
    raw = a.tobytes()
    bullet = np.fromiter((raw.startswith(_BULLETS, p) and raw[p + 1 : p + 5].strip(b"\x80\x93\x94\xa2\xaa\xa6\xb7\x8f\xa0")[:1] in (b" ", b"\t") or _NUMBERED.match(raw, p) is not None for p in first.tolist()), np.float64, n)
    runs = np.concatenate(([False], (a[1:] == 46) & (a[:-1] == 46)))
    wide = np.concatenate(([False], (a[1:] == 32) & (a[:-1] == 32)))
    s_runs, s_wide, s_pairs = parts(sums(runs, wide, pair_flag), lo, hi)
    fluent = (total[hi] - total[lo]) / np.maximum(s_pairs, 1)
    ends = np.isin(a[last], list(b'.!?:;"')).astype(np.float64)
    title = np.bincount(seg, (_UPPER[a[ws]] > 0).astype(np.float64), n) / some
    cols = (
        size, words, np.bincount(seg, wl, n) / some, share(stop), s_letters / size, s_digits / size, s_odd / size, s_cells / size, s_beyond / size,
        s_upper / size, s_vowels / np.maximum(s_letters, 1), share(number), share((digits > 0) & (letters > 0) & (wl > 3)), share((wl <= 2) & (letters > 0) & ~stop),
        share((letters >= 3) & (vowels == 0)), s_runs / size, bullet, ends, s_commas / some, s_tabs / some, s_wide / size, repeats, title, fluent,
        s_bars / some, s_money / some, s.whole.astype(np.float64),
    )
    return np.stack(cols, 1).astype(np.float32).astype(np.float64)  # as they are stored


CONTEXT = ("bytes", "words", "stop", "digits", "numbers", "ends", "bullet", "novowel", "fluent")


def in_context(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The statistics, with means over the text, and over the three segments on each side."""
    if not len(x):
        return np.zeros((0, len(FEATURES) + 18))
    pick = [FEATURES.index("bigrams" if c == "fluent" else c) for c in CONTEXT]
    v = x[:, pick]
    docs = int(doc.max()) + 1
    n = np.maximum(np.bincount(doc, minlength=docs), 1)
    whole = np.stack([np.bincount(doc, c, docs) / n for c in v.T], 1)[doc]
    total, seen = np.zeros_like(v), np.zeros(len(v))
    for d in (-3, -2, -1, 1, 2, 3):
        j = np.arange(len(v)) + d
        ok = (j >= 0) & (j < len(v))
        ok[ok] &= doc[j[ok]] == doc[ok]
        total[ok] += v[j[ok]]
        seen += ok
    near = np.where(seen[:, None] > 0, total / np.maximum(seen, 1)[:, None], v)
    return np.concatenate((x, whole, near), 1)


def weak_labels(x: np.ndarray) -> np.ndarray:
    """Class of each segment by hand-written labelling rules over its statistics in context; -1 where none speaks."""
    f = {k: x[:, i] for i, k in enumerate(FEATURES)}
    whole = {k: x[:, len(FEATURES) + i] for i, k in enumerate(CONTEXT)}
    near = {k: x[:, len(FEATURES) + len(CONTEXT) + i] for i, k in enumerate(CONTEXT)}
    y = np.full(len(x), -1)
    prose = (f["stop"] >= 0.2) & (f["words"] >= 8) & (f["letters"] > 0.65) & (f["repeats"] < 0.5) & (f["short"] < 0.25) & (f["word_len"] >= 3.6)
    y[prose] = 0
    beyond = f["beyond"] - 3 * f["bullet"] / np.maximum(f["bytes"], 1)
    plain = (f["novowel"] < 0.3) & (f["symbols"] < 0.1) & (beyond < 0.12) & (f["mixed"] < 0.4) & (f["repeats"] < 0.6)
    item = plain & (f["whole"] > 0) & (f["bytes"] < 120) & (f["numbers"] < 0.34) & (f["stop"] < 0.3) & (f["leaders"] == 0)
    y[item & (f["bullet"] > 0) & (near["digits"] < 0.15)] = 1
    y[item & (near["bytes"] < 70) & (near["digits"] < 0.04) & (whole["words"] >= 1.9) & (near["ends"] < 0.4) & (f["digits"] < 0.1) & (whole["bytes"] < 80)] = 1
    cells = plain & (f["repeats"] < 0.6) & (f["whole"] > 0)
    y[cells & (f["digits"] >= 0.25) & (f["bytes"] < 200) & (f["stop"] < 0.2) & ((near["digits"] > 0.12) | (whole["digits"] > 0.12))] = 2
    y[cells & (f["leaders"] > 0.05)] = 2
    y[cells & (f["bytes"] < 60) & (near["digits"] > 0.25) & (f["stop"] < 0.35)] = 2
    y[cells & (f["tabs"] > 0.15) & (f["numbers"] > 0.2)] = 2
    noise = (f["novowel"] > 0.4) & (f["words"] >= 3) & (f["numbers"] < 0.3)
    noise |= (f["symbols"] > 0.25) & (f["bytes"] >= 10) & (f["bullet"] == 0)
    noise |= (beyond > 0.25) & (f["letters"] > 0.2) & (f["words"] >= 2) & (f["stop"] < 0.1)
    noise |= (f["short"] > 0.4) & (f["words"] >= 8) & (f["numbers"] < 0.3)
    noise |= (f["word_len"] < 3.4) & (f["words"] >= 8) & (f["letters"] > 0.5) & (f["numbers"] < 0.3)
    noise |= (f["word_len"] > 30) & (f["digits"] > 0.2)
    noise |= (f["repeats"] > 0.6) & (f["words"] >= 3) & (f["stop"] < 0.25) & (f["digits"] < 0.5)
    noise |= (f["bigrams"] < -4.2) & (f["words"] >= 3) & (f["letters"] > 0.5)
    noise |= (f["separators"] > 0.25) & (f["words"] >= 5) & (f["numbers"] < 0.5) & (f["title"] > 0.35) & (f["stop"] < 0.1)
    noise |= (whole["words"] < 1.7) & (near["words"] < 1.9) & (f["words"] <= 2) & (f["title"] > 0.4) & (whole["digits"] < 0.25) & (f["bullet"] == 0) & (whole["bullet"] == 0)
    y[noise & ~prose] = 3
    return y


def bigram_counts(texts: list[str]) -> np.ndarray:
    """How often a letter follows a letter in those of the texts that are prose; the other signs are the 27th letter."""
    stops, kept = markup.STOP_WORDS, []
    for t in texts:
        w = t.lower().split()
        if w and len(t) > 4.6 * len(w) and sum(map(stops.__contains__, w)) > 0.25 * len(w):
            kept.append(t.encode("utf-8", "replace"))
    c = _CODE[np.frombuffer(b"\n".join(kept), np.uint8)]
    pairs = 27 * c[:-1] + c[1:]
    between = np.cumsum([len(t) + 1 for t in kept[:-1]], dtype=np.int64) - 1
    return np.bincount(pairs, minlength=27 * 27) - np.bincount(pairs[np.concatenate((between - 1, between))], minlength=27 * 27)


def bigram_table(texts: DataFrame, text: str = "text") -> np.ndarray:
    """Log probability of a letter after a letter, from all texts that are prose."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27 * 27, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                total += bigram_counts(batch.column(0).slice(lo, 1000).to_pylist())
        yield pa.record_batch([pa.array(np.arange(27 * 27)), pa.array(total)], names=["pair", "n"])

    told = texts.filter(F.col(text).isNotNull()).select(text).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(27 * 27)
    counts[[r.pair for r in told]] = [r.n for r in told]
    counts = (counts if counts.any() else bigram_counts(["the text of a filing of the company"])).reshape(27, 27) + 0.5
    return np.log(counts / counts.sum(1, keepdims=True))


_MENU = "Home Menu Login Logout Search Share Print Help Contact Careers Press Legal Terms Sitemap Archive Video Audio Next Top Feed Filter Sort Export Profile Alerts Imprint".split()
_NOUNS = "plant harbour kiln furnace lease pump bond cable tower bridge fleet mine depot port farm dairy mill ferry crane yard".split()


def shapes_of_structure(rng: np.random.Generator) -> list[tuple[str, str]]:
    """Made-up texts of kinds that a table may hold too few of, with their class."""
    pick = lambda words, n: [str(w) for w in rng.choice(words, n)]
    number = lambda: rng.choice([f"{rng.integers(1, 99)},{rng.integers(100, 999)}", f"({rng.integers(1, 99)},{rng.integers(100, 999)})", str(rng.integers(1000, 99999)), "—"])
    letters = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    out: list[tuple[str, str]] = []
    for _ in range(6):
        menu = [w if rng.random() < 0.7 else f"{w} {rng.integers(1, 400)}" for w in pick(_MENU, 30)]
        out += [(sep.join(menu), "junk") for sep in (" | ", " » ", " · ", "  ", "\n")]
        rows = [[" ".join(pick(_NOUNS, 2)).capitalize(), *(number() for _ in range(3))] for _ in range(9)]
        out += [("\n".join(sep.join(r) for r in rows), "table") for sep in ("\t", "    ", "  ", "\n")]
        out += [("\n".join(f"{r[0]},{rng.integers(10, 99999)},{rng.integers(10, 99999)}" for r in rows), "table"), ("\n".join(f"{r[0]} {'.' * int(rng.integers(6, 30))} {r[1]}" for r in rows), "table")]
        items = [" ".join(pick(_NOUNS, int(rng.integers(1, 5)))) for _ in range(10)]
        out += [("\n".join(f"{mark} {x}" for x in items), "list") for mark in ("•", "-", "–", "*")]
        out += [("\n".join(f"{k + 1}. {x}" for k, x in enumerate(items)), "list"), ("\n".join(f"({chr(97 + k)}) {x}" for k, x in enumerate(items)), "list")]
        out += [(" ".join(letters("bcdfghjklmnpqrstvwxz", int(rng.integers(3, 10))) for _ in range(40)), "junk"), (letters("0123456789abcdef", 300), "junk"), (letters("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", 300), "junk")]
        out += [(" ".join(letters("#<>@^_|~*+=/!?%&\\", int(rng.integers(1, 7))) for _ in range(60)), "junk"), (letters("0123456789xyz._-=", 300), "junk"), (" ".join(pick(_NOUNS, 2) + [letters("0123456789abcdef", 10)]) * 12, "junk")]
        apart = "".join(c + (" " if rng.random() < 0.55 else "") for c in "the lease of the " + " of the ".join(pick(_NOUNS, 12)))
        wrong = " ".join(pick(_NOUNS, 25)).encode().translate(bytes.maketrans(b"aeln", b"\xe9\xf6\xe7\xf1")).decode("latin-1").encode().decode("latin-1")
        out += [(apart, "junk"), (wrong, "junk")]
    return out


class Model:
    """Everything fitted: letter statistics and the trees for texts and titles."""

    def __init__(self, bigrams: np.ndarray):
        self.bigrams = bigrams
        self.trees, self.title_trees = Boosted(len(CLASSES), rounds=15, balanced=True), Boosted(3, rounds=20, depth=3)

    def own_rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Statistics and classes of made-up texts and a sentence, which any table is topped up with."""
        made = [*shapes_of_structure(np.random.default_rng(5)), ("The text of a filing of the company is held by the office in the town.", "prose")]
        s = Segments([t for t, _ in made])
        return in_context(statistics(s, self.bigrams), s.doc), np.array([CLASSES.index(c) for _, c in made])[s.doc]

    def own_titles(self) -> tuple[np.ndarray, np.ndarray]:
        return self.title_statistics([t for t, _ in TITLES]), np.array([c for _, c in TITLES])

    def calibrate(self) -> Model:
        held = Segments([t for t, _ in SEGMENTS])
        self.trees.calibrate(in_context(statistics(held, self.bigrams), held.doc), np.array([CLASSES.index(c) for _, c in SEGMENTS])[held.doc])
        self.title_trees.calibrate(self.title_statistics([t for t, _ in HELD_TITLES]), np.array([c for _, c in HELD_TITLES]))
        return self

    def kinds(self, texts: list[str]) -> list[tuple[str, float]]:
        """Kind of each text and the share of its characters that is expected to be of that kind, by the probabilities of its segments."""
        s = Segments([_unmarked(t) for t in texts])
        return self.judge(statistics(s, self.bigrams), s.doc, _solid(s), len(texts))

    def judge(self, x: np.ndarray, doc: np.ndarray, size: np.ndarray, n: int) -> list[tuple[str, float]]:
        """The same from the statistics, texts and sizes of the segments of n texts."""
        if not len(x):
            return [("", 0.0)] * n
        p = self.trees.probabilities(in_context(x, doc))
        mass = np.stack([np.bincount(doc, size * p[:, c], n) for c in range(len(CLASSES))], 1)
        total = mass.sum(1)
        top = mass.argmax(1)
        share = mass.max(1) / np.maximum(total, 1)
        return [(CLASSES[c], float(v)) if t else ("", 0.0) for c, v, t in zip(top, share, total)]

    def title_statistics(self, titles: list[str]) -> np.ndarray:
        rows = []
        for t in titles:
            words = t.split()
            n, size = max(1, len(words)), max(1, len(t))
            letters = [c for c in t if c.isalpha()]
            low = t.lower()
            codes = _CODE[np.frombuffer(low.encode("utf-8", "replace"), np.uint8)]
            inside = (codes[:-1] < 26) & (codes[1:] < 26) if len(codes) > 1 else np.zeros(0, bool)
            fluent = float(self.bigrams[codes[:-1][inside], codes[1:][inside]].mean()) if inside.any() else -6.0
            least = min((float(self.bigrams[a, b]) for a, b in zip(codes[:-1][inside], codes[1:][inside])), default=-9.0)
            rows.append((
                size, len(words), len(letters) / size, sum(c.isdigit() for c in t) / size, sum(w.lower().strip(".,") in markup.STOP_WORDS for w in words) / n, fluent, least,
                float(t.rstrip()[-1:] in ".!?"), float(t.rstrip()[-1:].isdigit()), float(".." in t or "…" in t or "__" in t), float("\t" in t), sum(c.isupper() for c in t) / size,
                sum(w[:1].isupper() for w in words) / n, sum(not c.isalnum() and not c.isspace() and c not in ".,'’()-&:/[]" for c in t) / size, sum(ord(c) > 126 for c in t) / size,
                sum(c in "aeiouyAEIOUY" for c in t) / max(1, len(letters)), float(bool(_PROPER_START.match(t))), max((len(w) for w in words), default=0), float("$" in t or "%" in t),
            ))
        return np.array(rows, np.float64).reshape(-1, 19)

    def title_probabilities(self, titles: list[str]) -> np.ndarray:
        """Of proper, junk and prose for each title; titles that are fine by definition are proper for sure."""
        if not titles:
            return np.zeros((0, 3))
        p = self.title_trees.probabilities(self.title_statistics(titles))
        p[[_FINE_TITLE.match(t) is not None for t in titles]] = (1.0, 0.0, 0.0)
        return p

    def title_kinds(self, titles: list[str]) -> list[str]:
        return [("", "junk", "prose")[k] if row[k] > MAJORITY else "" for row in self.title_probabilities(titles) for k in (int(row.argmax()),)]


_PROPER_START = re.compile(r"(?i)\s*(?:item|note|part|section|schedule|exhibit|appendix)\s+(?:\d|[ivx]+\b|[a-z]\b)")
#: Titles that are no defects whatever they look like.
_FINE_TITLE = re.compile(r"(?i)\s*(?:UNKNOWN|\[?reserved\]?\.?|(?:item|note|part)\s+(?:\d{1,2}[A-C]?|[IVX]+|unknown)[.:]?(?:\s+\[?reserved\]?)?)\s*(?:\(continued\))?\s*$")
_LEADERS = re.compile(r"\.{3,}|…|_{3,}|\t\s*\d+\s*$|\s{2,}\d+\s*$")
_MISREAD = re.compile("[ÃÂâÐÅ][\x80-\xff‚-™€]|�")


def _title_label(t: str) -> int:
    """0 proper, 1 junk, 2 prose by hand-written rules, -1 where none speaks."""
    words = t.split()
    letters = sum(c.isalpha() for c in t)
    if _LEADERS.search(t) or _MISREAD.search(t) or letters < 0.4 * len(t.strip()) or re.search(r"(?i)table of contents\s+\d+\s*$|\|\s*[0-9a-f]{4,}", t):
        return 1
    stop = sum(w.lower() in markup.STOP_WORDS for w in words)
    if len(words) >= 8 and t.rstrip().endswith((".", "!", "?")) and stop >= 2:
        return 2
    if len(words) == 1 and t.islower() and letters >= 5 and not re.search(r"[aeiou]", t):
        return 1
    if 1 < len(words) <= 12 and not t.rstrip().endswith(".") and all(w[:1].isupper() or w.lower() in markup.STOP_WORDS or w[0] in "(&" or w[:1].isdigit() for w in words):
        return 0
    return -1


def _unmarked(t: str) -> str:
    return markup.unmarked(t) if _SUSPECT.search(t) else t


_SUSPECT = re.compile(markup.SUSPECT)


def _solid(s: Segments) -> np.ndarray:
    """Bytes of each segment that aren't space."""
    solid = _running((_SPACE[s.a] == 0).astype(np.int64))
    return (solid[s.ends] - solid[s.starts]).astype(np.float64)


def measured(df: DataFrame, bigrams: np.ndarray, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Blocks of up to a thousand texts: their keys and lengths, and the text, size and statistics of each segment, packed."""
    shared = df.sparkSession.sparkContext.broadcast(bigrams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                keys, texts = batch.column(0).slice(lo, 1000), [t or "" for t in batch.column(1).slice(lo, 1000).to_pylist()]
                parts = []
                for at in range(0, len(texts), 250):  # few enough for the caches
                    s = Segments([_unmarked(t) for t in texts[at : at + 250]])
                    parts.append(((s.doc + at).astype(np.int32), _solid(s).astype(np.int32), statistics(s, shared.value).T.astype(np.float32)))
                packed = [np.concatenate(v, axis=-1) for v in zip(*parts)]
                cols = [[keys.to_pylist()], [[len(t) for t in texts]], [len(packed[0])], *([codec.compress(v.tobytes(), asbytes=True)] for v in packed)]
                types = (pa.list_(keys.type), pa.list_(pa.int32()), pa.int32(), *[pa.binary()] * 3)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["keys", "lengths", "segments", "doc", "size", "x"])

    return df.select(key, text).mapInArrow(run, f"keys array<{markup.df_type(df, key)}>, lengths array<int>, segments int, doc binary, size binary, x binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Statistics, texts and sizes of the segments of each block."""
    codec = pa.Codec("zstd")
    for n, *packed in zip(*(batch.column(c).to_pylist() for c in ("segments", "doc", "size", "x"))):
        doc, size, x = (np.frombuffer(codec.decompress(v, 4 * n * k, asbytes=True), t) for v, k, t in zip(packed, (1, 1, len(FEATURES)), (np.int32, np.int32, np.float32)))
        yield x.reshape(len(FEATURES), n).T.astype(np.float64), doc.astype(np.int64), size.astype(np.float64)


def fit(texts: DataFrame, titles: DataFrame, key: str = "chunk_id", text: str = "text", title: str = "section_title") -> Model:
    """The model from all texts and all distinct titles."""
    bigrams = bigram_table(texts, text)
    return _fit(cut_lineage(measured(texts, bigrams, key, text)), titles.select(F.col(title).alias("v")), bigrams)


def _fit(store: DataFrame, titles: DataFrame, bigrams: np.ndarray) -> Model:
    model = Model(bigrams)
    shared = store.sparkSession.sparkContext.broadcast(Model(bigrams))

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for x, doc, _ in _unpacked(batch):
                x = in_context(x, doc)
                y = weak_labels(x)
                yield x[y >= 0], y[y >= 0]

    def of_titles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            y = np.array([_title_label(t) for t in batch.column(0).to_pylist()], np.int64)
            yield shared.value.title_statistics(batch.column(0).to_pylist())[y >= 0], y[y >= 0]

    parts = [(store, of_texts), (titles.filter("v IS NOT NULL").distinct(), of_titles)]
    fit_all(parts, [model.trees, model.title_trees], [model.own_rows(), model.own_titles()])
    return model.calibrate()


def found(df: DataFrame, key: str = "chunk_id", text: str = "text", title: str = "section_title") -> DataFrame:
    """The kinds of a table by the model fitted on it; its texts are measured once."""
    bigrams = bigram_table(df, text)
    store = cut_lineage(measured(df, bigrams, key, text))
    return kinds(df, _fit(store, df.select(F.col(title).alias("v")), bigrams), key, text, title, store=store)


def kinds(df: DataFrame, model: Model, key: str = "chunk_id", text: str = "text", title: str = "section_title", least: int = 40, store: DataFrame | None = None) -> DataFrame:
    """(key, field_name, kind, share or probability): texts of which more than half is list, table or junk, and titles that are junk or prose.

    Nulls, texts under `least` characters and blank titles give no rows; equal rows give one; other columns are ignored;
    an empty table gives none. Markup left in a text is taken off before it is judged. `store`: the texts as measured.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = markup.df_type(df, key)

    def told(rows: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (of, pa.string(), pa.string(), pa.float64()))], names=[key, "field_name", "kind", "share"])

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.schema.field("keys").type.value_type
            for keys, lengths, segments in zip(batch.column("keys").to_pylist(), batch.column("lengths").to_pylist(), _unpacked(batch)):
                told_of = zip(keys, lengths, shared.value.judge(*segments, len(keys)))
                yield told([(k, "text", kind, share) for k, n, (kind, share) in told_of if n >= least and share > MAJORITY and kind in ("list", "table", "junk")], of)

    def of_titles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, titles = (batch.column(c).to_pylist() for c in range(2))
            distinct = sorted({t for t in titles if t and t.strip()})
            of = {t: (("junk", "prose")[row[1:].argmax()], float(row[1:].max())) for t, row in zip(distinct, shared.value.title_probabilities(distinct)) if row[1:].max() > MAJORITY}
            yield told([(k, "section_title", *of[t]) for k, t in zip(keys, titles) if t in of], batch.schema.types[0])

    schema = f"`{key}` {kind}, field_name string, kind string, share double"
    texts = (measured(df, model.bigrams, key, text) if store is None else store).mapInArrow(of_texts, schema)
    return texts.unionByName(df.select(key, title).mapInArrow(of_titles, schema)).distinct()


def document_statistics(df: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Per-document statistics, in the JVM: n_chars, n_words, mean_word_length, symbol_ratio, digit_ratio,
    punctuated_lines (share of non-blank lines ending in punctuation), common_words (share of function words).

    Null and blank texts have zero counts and null ratios; repeated rows are kept; other columns are ignored.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(F.regexp_replace(t, r"^\s+|\s+$", ""), r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    stops = F.array(*[F.lit(w) for w in sorted(markup.STOP_WORDS)])
    d = df.select(F.col(key).alias(key), t.alias("t"), words.alias("w"), lines.alias("l"))
    n = F.nullif(F.size("w"), F.lit(0))
    chars = F.nullif(F.length("t"), F.lit(0))
    return d.select(
        key, F.length("t").alias("n_chars"), F.size("w").alias("n_words"),
        (F.aggregate("w", F.lit(0), lambda acc, x: acc + F.length(x)) / n).alias("mean_word_length"),
        (F.length(F.regexp_replace("t", r"[\p{L}\p{N}\s]", "")) / chars).alias("symbol_ratio"),
        (F.length(F.regexp_replace("t", r"[^0-9]", "")) / chars).alias("digit_ratio"),
        (F.size(F.filter("l", lambda x: F.rtrim(x).rlike(r"[.!?:;\"]$"))) / F.nullif(F.size("l"), F.lit(0))).alias("punctuated_lines"),
        (F.size(F.filter("w", lambda x: F.array_contains(stops, F.lower(x)))) / n).alias("common_words"),
    )
