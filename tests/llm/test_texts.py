import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataline.llm import leakage as L
from strataline.llm import lookalikes as A
from strataline.llm import markup as M
from strataline.llm import splitting as S

# ---- markup ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("<p>The cost of sales rose &amp; fell in the year.</p>", ["html"]), ("Fish &amp; chips were sold in the shops of the town.", ["html"]), ("The plan is <b>bold</b>.", ["html"]),
        ("# Heading\n\nThe text of it.", ["markdown"]), ("See [the note](http://x) for the detail.", ["markdown"]), ("The **bold** word.", ["markdown"]), ("Title here\n==========\n\nText.", ["markdown"]),
        ("| a | b |\n|---|---:|\n| c | 1 |", ["markdown"]), ("```python\nx = 1\n```", ["markdown"]), ("== Heading ==\n\nThe text.", ["wiki"]), ("In [[Hull]] and the '''port'''.", ["wiki"]),
        ("{| class=\"wikitable\"\n! a !! b\n|-\n| c || 1\n|}", ["wiki"]), ("{{convert|5|km}} from the sea.", ["wiki"]), (r"\section{Risk} The text.", ["latex"]), (r"It cost \$5 and 12\% more.", ["latex"]),
        (r"The ratio is $\frac{1}{2}$ of it.", ["latex"]), ("\\begin{tabular}{l}\na & b \\\\\n\\end{tabular}", ["latex"]),
        ("Files are kept under C:\\barge\\forms on request.", []), ("Losses were < 2% and gains > 5% of sales.", []), ("R&D and M&A costs were $9 million.", []), ("The tag us-gaap_Net_income was not used.", []),
        ("* Less than one percent of the shares.", []), ("1. First\n2. Second\n- third", []), ("As noted [1] and [2] by the board.", []), ("Class A | Class B shares", []), ("#@!% ^&*<> [[?~ =+_# {{ \\zoning @@!! %%^^", []), ("It costs $5 and $7.", []), ("", []),
    ],
)
def test_kinds_of_markup(text, kinds):
    assert M.residues(text) == kinds


def test_structure_is_kept():
    html = "<h2>Risk &amp; more</h2><p>The <b>cost</b> rose.</p><ul><li>one</li><li>two</li></ul><pre><code>SELECT a\n  FROM b</code></pre><table><tr><td>x</td><td>1</td></tr></table>"
    assert [(b["kind"], b["text"]) for b in M.blocks_of(html)] == [("heading", "Risk & more"), ("text", "The cost rose."), ("item", "one"), ("item", "two"), ("code", "SELECT a\n  FROM b"), ("row", "x\t1")]
    md = "## Plan\n\nThe **plan** by [us](http://x).\n\n* a\n* b\n\n```\nx = 1\n```\n\n| k | v |\n|---|---|\n| a | 2 |"
    assert [b["kind"] for b in M.blocks_of(md)] == ["heading", "text", "item", "item", "code", "row", "row"]
    tex = "\\section{Plan}\nThe \\emph{plan} cost \\$5.\n\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}\n\\begin{equation}\nE = mc^2\n\\end{equation}"
    assert [(b["kind"], b["text"]) for b in M.blocks_of(tex)] == [("heading", "Plan"), ("text", "The plan cost $5."), ("item", "a"), ("item", "b"), ("formula", "E = mc^2")]
    wiki = "== Plan ==\n\nIn [[Hull|the port]] by '''us'''.\n\n{|\n! a !! b\n|-\n| c || 1\n|}"
    assert [(b["kind"], b["text"]) for b in M.blocks_of(wiki)] == [("heading", "Plan"), ("text", "In the port by us."), ("row", "a\tb"), ("row", "c\t1")]


def test_clean_text_has_no_residue():
    for t in ("<p>The cost of <i>sales</i> rose.</p>", "The **bold** [link](x) in the text.", "In [[Hull]] by '''us''' in the year.", r"The \emph{plan} of the year."):
        assert M.residues(t) and not M.residues(M.clean(t))


def test_markup_edge_cases(spark):
    rows = [("a", "<p>The text</p>", 1), ("a", "<p>The text</p>", 1), ("b", None, 2), ("c", "", 3), ("d", "plain", 4), ("e", "<b>x</b> the " + "word " * 50_000, 5)]
    d = spark.createDataFrame(rows, "chunk_id string, text string, markup int")
    assert sorted((r.chunk_id, r.markup) for r in M.found(d).collect()) == [("a", "html"), ("e", "html")]
    c = {r.chunk_id: r for r in M.cleaned(d).collect()}
    assert c["a"].clean_text == "The text" and c["b"].clean_text is None and c["b"].blocks == [] and c["c"].clean_text == "" and c["d"].clean_text == "plain" and c["e"].clean_text.startswith("x the word")
    assert M.cleaned(d).count() == 6 and M.found(d.limit(0)).count() == 0


# ---- look-alikes -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("ｓａｌｅｓ", ["form"]), ("oﬃce", ["form"]), ("Part Ⅳ", ["form"]), ("cafe\u0301", ["mark"]), ("a\u00a0b", ["space"]), ("a\u2003b", ["space"]), ("cross\u2011border", ["hyphen"]), ("sa\u200bles", ["invisible"]), ("sa\u00adles", ["invisible"]), ("\ufeffsales", ["invisible"]),
        ("sаles", ["letter"]), ("Οctober", ["letter"]), ("café São Łódź", []), ("“Plan” – as… ™ ® € ½ m²", []), ("Завод β σ²", []), ("Ã\u00adÃ¶ â€“ Â\u00a0 Ð´", []), ("plain", []), ("", []),
    ],
)
def test_kinds_of_look_alikes(text, kinds):
    assert A.findings(text) == kinds


def test_one_form():
    groups = [["sales", "ｓａｌｅｓ", "sа\u200bles", "sa\u00adles"], ["café", "cafe\u0301"], ["cross-border b", "cross\u2011border\u00a0b"], ["Part IV", "Part Ⅳ"]]
    for g in groups:
        assert len({A.skeleton(t) for t in g}) == 1 and {A.canonical(t) for t in g} == {g[0]}
    assert A.skeleton("Завод") != A.skeleton("3aBoд") and A.canonical("m² ½ ™") == "m² ½ ™"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_the_skeleton_is_stable(text):
    once = A.canonical(text)
    assert A.canonical(once) == once or A.skeleton(once) == A.skeleton(A.canonical(once))


def test_look_alike_edge_cases(spark):
    rows = [("1", "text", "sаles"), ("1", "text", "sаles"), ("2", "quote", None), ("3", "quote", ""), ("4", "text", "plain"), ("5", "text", "x" * 100_000 + "\u00a0y")]
    v = spark.createDataFrame(rows, "record_id string, field_name string, value string").withColumns({"form": F.lit(1), "skeleton": F.lit(2)})
    assert sorted(r.record_id for r in A.found(v).collect()) == ["1", "5"]
    f = A.forms(v)
    assert f.count() == 5 and f.filter("record_id = '1'").first().form == "sales" and A.groups(f).filter("size = 2").count() == 1
    assert A.forms(v.limit(0)).count() == 0 and A.found(v.limit(0)).count() == 0
    c = spark.createDataFrame([("c1", "k", "the ｓａｌｅｓ rose", ""), ("c2", "none", "x", None)], "citation_id string, chunk_id string, quote string, support_quote string")
    k = spark.createDataFrame([("k", "In May\nthe sales  rose a lot.")], "chunk_id string, text string")
    assert {(r.citation_id, r.field_name, r.in_chunk) for r in A.quotes_in_chunks(c, k).collect()} == {("c1", "quote", True), ("c1", "support_quote", False), ("c2", "quote", False), ("c2", "support_quote", False)}


def test_letters_of_any_script_within_latin_words_are_found(spark):
    texts = ["bl\u04c0nd", "\u13aacre", "b\u2c9fnd", "f\u2c91rm", "m\u10d0il", "plain", "\u041c\u043e\u0441\u043a\u0432\u0430"]
    v = spark.createDataFrame([(str(k), "text", t) for k, t in enumerate(texts)], "record_id string, field_name string, value string")
    assert {r.record_id for r in A.found(v).collect()} == {"0", "1", "2", "3", "4"}
    assert [A.skeleton(t) for t in texts[:3]] == ["blInd", "Acre", "bond"]


# ---- splitting -------------------------------------------------------------------------------------------------------


def rebuilt(text, found):
    out, at = "", 0
    for start, own, end in found:
        assert start <= own <= end and own >= at - 0
        out += text[at:own] if own > at else ""
        assert text[at:own].strip() == ""
        out += text[own:end]
        at = end
    return out + text[at:]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc .!?\n", max_size=600), st.integers(20, 80), st.integers(0, 15))
def test_pieces_fit_and_make_up_the_text(text, limit, overlap):
    found, level = S.pieces(text, limit, overlap)
    if len(text) <= limit:
        return
    assert all(end - start <= limit and own - start <= overlap for start, own, end in found)
    assert rebuilt(text, found).strip() == text.strip()
    assert level in S.LEVELS


def test_cut_levels():
    p = "word " * 20
    assert S.pieces(f"{p}\n\n{p}", 120, 10)[1] == "paragraph" and S.pieces(f"{p}. {p}", 120, 10)[1] == "sentence" and S.pieces(p * 3, 120, 10)[1] == "word" and S.pieces("x" * 300, 120, 10)[1] == "none"
    a, b = S.pieces(f"{p.strip()}\n\n{p.strip()}", 120, 10)[0]
    assert a[2] - a[1] == len(p.strip()) and b[1] > b[0]


def test_splitting_edge_cases(spark):
    text = "One sentence here. " * 200
    rows = [("a", text, 100), ("a", text, 100), ("b", None, 0), ("c", "", 0), ("d", "short", 0), ("e", "y" * 5000, None), ("f", "ü " * 50_000, 7)]
    d = spark.createDataFrame(rows, "chunk_id string, text string, char_start int").withColumn("piece", F.lit("clash"))
    r = S.split(d).collect()
    assert {x.chunk_id for x in r} == {"a", "e", "f"} and all(len(x.piece_text) <= 1800 for x in r) and all(x.char_start is None for x in r if x.chunk_id == "e")
    assert all(text[x.char_start - 100 : x.char_end - 100] == x.piece_text for x in r if x.chunk_id == "a")
    assert S.split(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.split(d, limit=10, overlap=10)


def test_right_offsets(spark):
    f = spark.createDataFrame([("x", "0123456789abc"), ("x", "0123456789abc")], "accession string, text string")
    c = spark.createDataFrame([("k1", "x", "345", 3, 6), ("k2", "x", "345", 0, 0), ("k3", "x", "zzz", 1, 4), ("k4", "y", "345", 5, 8)], "chunk_id string, accession string, text string, char_start int, char_end int")
    assert {r.chunk_id: r.char_start for r in S.right_offsets(c, f).collect()} == {"k1": 3, "k2": 3, "k3": None, "k4": 5}


# ---- leakage ---------------------------------------------------------------------------------------------------------


def brute(text, passages, least):
    w = L.words_of(text)
    grams = {tuple(w[k : k + least]) for k in range(len(w) - least + 1)}
    return {i for i, p in enumerate(passages) if any(tuple(p[k : k + least]) in grams for k in range(len(p) - least + 1))}


def test_automaton_against_brute_force():
    r = random.Random(2)
    for _ in range(60):
        passages = [[r.choice("abcd") for _ in range(r.randint(1, 25))] for _ in range(r.randint(1, 6))]
        auto = L.SuffixAutomaton(passages, 4)
        for _ in range(10):
            text = " ".join(r.choice("abcdx") for _ in range(40))
            hit, runs = auto.scan(text.split(), 4)
            assert hit == brute(text, passages, 4)
            assert bool(runs) == bool(hit) and all(hi - lo >= 4 for lo, hi in runs)


def test_leaks_edge_cases(spark):
    passage = " ".join(f"word{k}" for k in range(30))
    part = " ".join(f"WORD{k}," for k in range(5, 18))
    docs = [(1, f"Before. {part} After."), (1, f"Before. {part} After."), (2, None), (3, ""), (4, " ".join(f"word{k}" for k in range(11))), (5, "z " * 50_000 + passage), (6, "clean")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"case_ids": F.lit(1), "runs": F.lit(1)})
    t = spark.createDataFrame([("c1", passage), ("c2", passage), ("c3", None), ("c4", "too short")], "case_id string, passage string")
    r = L.scan(d, t).collect()
    assert sorted((x.doc_id, tuple(x.case_ids), x.longest) for x in r) == [(1, ("c1", "c2"), 13), (1, ("c1", "c2"), 13), (5, ("c1", "c2"), 30)]
    one = next(x for x in r if x.doc_id == 1)
    assert one.cleaned.split() == ["Before.", ",", "After."]  # covers more than the limit
    assert next(x for x in r if x.doc_id == 5).cleaned.endswith(passage)  # short and a small part of its document
    assert L.scan(d.limit(0), t).count() == 0 and L.scan(d, t.limit(0)).count() == 0


def test_blocks_of_tests(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_WORDS", 30)
    passages = {f"c{k}": " ".join(f"p{k}w{j}" for j in range(20)) for k in range(8)}
    d = spark.createDataFrame([(1, passages["c1"] + " and " + passages["c6"]), (2, passages["c3"])], "doc_id long, text string")
    t = spark.createDataFrame(list(passages.items()), "case_id string, passage string")
    assert {(r.doc_id, tuple(r.case_ids)) for r in L.scan(d, t).collect()} == {(1, ("c1", "c6")), (2, ("c3",))}


def test_markup_spans_of_any_length():
    long = "the price of the glass rose and " * 100 + "fell"
    cases = {
        "markdown": [f"We said **{long}** here.", f"see [{long}](http://x.example/{'a' * 3000})", f"so `{long}` it is", f"and ~~{long}~~ too"],
        "wiki": [f"see [[{long}]] for more", "a {{note|" + long + "}} b", f"he ''{long}'' said", f"he '''{long}''' said"],
        "latex": [f"with $x^2 + {'y + ' * 900}z$ here", f"``{long}'' is said"],
        "html": [f"<p title=\"{long}\">{long}</p>"],
    }
    for kind, texts in cases.items():
        for t in texts:
            assert kind in M.residues(t), t[:60]
            if kind != "latex":
                assert M.residues(M.clean(t)) == []


def test_formula_blocks_code_and_noise():
    t = "The value of the lease is the sum of all the payments.\n\n\\begin{equation}\nV = \\sum_{i=1}^{17} c_i (1+r)^{-i}\n\\end{equation}\n\n#*<% ^|~ \\*>_ =+@ **~#** {}<\\\n\n```python\nif a < b:\n\n    x = [1]\n```"
    assert "latex" in M.residues(t)
    b = M.blocks_of(t)
    assert [x["kind"] for x in b] == ["text", "formula", "text", "code"] and b[1]["text"] == "V = \\sum_{i=1}^{17} c_i (1+r)^{-i}" and "    x = [1]" in b[3]["text"] and b[2]["text"] == "#*<% ^|~ \\*>_ =+@ **~#** {}<\\"
    assert "".join(x for x, _, _ in M.labelled(t)) == t and M.labelled("") == []


def test_markup_time_grows_with_the_text():
    import time

    def took(n):
        t = "\n".join(f"a **b** line {k} of [x](y), <pre> and <b>z</b> ``` \\[ '' {{{{" for k in range(n))
        began = time.perf_counter()
        M.residues(t)
        M.blocks_of(t)
        return time.perf_counter() - began

    took(100)
    assert took(4000) < 24 * took(500) + 0.5
