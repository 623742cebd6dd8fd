from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.llm import mixing as X
from strataline.llm import pairs as P
from strataline.llm import pii as I
from strataline.llm import quality as Q
from strataline.llm.boosting import Boosted
from strataline.llm.holdout import HELD_TITLES, SEGMENTS, TEST_SEGMENTS, TEST_TITLES, TITLES
from strataline.llm.sampling import bounded


# ---- quality ---------------------------------------------------------------------------------------------------------


def test_boosting_learns_and_calibrates():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 2] > 1)
    m = Boosted(3).fit(x[:2000], y[:2000])
    m.calibrate(x[2000:2500], y[2000:2500])
    p = m.probabilities(x[2500:])
    assert (p.argmax(1) == y[2500:]).mean() > 0.85 and np.allclose(p.sum(1), 1)


@pytest.fixture(scope="module")
def model(spark):
    c = spark.read.parquet("/root/testdata/sf0.01/chunks.parquet")
    return Q.fit(c, c)


def test_holdout_accuracy(model):
    kinds = model.kinds([t for t, _ in SEGMENTS])
    assert np.mean([k == want for (k, _), (_, want) in zip(kinds, SEGMENTS)]) >= 0.9
    titles = model.title_kinds([t for t, _ in TITLES])
    assert np.mean([k == ("", "junk", "prose")[want] for k, (_, want) in zip(titles, TITLES)]) >= 0.9
    assert model.title_kinds(["UNKNOWN", "[Reserved]", "Item 7A.", "Note 12", "Item 7. (continued)"]) == [""] * 5


def test_accuracy_and_log_loss_on_rows_never_fitted(model):
    kinds = model.kinds([t for t, _ in TEST_SEGMENTS])
    assert np.mean([k == want for (k, _), (_, want) in zip(kinds, TEST_SEGMENTS)]) >= 0.9
    p, y = model.title_probabilities([t for t, _ in TEST_TITLES]), np.array([c for _, c in TEST_TITLES])
    assert (p.argmax(1) == y).mean() >= 0.95 and -np.log(p[np.arange(len(y)), y]).mean() < 0.2 and np.allclose(p.sum(1), 1)
    seen = {t for t, _ in TITLES}
    assert not seen & {t for t, _ in HELD_TITLES + TEST_TITLES} and not {t for t, _ in SEGMENTS} & {t for t, _ in TEST_SEGMENTS} and not {t for t, _ in HELD_TITLES} & {t for t, _ in TEST_TITLES}


def test_quality_edge_cases(spark, model):
    listing = "\n".join(f"• part {k} of the kiln" for k in range(12))
    rows = [("a", listing, "Risk Factors"), ("a", listing, "Risk Factors"), ("b", None, None), ("c", "", "  "), ("d", "tiny", "________"), ("e", "The cost of the sales rose in the year because of the weather. " * 3000, "We sold the plant in May of the year.")]
    d = spark.createDataFrame(rows, "chunk_id string, text string, section_title string").withColumns({"kind": F.lit(1), "share": F.lit(1)})
    r = {(x.chunk_id, x.field_name): x.kind for x in Q.kinds(d, model).collect()}
    assert r[("a", "text")] == "list" and r[("d", "section_title")] == "junk" and r[("e", "section_title")] == "prose" and ("e", "text") not in r and not any(k[0] in "bc" for k in r)
    assert Q.kinds(d, model).count() == len(r) and Q.kinds(d.limit(0), model).count() == 0
    s = {x.chunk_id: x for x in Q.document_statistics(d).collect()}
    assert s["b"].n_chars == 0 and s["b"].mean_word_length is None and s["d"].n_words == 1 and s["e"].punctuated_lines == 1.0 and s["e"].common_words > 0.4
    empty = Q.fit(d.limit(0), d.limit(0))
    assert empty.kinds(["Words of the text."])[0][0] in Q.CLASSES


def test_letters_and_trees_come_from_all_rows(spark):
    words = "plant kiln lease harbour quay jetty vault axle dock pump".split()
    texts = [f"Considerable improvements of the {words[n % 10]} increased the expenditure for the {words[n // 10 % 10]} of {n} in the north.\n• {words[n % 7]}\n• dock" for n in range(6000)]
    titles = [f"Sales of the {words[n % 10].title()} {n}" if n % 3 else f"Plant {n} ........ {n}" for n in range(6000)]
    d = spark.createDataFrame([(f"k{n}", t, title) for n, (t, title) in enumerate(zip(texts, titles))], "chunk_id string, text string, section_title string").repartition(5)
    m = Q.fit(d, d)
    counts = np.full((27, 27), 0.5)
    for t in texts:
        c = [min(ord(x) - 97, 26) if "a" <= x <= "z" else 26 for x in t.lower().replace("•", "???")]
        np.add.at(counts, (c[:-1], c[1:]), 1)
    assert np.allclose(m.bigrams, np.log(counts / counts.sum(1, keepdims=True)))
    s = Q.Segments(texts)
    x = Q.in_context(Q.statistics(s, m.bigrams), s.doc)
    for trees, x, y, own in ((m.trees, x, Q.weak_labels(x), m.own_rows()), (m.title_trees, m.title_statistics(titles), np.array([Q._title_label(t) for t in titles]), m.own_titles())):
        whole = Boosted(trees.classes, trees.rounds, trees.depth, balanced=trees.balanced).fit(np.concatenate((x[y >= 0], own[0])), np.concatenate((y[y >= 0], own[1])))
        assert np.allclose(trees.scores(x[::50]), whole.scores(x[::50])) and np.allclose(trees.scores(own[0]), whole.scores(own[0]))
    few = d.filter("chunk_id < 'k2'")
    assert sorted(Q.kinds(few, m).collect()) == sorted(Q.kinds(few, m, store=Q.measured(few.repartition(3), m.bigrams)).collect())


def test_sample_is_bounded(spark):
    d = spark.range(5000)
    assert bounded(d, F.col("id"), 300).count() == 300 and bounded(d, F.col("id"), 9000).count() == 5000
    assert sorted(r.id for r in bounded(d, F.col("id"), 50).collect()) == sorted(r.id for r in d.orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30)), F.xxhash64("id")).limit(50).collect())


# ---- pairs -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def languages(spark):
    a = spark.read.parquet("/root/testdata/sf0.01/answers.parquet")
    return P.fit(a.select(F.col("answer_id").alias("record_id"), "question", "text"))


Q_EN = "What was the cost of the kiln for Quillon Glass plc in fiscal 2021?"


@pytest.mark.parametrize(
    "question, text, defect",
    [
        (Q_EN, None, "empty"), (Q_EN, " \n", "empty"), (Q_EN, "N/A", "empty"), (Q_EN, "Answer:", "empty"), (Q_EN, "[1] [2]", "empty"), (Q_EN, "...", "empty"),
        (Q_EN, Q_EN, "copy"), (Q_EN, "Answer: " + Q_EN.upper(), "copy"), (Q_EN, f"{Q_EN} {Q_EN}", "copy"), (Q_EN, Q_EN.split(" ", 1)[1], "copy"),
        (Q_EN, "I'm sorry, but I can't help with that.", "refusal"), (Q_EN, "Leider kann ich diese Frage nicht beantworten.", "refusal"), (Q_EN, "Je ne peux pas répondre à cette question.", "refusal"), (Q_EN, "Lo siento, no puedo responder.", "refusal"),
        (Q_EN, "Der Umsatz wurde im Jahr 2018 deutlich erhöht, weil die Kunden nicht rechtzeitig bestellt haben.", "language"), ("Wie hoch war der Umsatz der Gesellschaft im Jahr 2020?", "The cost of sales rose because of the weather in the north.", "language"),
        (Q_EN, "The cost of sales rose because the", "truncated"), (Q_EN, "Net sales rose to $9 million, mainly [", "truncated"), (Q_EN, "We own the plant and the ware-", "truncated"), (Q_EN, "Sales rose (including", "truncated"),
        (Q_EN, "Yes.", None), (Q_EN, "Neither", None), (Q_EN, "$9.1 million", None), (Q_EN, "No; the lease was renewed", None), (Q_EN, "The company cannot estimate the loss on its plant [1].", None), (Q_EN, "Net sales rose in 2021. [1]", None), (None, "Net sales rose in 2021.", None),
    ],
)
def test_defects(languages, question, text, defect):
    assert P.defect_of(question, text, languages) == defect


def test_refusals_of_any_length_and_prompts_of_few_words(languages):
    filler = " The request has been logged and someone from the office will look at it in due course." * 60
    assert P.defect_of(Q_EN, "I can't help with that question." + filler, languages) == "refusal"
    assert P.defect_of(Q_EN, "We do not provide information on the plant because of the lease.", languages) is None
    for q, text in (("Quel était le budget de Quillon Glass plc en 2021 ?", "Le budget a nettement progressé en 2021, car les recettes ont été livrées trop tard."), ("¿Qué pérdidas menciona Quillon Glass plc?", "El consejo aumentó en 2020."), (Q_EN, "67 percent"), (Q_EN, "Kilns, pumps and valves")):
        assert P.defect_of(q, text, languages) is None
    assert P.defect_of("Quel était le budget de Quillon Glass plc en 2021 ?", "El consejo aumentó de forma notable, porque las plantas llegaron tarde.", languages) == "language"
    p = languages.languages.posterior(Q_EN)
    assert abs(p.sum() - 1) < 1e-9 and p.argmax() == 0


def test_end_of_text_likelihood_orders_endings(languages):
    s = languages.endings.score
    assert s("Sales rose because of the weather.") > s("Sales rose because of the weather") > s("Sales rose because of the")
    assert s("Sales rose (including the plant)") > s("Sales rose (including the plant") and s("Sales rose in 2021...") < P.END_FLOOR < s("Sales rose in 2021. [1]")


def test_pairs_edge_cases(spark, languages):
    rows = [("t", "1", Q_EN, None, None), ("t", "1", Q_EN, None, None), ("t", "2", Q_EN, "", True), ("t", "3", None, "Sales rose.", False), ("t", "4", Q_EN, "Sales rose. " * 20_000, None)]
    d = spark.createDataFrame(rows, "table_name string, record_id string, question string, text string, exempt boolean").withColumn("defect", F.lit("clash"))
    assert [(r.record_id, r.defect) for r in P.defects(d, languages).collect()] == [("1", "empty")]
    assert P.defects(d.limit(0), languages).count() == 0 and P.defects(d.limit(0)).count() == 0


def test_pairs_are_all_counted(spark):
    letters = "abcdefghij"
    word = lambda n: "z" + "".join(letters[int(c)] for c in f"{n:05d}")
    texts = [f"The cost of the {word(n)} was paid by the company in {n % 40 + 1990}." if n % 900 else f"Sorry, I cannot help with that {word(n)}." for n in range(9000)]
    d = spark.createDataFrame([(str(n), Q_EN if n % 3 else None, t) for n, t in enumerate(texts)], "record_id string, question string, text string")
    m = P.fit(d.repartition(5))
    assert {word(n) for n in range(9000)} <= m.endings.whole
    ends, inner = [Counter() for _ in range(3)], [Counter() for _ in range(3)]
    for t in texts + [Q_EN] * 6000:
        tokens = t.rstrip(".? ").split()
        for k in range(1, len(tokens)):
            for c, x in zip(ends if k == len(tokens) - 1 else inner, P._end_features(tokens[: k + 1])):
                c[x] += 1
    assert m.endings.odds == P.Endings(ends, inner, set()).odds
    pool = [p for t in texts + [Q_EN] * 6000 for p in P._pool(t)]
    seeded = P.Refusals(Counter(), 0, Counter(x for p in pool for x in p), len(pool))
    yes, no = [p for p in pool if seeded.resembles(p)], [p for p in pool if not seeded.resembles(p)]
    assert len(yes) == 10 and m.refusals.odds == P.Refusals(Counter(x for p in yes for x in p), len(yes), Counter(x for p in no for x in p), len(no)).odds
    counts = np.zeros((4, P.BUCKETS))
    for t in texts + [Q_EN] * 6000:
        if not P.Languages.kept(t) and (label := P.Languages.label(t)) is not None:
            np.add.at(counts[label], P._grams(P.bare(t)), 1)
    assert np.array_equal(m.languages.logp, P.Languages(counts).logp)
    again = P.fit(d.repartition(2))
    assert again.languages.scale == m.languages.scale and again.refusals.odds == m.refusals.odds and again.endings.odds == m.endings.odds


# ---- personal information --------------------------------------------------------------------------------------------


def documents(spark):
    people = ["Zelda Quarn", "Ottmar Blisk", "Ivo Prandt", "Cosima Vell", "Runa Tregg"]
    docs = [f"According to Dr. {p}, sales rose. The claimant, {p} (SSN 900-11-{2000 + k}), left. Contact: {p}, on +44 20 7946 0{100 + k}." for k, p in enumerate(people)]
    docs += [f"The claimant, {p} (SSN 911-22-{3000 + k}), left. Please call {p} on (212) 555-0{100 + k}." for k, p in enumerate(["Hedda Morv", "Lutz Ankar", "Pia Drohn"])]
    return docs


def test_found_and_redacted(spark):
    docs = documents(spark) + [
        "Write to ir@quillon.example or zelda [at] quillon [dot] example.", "He lives at Flat 3, 12 Old Mill Road, Hull and Lindenweg 4, 10115 Hull.", "Accession 0000912057-20-000123 of Tregg & Blisk LLP; Tregg Capital advised.", "The plant in Hull made 900 tons in 2021.", "", None,
    ]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumns({"lo": F.lit(1), "hi": F.lit(2), "kind": F.lit("x")})
    got = {}
    for r in I.found(d).collect():
        got.setdefault(r.doc_id, set()).add((r.pii_type, docs[r.doc_id][r.char_start : r.char_end]))
    assert got[0] >= {("name", "Zelda Quarn"), ("id", "900-11-2000"), ("phone", "+44 20 7946 0100")}
    assert ("name", "Hedda Morv") in got[5] and ("phone", "(212) 555-0100") in got[5]  # never titled: found by context
    n = len(documents(spark))
    assert {k for k, _ in got[n]} == {"email"} and len(got[n]) == 2 and {k for k, _ in got[n + 1]} == {"address"} and len(got[n + 1]) == 2
    assert n + 2 not in got and n + 3 not in got
    red = {r.doc_id: r.redacted for r in I.redacted(d).collect()}
    assert red[n] == "Write to [EMAIL] or [EMAIL]." and red[n + 3] == docs[n + 3] and red[n + 5] is None and "Zelda" not in red[0]
    assert I.found(d.limit(0)).count() == 0


def test_spelled_mail_labels_and_words_in_lower_case(spark):
    docs = documents(spark) + [
        "Write to ir (at) quillon.example today.", "Die SSN von Zelda Quarn lautet 900-11-7777.", "Dear Sir or Madam, the plant is shut.",
    ] + ["Dear colleagues, no sir, the plan of the sir is dear to us."] * 3
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    n = len(documents(spark))
    got = {}
    for r in I.found(d).collect():
        got.setdefault(r.doc_id, set()).add((r.pii_type, docs[r.doc_id][r.char_start : r.char_end]))
    assert got[n] == {("email", "ir (at) quillon.example")} and ("name", "Zelda Quarn") in got[n + 1] and n + 2 not in got
    assert I.spans("Johann Maria Sebastian de la Cruz van der Berg left.")[0][0] == "name"


def test_words_that_block_numbers_reach_no_further_than_their_label(spark):
    docs = documents(spark) + [
        "They renewed the inventory permit for 789 days. Tel +1 (845) 555 0108 is open.", "The inland permit.\nApplicant's social security number: 930 05 5489.", "Reach the patent desk on +49 30 23125 195.",
        "Commission file number 001-32777; accession 9118695335-90-122641. The permit number: 123456789 holds.", "Commission file\nnumber 001-32778 holds.", "Employer no. of the company: 68-0993959.",
    ]
    n = len(documents(spark))
    got = {}
    for r in I.found(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect():
        if r.pii_type in ("phone", "id"):
            got.setdefault(r.doc_id - n, set()).add((r.pii_type, docs[r.doc_id][r.char_start : r.char_end]))
    assert got[0] == {("phone", "+1 (845) 555 0108")} and got[1] == {("id", "930 05 5489")} and got[2] == {("phone", "+49 30 23125 195")}
    assert not {3, 4, 5} & set(got)
    right = lambda text: [s[5] for s in I.spans(text) if s[0] == "number"]
    assert right("It settled the case. Her tax id is 12 345 678 90.") == right("In this case the SSN 911223004 is his.") == [""] and right("Order No. 1234567") == right("The permit number: 123456789.") == ["!"]


def test_long_documents(spark):
    d = spark.createDataFrame([(1, "word " * 60_000 + "Dr. Zelda Quarn left."), (1, "word " * 60_000 + "Dr. Zelda Quarn left.")], "doc_id long, text string")
    assert [(r.pii_type, r.char_start) for r in I.found(d).collect()] == [("name", 300_004)]


# ---- mixing ----------------------------------------------------------------------------------------------------------


def test_water_fill():
    assert X.water_fill(10, {"a": 1, "b": 1}, {"a": 100, "b": 100}) == {"a": 5, "b": 5}
    assert X.water_fill(10, {"a": 1, "b": 1, "c": 2}, {"a": 1, "b": 100, "c": 100}) == pytest.approx({"a": 1, "b": 3, "c": 6})
    assert X.water_fill(10, {"a": 1}, {"a": 4}) == {"a": 4} and X.water_fill(10, {"a": 0.0}, {"a": 4}) == {"a": 0}


def test_shortage_goes_to_siblings_first():
    leaves = {("p", "en"): 10, ("q", "en"): 1000, ("r", "en"): 1000}
    rows = [{"mix_name": "m", "source": s, "target_share": w, "max_repeats": 1, "size_ratio": 0.1} for s, w in (("p", 30.0), ("q", 20.0), ("r", 50.0))]
    b = {r["source"]: r["budget"] for r in X.budgets(leaves, rows, 2010, {"p": "x", "q": "x", "r": "y"})}
    assert b["p"] == 10 and b["q"] == pytest.approx(201 * 0.5 - 10) and b["r"] == pytest.approx(201 * 0.5)


def test_selection(spark):
    docs = spark.createDataFrame([(k, "word " * 20 + str(k), "en", ("Alpha" if k % 3 else " beta ")) for k in range(400)] + [(900, None, "en", "alpha"), (901, " ", None, None)], "doc_id long, text string, lang string, source string").withColumns({"tokens": F.lit(5), "uses": F.lit(1)})
    t = spark.createDataFrame([("m", "alpha", 75.0, 1, 0.5), ("m", "beta", 25.0, 4, 0.5), ("m", "gone", 0.0, 2, 0.5), ("big", "beta", 1.0, 2, 3.0)], "mix_name string, source string, target_share double, max_repeats int, size_ratio double")
    chosen, report = X.select(docs, t)
    c = chosen.collect()
    assert len({(r.mix_name, r.doc_id) for r in c}) == len(c) and max(r.uses for r in c if r.mix_name == "big") == 2 and all(r.uses == 2 for r in c if r.mix_name == "big")
    rep = {(r.mix_name, r.source): r for r in report.collect()}
    assert rep["m", "alpha"].actual_share == pytest.approx(0.75, abs=0.02) and rep["m", "gone"].tokens == 0
    assert sorted(chosen.collect()) == sorted(X.select(docs, t)[0].collect())
    assert X.select(docs.limit(0), t)[0].count() == 0 and X.select(docs, t.limit(0))[0].count() == 0
    assert {r.actual_share for r in X.select(docs.limit(0), t)[1].collect()} == {0.0}
