"""Toxicity, quality and language identification: held-out accuracy and odd rows."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.llm import language_id, quality, toxicity

DATA = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="fixture tables are not here")


@here
def test_toxicity_held_out(spark):
    """On the table of 10,000 documents: the smaller one has six toxic documents among those held out."""
    data = DATA.replace("0.01", "0.1")
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in toxicity.op10_toxicity(spark, data).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    known = [(rows[r.doc_id], r.toxic) for r in labels.collect()]
    held = [(r.score, y) for r, y in known if r.held_out]
    above = [(a > b) + 0.5 * (a == b) for a, x in held if x for b, y in held if not y]
    assert np.mean(above) > 0.9
    assert np.mean([r.predicted == y for r, y in known]) > 0.9


def test_toxicity_tolerates_gaps_and_insertions():
    rnd = np.random.default_rng(1)
    word = lambda: "".join(rnd.choice(list("aeioutnrshld"), rnd.integers(2, 9)))
    clean = [[word() for _ in range(30)] for _ in range(300)]
    toxic = [[*(word() for _ in range(30)), ["stupid", "moron", "worthless"][i % 3]] for i in range(120)]
    model = toxicity.train(toxic, clean)
    score = lambda t: model.probability(max(model.words([u for c in toxicity.chunks_of(t) for u in toxicity.units(c)]), default=toxicity.NO_EVIDENCE))
    assert all(score(t) >= 0.5 for t in ("you stupid", "STUPID!", "s.t.u.p.i.d", "s t u p i d", "st*upid", "stuupid", "mo-ron"))
    assert all(score(t) < 0.5 for t in ("", "...", "the house", "hold on"))


def test_toxicity_windows_hold_every_stretch():
    """Up to 16 letters of a long run lie whole in some window, at every offset, glued or written apart."""
    letters = "".join(chr(97 + i * i * 7 % 23) for i in range(130))
    for n in range(25, 130):
        found = toxicity.units(letters[:n])
        assert all(any(letters[a : a + 16] in u for u in found) for a in range(n - 15)) and all(len(u) <= toxicity.WINDOW for u in found)
        apart = {u for c in toxicity.chunks_of(" ".join(letters[:n])) for u in toxicity.units(c)}
        assert set(found) <= apart
    filler = "nahotirelasinohatuleranishodate" * 3
    model = toxicity.train([["nahotire", "lasino", "stupid"]] * 40, [["nahotire", "lasino", "hatuleran", "ishodate"]] * 40)
    margins = [max(model.words(toxicity.units(filler[:a] + "stxupxid" + filler[a:]))) for a in range(60)]
    assert min(margins) > max(model.words(toxicity.units(filler)))


def test_toxicity_odd_rows(odd, odd_rows, none, spark):
    none_labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(odd, none_labels) is None
    rows = toxicity.score_toxicity(odd, None).collect()
    assert len(rows) == len(odd_rows) and {r.score for r in rows} == {0.0}
    model = toxicity.train([["stupid", "one"]] * 20, [["two", "three"]] * 20)
    rows = toxicity.score_toxicity(odd, model).collect()
    assert len(rows) == len(odd_rows) and all(r.held_out is False for r in rows if r.doc_id is None)
    assert {r.predicted for r in rows if dict(odd_rows[:6]).get(r.doc_id) == "stupid"} == {1}
    assert toxicity.score_toxicity(none, model).count() == 0


@here
def test_quality_grades(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    train, test = (quality.label_ratings(labels.where(c)) for c in ("doc_id % 2 = 0", "doc_id % 2 = 1"))
    model = quality.train(*quality.training_sample(docs, train))
    assert (np.diff(model.thresholds) > 0).all()
    rows = quality.grade_documents(docs, model).join(test, "doc_id").collect()
    assert np.mean([r.keep == (r.grade >= 1) for r in rows]) > 0.9


def test_quality_odd_rows(odd, odd_rows, none):
    assert quality.train([], [], np.zeros(0, int)) is None
    assert all(r.keep and r.expected_grade is None for r in quality.grade_documents(odd, None).collect())
    texts = ["GOOD WORDS!!"] * 10 + ["plain words here"] * 10 + ["other stuff"] * 10
    vectors = [quality.vector(t) for t in texts]
    model = quality.train([v[0] for v in vectors], [v[1] for v in vectors], np.repeat([0, 1, 2], 10))
    rows = quality.grade_documents(odd, model).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.expected_grade <= 2 for r in rows)
    assert {r.expected_grade for r in rows if r.doc_id in (3, 4, 5)} == {0.0}
    assert quality.grade_documents(none, model).count() == 0


@here
def test_language_of_unseen_documents_and_pages(spark):
    """Trained on one half of the documents, judged on the other: documents by the text alone, pages by text and priors
    without what they declare, held against that."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.train(docs.where("doc_id % 2 = 0"))
    unseen = docs.where("doc_id % 2 = 1")
    rows = language_id.identify(language_id.document_records(unseen), model).join(unseen.select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()
    assert len(rows) == unseen.count() and np.mean([r.text_lang == r.truth for r in rows if r.text_lang]) > 0.98 and np.mean([r.lang == r.truth for r in rows]) > 0.98
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    records = language_id.page_records(pages)
    declared = {r.page_id: r.declared for r in records.select("page_id", "declared").collect()}
    blind = records.withColumn("declared", F.lit(None).cast("string")).withColumn("url", F.lit(None).cast("string"))
    found = language_id.identify(blind, model).collect()
    assert len(found) == pages.count() and np.mean([r.lang == declared[r.page_id] for r in found]) > 0.95


@here
def test_language_query_covers_both_tables(spark):
    rows = language_id.op2_language_id(spark, DATA.replace("0.01", "0.001"))
    docs, pages = (spark.read.parquet(f"{DATA.replace('0.01', '0.001')}/{t}.parquet").count() for t in ("documents", "pages"))
    assert rows.where("doc_id IS NOT NULL").count() == docs and rows.where("page_id IS NOT NULL").count() == pages


@here
def test_language_rows_do_not_depend_on_partitions(spark):
    data = DATA.replace("0.01", "0.001")
    docs, pages = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "pages"))
    found = []
    for n in (1, 8, 64):
        model = language_id.train(docs.repartition(n))
        records = language_id.document_records(docs).unionByName(language_id.page_records(pages)).repartition(n)
        found.append(sorted(map(str, language_id.identify(records, model).collect())))
    assert found[0] == found[1] == found[2]


def test_language_posterior_equals_its_formula(spark):
    """The whole posterior on a small table, by hand: text, declared language, address code and host prior."""
    docs = spark.createDataFrame([("the and the house", "en"), ("der und haus", "de"), ("und und", "de")], "text string, lang string")
    model = language_id.train(docs)
    pages = [(1, "https://a.x.org/de/1", "<html lang=en>the house"), (2, "https://a.x.org/2", "der und"), (3, "https://b.x.org/3", "und the the"), (4, "https://c.y.de/4", "zzz"), (5, None, "<html lang=de>")]
    got = {r.page_id: r for r in language_id.identify(language_id.page_records(spark.createDataFrame(pages, "page_id long, url string, html string")), model).collect()}
    counts = {}
    for text, lang in (("the and the house", "en"), ("der und haus", "de"), ("und und", "de")):
        for w in text.split():
            for f in language_id.slots_of(w):
                counts[lang, f] = counts.get((lang, f), 0) + 1
    languages, slots = ["de", "en"], {f for _, f in counts}
    log = lambda lang, f: np.log((counts.get((lang, f), 0) + 1) / (sum(n for (c, _), n in counts.items() if c == lang) + len(slots)))

    def text_of(text):
        own = [f for w in text.split() for f in language_id.slots_of(w) if f in slots]
        return [language_id.TEMPER * sum(log(c, f) - np.mean([log(x, f) for x in languages]) for f in own) for c in languages]

    read = {1: "the house", 2: "der und", 3: "und the the", 4: "zzz", 5: ""}
    logs = {i: text_of(t) for i, t in read.items()}
    best = {i: None if x[0] == x[1] else languages[int(np.argmax(x))] for i, x in logs.items()}
    hosts = {1: "a.x.org", 2: "a.x.org", 3: "b.x.org", 4: "c.y.de", 5: ""}
    told = {"declared": {1: "en", 5: "de"}, "address": {1: "de", 4: "de"}}
    whole = [(sum(b == c for b in best.values()) + 1) / (sum(b is not None for b in best.values()) + 2) for c in languages]

    def table(kind, row, lang):
        pairs = [(v, best[i]) for i, v in told[kind].items() if best[i]]
        total = sum(x == lang for _, x in pairs)
        return np.log((pairs.count((row, lang)) + (language_id.RELIABILITY if row == lang else 0) + 0.5) / (total + language_id.RELIABILITY + 1))

    for i in read:
        p = whole
        for level in (lambda h: h.split(".")[-1], lambda h: ".".join(h.split(".")[-2:]), lambda h: h):
            n = [sum(best[j] == c for j in read if level(hosts[j]) == level(hosts[i])) for c in languages]
            p = [(n[k] + language_id.STRENGTH * p[k]) / (sum(n) + language_id.STRENGTH) for k in range(2)]
        total = [logs[i][k] + np.log(p[k]) + sum(table(kind, v[i], c) for kind, v in told.items() if i in v) for k, c in enumerate(languages)]
        share = np.exp(total) / np.exp(total).sum()
        assert got[i].lang == languages[int(np.argmax(share))] and abs(got[i].probability - share.max()) < 2e-6, i


def test_language_evidence(spark):
    docs = spark.createDataFrame([("the and of with house", "en"), ("der und die mit haus", "de"), (None, "en"), ("x", None)], "text string, lang string")
    model = language_id.train(docs)
    assert model.languages == ["de", "en"]
    schema = "page_id long, url string, html string"
    html = [
        (1, "https://a.example.org/x", "<html lang='de'><p>the and of with the house</p><script>der die und</script>"), (2, "https://b.example.de/", None), (3, None, None), (4, "https://h.example.org/de/1", ""),
        (5, "https://h.example.org/1", "der und die mit"), (6, "https://h.example.org/2", "der die"), (7, "https://h.example.org/3", "<p>...</p>"), (None, "no address", "<html lang=xx>"),
    ]
    got = {r.page_id: r for r in language_id.identify(language_id.page_records(spark.createDataFrame(html, schema)), model).collect()}
    assert got[1].text_lang == "en" and got[1].declared == "de"
    assert (got[2].address_lang, got[2].lang) == ("de", "de") and got[3].text_lang is None and got[3].lang is not None
    assert got[4].lang == "de" and got[7].lang == "de" and got[7].text_lang is None  # the host's other pages decide
    assert got[None].declared is None and got[None].host is None
    empty = language_id.identify(language_id.page_records(spark.createDataFrame([], schema)), model)
    assert empty.count() == 0
    nothing = language_id.train(docs.where("false"))
    assert {r.lang for r in language_id.identify(language_id.page_records(spark.createDataFrame(html, schema)), nothing).collect()} == {None}


def test_language_counts_are_exact(spark):
    """Counts don't depend on how rows are dealt, and a language without any feature is known."""
    texts = [" ".join(f"{a}{b}{c}" for c in "abcdefghijklmnopqrstuvwxyz") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"] + ["aaa bbb"] * 50
    docs = spark.createDataFrame([(t, "en") for t in texts] + [("...", "fi")], "text string, lang string")
    want = np.zeros(language_id.SLOTS, np.int64)
    for text in texts:
        for w in text.split():
            for slot in language_id.slots_of(w):
                want[slot] += 1
    for parts in (1, 5):
        model = language_id.train(docs.repartition(parts))
        assert model.languages == ["en", "fi"]
        assert (model.weights == language_id.weights_of(np.stack([want, np.zeros_like(want)]))).all()


def test_quality_equals_its_formula(spark):
    """Grade probabilities, expected grade and tail by hand from weights and thresholds; ratings that leave out a value."""
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(size=quality.WIDTH), np.array([-0.7, 0.4]), np.array([0, 2, 50]))
    texts = ["Good words, good words!", "one", "a b c d e " * 12, "ÄÖ 12-x"]
    rows = quality.grade_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, at_least=2).collect()
    for r in rows:
        words = texts[r.doc_id].split()
        score = sum(0.5 * model.weights[quality.word_slots(w)[0]] + model.weights[quality.word_slots(w)[1]] for w in words) / len(words)
        score += model.weights[quality.repeat_slot(len(words), len(set(words)))]
        below = [1 / (1 + np.exp(score - t)) for t in model.thresholds]
        p = [below[0], below[1] - below[0], 1 - below[1]]
        assert abs(r.expected_grade - (2 * p[1] + 50 * p[2])) < 2e-6 and abs(r.tail_probability - p[1] - p[2]) < 2e-6
    vectors = [quality.vector(t) for t in ["bad"] * 9 + ["fine"] * 9]
    assert quality.train([v[0] for v in vectors], [v[1] for v in vectors], np.repeat([3, 1000], 9)).values.tolist() == [3, 1000]


def test_quality_shape_reads_whole_words():
    assert quality.shape("a" * 64 + "7B-") == "a0A-" and quality.word_slots("a" * 64 + "7")[1] != quality.word_slots("a" * 64)[1]
