"""Classifier, leaks and pipeline stages on odd rows, and against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from belfry.llm import leaks, licenses, quality

SF = "/root/testdata/sf0.001"


def test_quality_of_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(1, None, 0), (None, 1, 0), (9999, 1, 0), (2, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    texts = spark.createDataFrame([(i, ("plain words of good prose %d " if i % 2 else "BUY!!! $$$ click %d now ") % i * 9) for i in range(400)], "doc_id long, text string")
    model = quality.fit_quality(texts, labels)
    docs = odd_docs.withColumn("score", F.lit("input"))
    scored = quality.with_quality_score(docs, model)
    rows = scored.collect()
    assert sorted(scored.columns) == sorted(docs.columns) and len(rows) == odd_docs.count()
    assert all(0 <= r.score <= 1 for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())  # null and empty alike, repeated rows alike
    good, bad = (quality.with_quality_score(texts.where(f"doc_id % 2 = {q}"), model).agg(F.avg("score")).first()[0] for q in (1, 0))
    assert good > 0.8 > 0.2 > bad
    assert quality.with_quality_score(docs.limit(0), model).count() == 0
    for some in (labels.limit(0), labels.where("quality = 1")):
        share = quality.with_quality_score(texts, quality.fit_quality(texts, some)).select("score").distinct().collect()
        assert len(share) == 1 and 0 <= share[0].score <= 1
    assert quality.fit_quality(texts.limit(0), labels).prior == 0.5


def test_long_texts_reach_the_dictionary(spark):
    """Good and bad wording that stands late in long texts is learned."""
    rows = [(i, "same words at the start " * 400 + ("calm and careful prose %d " if i % 2 else "win cash %d fast ") % i * 300) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    scores = {r.doc_id: r.score for r in quality.with_quality_score(docs, model).collect()}
    assert np.mean([scores[a] > scores[b] for a in range(1, 60, 2) for b in range(0, 60, 2)]) > 0.95


def test_leaks_against_all_alignments(spark):
    """Every document is aligned with every item; a pair counts if it shares a seed."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").limit(n) for t, n in (("documents", 120), ("benchmark", 20)))
    docs = docs.select("doc_id", "text")
    parts = [(10_000 + i, " ".join(w if (i + j) % 6 else "zz" for j, w in enumerate(words(r.text)))) for i, r in enumerate(items.collect())]
    docs = docs.unionByName(spark.createDataFrame([(i, "before " + t + " after") for i, t in parts], "doc_id long, text string"))
    grams = lambda w: {tuple(w[i:i + leaks.GRAM]) for i in range(len(w) - leaks.GRAM + 1)}
    want = {}
    for d in docs.collect():
        held = words(d.text)
        for item in items.collect():
            asked = words(item.text)
            if asked and grams(held) & grams(asked):
                score = max(leaks.align(held[at:at + 4000], asked)[0] for at in range(0, max(1, len(held)), 3000)) / len(asked)
                if score >= leaks.ACCEPT:
                    want[d.doc_id, item.item_id] = score
    assert {(r.doc_id, r.item_id): r.score for r in leaks.leaks(docs, items).collect()} == want and len(want) > 10


def test_license_spans_against_every_place(spark):
    """Labels and scores of the method's own templates, from the best place of each in the text."""
    rng = np.random.default_rng(4)
    phrases = [p for _, p in licenses.OWN]
    rows = []
    for i in range(120):
        words = phrases[i % len(phrases)].split(" ")
        keep = [w if rng.random() > 0.12 * (i % 4) else "zz" for w in words]
        rows.append((i, " ".join(["aa"] * int(rng.integers(0, 5)) + keep + ["bb"] * int(rng.integers(0, 5)))))
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        words = text.split(" ")
        pairs = list(zip(words, words[1:]))
        labels, best = {label for label, p in licenses.BASE if re.search(rf"\b{p}\b", text)}, 1.0 if any(re.search(rf"\b{p}\b", text) for _, p in licenses.BASE) else 0.0
        for label, p in licenses.OWN:
            asked = list(zip(p.split(" "), p.split(" ")[1:]))
            hits = {(at - j, j) for at, pair in enumerate(pairs) for j, q in enumerate(asked) if q == pair}
            diagonals = sorted({d for d, _ in hits})
            groups, run = [], []
            for d in diagonals:
                if run and d - run[-1] > licenses.NEAR:
                    groups.append(run)
                    run = []
                run.append(d)
            for group in groups + [run] * bool(run):
                share = len({j for d, j in hits if d in group}) / len(asked)
                if share >= licenses.ACCEPT:
                    labels.add(label)
                    best = max(best, share)
        assert got[i].labels == ",".join(sorted(labels)) and got[i].score == pytest.approx(best), (i, text)


@pytest.fixture
def odd_corpus(spark):
    words = " ".join(f"w{i}" for i in range(120))
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, words, "en", "a", 5), (2, words, "en", "a", 5), (2, " ".join(reversed(words.split())), None, "b", 5),
            (3, "  \n", "fr", None, 3), (None, words.replace("w7 ", ""), "en", "c", 9), (4, "é🙂\x00 " * 300, "de", "d", 1), (5, "z" * 2000, "en", "a", 2000)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_rows(spark, odd_corpus, number):
    """Nulls, empty and blank texts, repeated and missing ids, an empty table."""
    name, stage = corpus_pipeline.STAGES[number]
    after = corpus_pipeline.written(stage(spark, odd_corpus, SF), "odd")
    kept = after.collect()
    if number == len(corpus_pipeline.STAGES) - 1:
        assert len(kept) == odd_corpus.count() and all(len(r.ids) == r.n_tokens for r in kept)
    else:
        assert after.columns == odd_corpus.columns
        assert {r.doc_id for r in kept} <= {r.doc_id for r in odd_corpus.collect()}
    if name == "near-dedup":
        assert sorted((r.doc_id, (r.text or "")[:2]) for r in kept) == [(1, ""), (2, "w0"), (2, "w1"), (4, "é🙂"), (5, "zz")]
    assert stage(spark, odd_corpus.limit(0), SF).count() == 0
