"""Near duplicates, neighbours, license scans, leaks, quality, WARC and the pipeline."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from belfry.llm import forest, leaks, licenses, near_dups, queries, warc

SF = "/root/testdata/sf0.001"


def sets_of(texts):
    out = {}
    for d, t in texts.items():
        w = (t or "").lower().split()
        k = min(5, len(w))
        out[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()
    return out


def classes_of(texts):
    sets, root = sets_of(texts), {d: d for d in texts}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if (not sets[a] and not sets[b]) or (both and both >= 0.8 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_near_duplicate_classes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.class_id for r in near_dups.near_dup_classes(docs).collect()}
    assert got == classes_of(texts)


def test_near_duplicates_of_odd_rows(spark, odd_docs):
    rows = near_dups.near_dup_classes(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.class_id for r in rows if r.doc_id in (2, 3)} == {2}
    assert near_dups.near_dup_classes(odd_docs.limit(0)).count() == 0
    assert near_dups.one_per_class(odd_docs).columns == odd_docs.columns


def test_texts_without_words_are_one_class(spark):
    rows = [(4, "  "), (5, None), (2, ""), (9, "\n\t"), (7, "\u3000\x1c\x85"), (1, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.class_id for r in near_dups.near_dup_classes(docs).collect()} == {4: 2, 5: 2, 2: 2, 9: 2, 7: 2, 1: 1}
    blank = docs.where("doc_id <> 1")
    assert {r.class_id for r in near_dups.near_dup_classes(blank).collect()} == {2}
    assert [r.doc_id for r in near_dups.one_per_class(blank).collect()] == [2]


def test_one_row_of_each_class(spark):
    """Different texts under one id both stay; near copies without id do not all stay; extra columns travel."""
    words = [f"w{i}" for i in range(60)]
    base, near, other = " ".join(words), " ".join(words[:59] + ["x"]), " ".join(reversed(words))
    rows = [(1, base, "a"), (1, other, "b"), (1, base, "c"), (3, near, "d"), (None, "p q " * 9, "e"), (None, "p q " * 9, "f"), (None, near, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = near_dups.one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id) == sorted([(1, base), (1, other)])
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["p q " * 9]


def test_links_past_the_leaders(spark, monkeypatch):
    """Edits of one text in steps: most pairs lie below 0.8, and blocks of four rows cut every bucket."""
    monkeypatch.setattr(near_dups, "BLOCK_ROWS", 4)
    r = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for d in range(60):
        words = list(base)
        for i in r.choice(120, r.integers(0, 7), replace=False):
            words[i] = f"x{r.integers(0, 4)}"
        texts[d] = " ".join(words)
    want = classes_of(texts)
    assert 2 < len(set(want.values())) < 60
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in near_dups.near_dup_classes(docs).collect()} == want


def test_later_rounds_link_the_roots_so_far(spark, monkeypatch):
    """What one round connected is not gone through again: later pairs are pairs of different roots."""
    monkeypatch.setattr(near_dups, "BLOCK_ROWS", 4)
    r = np.random.default_rng(5)
    texts = {}
    for d in range(60):
        words = [f"w{i}" for i in range(120)]
        for i in r.choice(120, r.integers(0, 7), replace=False):
            words[i] = f"x{r.integers(0, 4)}"
        texts[d] = " ".join(words)
    components, led, rounds = near_dups.components, set(), []

    def spied(pairs):
        pairs = near_dups.written(pairs, "spied")
        found = [(bytes(x.a), bytes(x.b)) for x in pairs.collect()]
        rounds.append(len(found))
        assert all(a != b and a not in led and b not in led for a, b in found)
        out = components(pairs)
        led.update(bytes(x.key) for x in out.where("key <> root").collect())
        return out

    monkeypatch.setattr(near_dups, "components", spied)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in near_dups.near_dup_classes(docs).collect()} == classes_of(texts)
    assert len(rounds) == near_dups.LEADER_ROUNDS + 1 and rounds[0] and sum(rounds[1:])


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(1)
    weights = r.random(200) * 3
    other = weights * r.choice([1, 0.5], 200)
    agree = [np.mean(near_dups.dart_signature(e, weights) == near_dups.dart_signature(e, other))
             for e in r.integers(0, 2 ** 63, (40, 200)).astype(np.uint64)]
    assert abs(np.mean(agree) - np.minimum(weights, other).sum() / np.maximum(weights, other).sum()) < 0.03


def test_recall_of_neighbours(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in df.collect()}
    found = {}
    for r in forest.nearest(df).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = []
    for q in (i for i in rows if i % 20 == 0):
        best = sorted(((-(rows[i] @ rows[q]), i) for i in rows if i != q))[:20]
        hits.append(len({i for _, i in best} & set(found[q])) / 20)
        assert all(abs(s - rows[i] @ rows[q]) < 1e-12 for i, s in found[q].items())
    assert np.mean(hits) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (7, [1.0, 1.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in forest.nearest(df).orderBy("rank").collect()] == [(0, 1, 6), (0, 2, 7)]
    assert forest.nearest(df.limit(0)).count() == 0


def test_repeated_vectors(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.standard_normal(8).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows * 2, "vec_id long, embedding array<double>")
    per_query = {}
    for x in forest.nearest(df).collect():
        per_query.setdefault(x.query_id, []).append(x.vec_id)
    assert len(per_query) == 5 and all(len(v) == len(set(v)) == 20 for v in per_query.values())


def test_base_phrases(spark, odd_docs):
    extra = [(20, "All Rights Reserved. all rights reserved; CC-BY", 0), (21, "GNU general\npublic license", 0), (22, "cc", 0), (23, "This work is licensed under GNU General Public License version 3", 0)]
    docs = odd_docs.unionByName(spark.createDataFrame(extra, odd_docs.schema))
    rows = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert licenses.license_scan(docs).count() == docs.count()
    for r in docs.where("doc_id is not null").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        places = sorted((i, label) for label, p in licenses.BASE for q in [p.split()] for i in range(len(w)) if w[i:i + len(q)] == q)
        got = rows[r.doc_id]
        assert (got.n_words, got.n_base) == (len(w), len(places))
        assert (got.first_word, got.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert got.base_labels == ",".join(sorted({label for _, label in places}))
    assert rows[23].labels == "gpl" and 0.7 <= rows[23].score <= 1 and licenses.license_scan(docs.limit(0)).count() == 0


def test_templates_that_fit(spark):
    words = [f"w{i}" for i in range(64)]
    docs = spark.createDataFrame([(1, "x " + " ".join(words) + " y"), (2, " ".join(words[:40]))], "doc_id long, text string")
    scan = lambda own: {r.doc_id: r.score for r in licenses.license_scan(docs, own=[("long", own)]).collect()}
    assert scan(" ".join(words)) == {1: 1.0, 2: 0.0}
    with pytest.raises(ValueError, match="more than 64"):
        scan(" ".join(words + ["z"]))


def test_leaks(spark, odd_docs):
    item = " ".join(f"b{i}" for i in range(40))
    edited = item.replace("b7 ", "x ").replace("b21 ", "").replace("b33 ", "b33 y ")
    docs = odd_docs.unionByName(spark.createDataFrame([(50, "start " + item + " end", 0), (51, "start " + edited + " end", 0)], odd_docs.schema))
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "too short"), (4, " ".join(f"c{i}" for i in range(40)))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in leaks.leaks(docs, items).collect()}
    assert set(got) == {(50, 1), (51, 1)} and got[50, 1] == 1.0 and 0.8 < got[51, 1] < 1
    assert leaks.without_leaks(docs, items).count() == odd_docs.count()
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0


def test_edited_leaks_beside_an_exact_copy(spark):
    """Every three item places hold a gram that the edits broke and that is therefore rarer than those they left."""
    words = [f"b{i}" for i in range(16)]
    edited = ["x" if i in (4, 9, 14) else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, "start " + " ".join(words) + " end"), (2, "start " + " ".join(edited) + " end")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert {(r.doc_id, r.score) for r in leaks.leaks(docs, items).collect()} == {(1, 1.0), (2, 11.5 / 16)}
    assert leaks.without_leaks(docs, items).count() == 0


def test_long_regions_are_aligned_in_pieces():
    r = np.random.default_rng(4)
    item = [f"b{i}" for i in range(12)]
    for _ in range(200):
        words = [f"b{i}" for i in r.integers(0, 40, 300)]
        at = int(r.integers(0, 280))
        words[at:at + 12] = [w if r.random() > 0.25 else "x" for w in item]
        score, _, _ = leaks.align(words[5:290], item)
        got = leaks.best_alignment(words, 5, 290, item, 0.5, piece=17)
        assert (got[0] if got else None) == (score / 12 if score >= 6 else None)


def test_exact_leaks_of_the_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(docs, items).collect()}
    bench = items.collect()
    assert {(d.doc_id, b.item_id) for d in docs.collect() for b in bench if d.text and b.text in d.text} <= got


def test_quality_ranks_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    scores = queries.QUERIES["op7_quality_classifier"](spark, sf).where("held_out")
    rows = scores.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("quality", "score").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.8


def test_warc_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = con.execute(queries.ORACLES["op4_warc"]).fetchall()
    assert sorted(map(tuple, queries.QUERIES["op4_warc"](spark, SF).collect()), key=str) == sorted(want, key=str)


def test_warc_of_odd_rows(spark):
    long = "p" * 1200
    pages = spark.createDataFrame([(1, None, None, 0), (2, "u", long, 0), (3, "u v", long, 0), (None, "w", long, 0), (3, "u v", long, 0)],
                                  "page_id long, url string, html string, n int")
    rows = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect()), key=str)
    assert rows == sorted([(1, "response", None), (2, "revisit", 3), (3, "response", None), (3, "response", None), (None, "response", None)], key=str)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_pipeline_keeps_what_each_stage_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, docs, SF), "stage")
        assert after.columns == docs.columns, name
        assert after.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        if name == "near-dedup":
            classes = classes_of({r.doc_id: r.text for r in docs.collect()})
            assert {r.doc_id for r in after.collect()} == set(classes.values())
        docs = after
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count() and out.where(F.size("ids") != F.col("n_tokens")).count() == 0
