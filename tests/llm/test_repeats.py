"""Repeated byte and word windows against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd

import corpus_pipeline
from belfry.llm import byte_dedup, repeats, suffixes, word_dedup


def covered(units, window, counts):
    gone = [False] * len(units)
    for i in range(len(units) - window + 1):
        if counts[tuple(units[i:i + window])] > 1:
            gone[i:i + window] = [True] * window
    return gone


def windows(texts, window):
    return Counter(tuple(t[i:i + window]) for t in texts for i in range(len(t) - window + 1))


def expected_bytes(texts, window):
    raws = [(t or "").encode() for t in texts]
    counts, out = windows(raws, window), []
    for r in raws:
        gone = covered(r, window, counts)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def expected_words(texts, window):
    lists = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    counts, out = windows(lists, window), []
    for w in lists:
        gone = covered(w, window, counts)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_suffix_array_and_common_prefixes(monkeypatch):
    r = random.Random(3)
    for _ in range(300):
        monkeypatch.setattr(suffixes, "WIDE", r.choice([0, 4096]))
        s = [r.randrange(r.choice([1, 2, 5])) for _ in range(r.randrange(1, 50))]
        want = sorted(range(len(s)), key=lambda i: s[i:])
        order = suffixes.suffix_array(np.array(s, dtype=np.uint16))
        assert order.tolist() == want
        before, shared = suffixes.common_prefixes(np.array(s, dtype=np.uint16), order, 10 ** 6)
        for a, b in zip(want, want[1:]):
            n = 0
            while n < len(s) - max(a, b) and s[a + n] == s[b + n]:
                n += 1
            assert (before[b], shared[b]) == (a, n)


def test_matches_that_run_past_a_string_end():
    """Strings that share suffixes and prefixes: a match over the end of one must not shorten those of the next."""
    r = random.Random(5)
    text = lambda n: bytes(r.randrange(97, 123) for _ in range(n))
    suffix, prefix = text(390), text(450)
    joined = [text(50) + suffix, prefix + text(30), text(50) + suffix, prefix + text(40)]
    base, copies = text(600), []
    for _ in range(20):
        at = r.randrange(600)
        copies.append(base[:at] + text(3) + base[at + 1:])
    for strings, window in ((joined, 400), (copies, 400), (copies, 40)):
        counts = windows(strings, window)
        want = [[counts[tuple(t[i:i + window])] > 1 for i in range(max(0, len(t) - window + 1))] for t in strings]
        assert sum(map(sum, want)) > 0
        assert [m.tolist() for m in suffixes.repeated_starts(strings, window)] == want


def compare(df, got, expected):
    rows = df.collect()
    assert Counter(map(tuple, got.collect())) == Counter((r.doc_id, *e) for r, e in zip(rows, expected([r.text for r in rows])))


def test_bytes(spark, odd_docs):
    for window in (30, 400):
        compare(odd_docs, byte_dedup.removal_digest(odd_docs, window), lambda t: expected_bytes(t, window))


def test_words(spark, odd_docs):
    compare(odd_docs, word_dedup.removal_digest(odd_docs), lambda t: expected_words(t, 35))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    compare(docs, byte_dedup.removal_digest(docs), lambda t: expected_bytes(t, 400))
    compare(docs, word_dedup.removal_digest(docs), lambda t: expected_words(t, 35))


def test_heavy_keys_are_counted_window_by_window(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(repeats, "HEAVY", 0)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(odd_docs.select("doc_id", "text"))
    compare(docs, byte_dedup.removal_digest(docs), lambda t: expected_bytes(t, 400))
    compare(docs, word_dedup.removal_digest(docs), lambda t: expected_words(t, 35))


def test_no_task_judges_more_than_a_bound(spark, monkeypatch):
    """One passage beside 200 different contexts: all its strings have few keys."""
    monkeypatch.setattr(repeats, "HEAVY", 20_000, raising=False)
    r = random.Random(7)
    text = lambda n: bytes(r.randrange(97, 123) for _ in range(n)).decode()
    passage = text(390)
    texts = [text(300) + passage + text(i % 7 and 300) for i in range(200)] + [text(20) + passage + "same tail" * 3] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    judge = suffixes.repeated_starts

    def bounded(strings, window):
        assert sum(map(len, strings)) <= 100_000
        return judge(strings, window)

    monkeypatch.setattr(suffixes, "repeated_starts", bounded)
    compare(docs, byte_dedup.removal_digest(docs), lambda t: expected_bytes(t, 400))


def test_gram_hashes_are_polynomials():
    r = np.random.default_rng(2)
    for n in (0, 1, 5, 24, 40, 300):
        units = r.integers(0, 2 ** 63, n).astype(np.uint64)
        for k in (1, 2, 3, 4, 7, 24, 31, 32):
            want = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
            for j in range(k if len(want) else 0):
                want = want * repeats.MULTIPLIER + units[j:j + len(want)]
            assert repeats.gram_hashes(units, k).tolist() == repeats.mixed(want).tolist()


def _wants(texts, first=0):
    return pd.DataFrame({"text": texts, "wants": [[{"key": first + i, "digest": b"d%d" % i, "n": 1, "start": i % 5, "size": 2}] for i in range(len(texts))]})


def test_strings_of_many_bytes_leave_in_few_batches():
    """One batch holds the strings of many texts: a batch for each text cost more than all the rest."""
    texts = [f"{i:05d}" * 20 for i in range(3000)]
    out = list(repeats.wanted_strings(iter([_wants(texts[:1000]), _wants(texts[1000:], 1000)]), byte_dedup._bytes, byte_dedup._pack, 30))
    assert len(out) == 1 and len(list(repeats.wanted_strings(iter([]), byte_dedup._bytes, byte_dedup._pack, 30))[0]) == 0
    assert out[0]["string"].tolist() == [t[j % 5:j % 5 + 31].encode() for t, j in zip(texts, [*range(1000), *range(2000)])]
    assert out[0]["key"].tolist() == list(range(3000))


def test_strings_of_many_words_leave_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(repeats, "BYTES", 1000)
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(200)]
    out = list(repeats.wanted_strings(iter([_wants(texts)]), word_dedup.WORD.findall, word_dedup._pack, 35))
    assert 10 < len(out) < 100 and all(sum(map(len, b["string"])) < 1500 for b in out)
    assert [x for b in out for x in b["string"]] == [" ".join(t.split(" ")[i % 5:i % 5 + 36]).encode() for i, t in enumerate(texts)]


def test_planted_passages_of_over_fifty_words(spark):
    """Verbatim passages in two documents each are removed whole, other documents stay as they are."""
    r = random.Random(11)
    words = lambda n: ["".join(r.choice("aeinorst") for _ in range(r.randrange(2, 9))) for _ in range(n)]
    texts, sizes = [" ".join(words(200)) for _ in range(60)], {}
    for i in range(0, 40, 2):
        passage = words(r.randrange(51, 70))
        for j in (i, i + 1):
            own, at = texts[j].split(" "), r.randrange(200)
            texts[j], sizes[j] = " ".join(own[:at] + passage) + r.choice(" \n\t") + " ".join(own[at:]), len(passage)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {row.doc_id: row.n_removed for row in word_dedup.removal_digest(docs).collect()} == {i: sizes.get(i, 0) for i in range(60)}


def test_pipeline_cuts_passages_of_over_fifty_words(spark):
    """Passages of 51 words and fewer than 400 bytes leave both of their documents; the rest of each stays."""
    r = random.Random(12)
    words = lambda n: ["".join(r.choice("aeinorst") for _ in range(r.randrange(3, 9))) for _ in range(n)]
    texts, want = [" ".join(words(200)) for _ in range(30)], {}
    for i in range(0, 20, 2):
        passage = " ".join(words(51))
        assert 200 < len(passage) < 400
        for j, (left, right) in ((i, "(["), (i + 1, "{}")):  # other neighbours in either document
            own, at = texts[j].split(" "), r.randrange(200)
            before, after = " ".join(own[:at]) + left, right + " ".join(own[at:])
            texts[j], want[j] = before + passage + after, before + after
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {row.doc_id: (row.text, row.n_chars) for row in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert got == {i: (want.get(i, t), len(want.get(i, t))) for i, t in enumerate(texts)}


def test_empty_and_extra_columns(spark, odd_docs):
    assert byte_dedup.removal_digest(odd_docs.limit(0)).count() == 0
    assert word_dedup.removal_digest(odd_docs.limit(0)).count() == 0
    cut = byte_dedup.with_repeats_removed(odd_docs, keep_text=True)
    assert cut.columns == ["doc_id", "text", "key", "__cut"] and cut.count() == odd_docs.count()
