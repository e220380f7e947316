"""Encoding, decoding and counting against the libraries."""

import random

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from belfry.llm import bpe, token_counts, word_bpe

ALPHABET = "abcdeéÉ İΣς'sstreve \n\t  é日本語'llm!?--<|endoftext|>0123ßﬁ▁\x85\x00🙂"


def merged(merger, symbols):
    """Plain merging by rank, leftmost first."""
    parts = list(symbols)
    while True:
        ranked = [(r, i) for i in range(len(parts) - 1) if (r := merger.rank(parts[i], parts[i + 1])) is not None]
        if not ranked:
            return parts
        _, i = min(ranked)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    made = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(1, 60))) for _ in range(400)]
    return made + ["", "a" * 900, "ab" * 700, "thethe" * 300, " " * 50, "x <|endoftext|>y<|startoftext|>",
                   "".join(r.choice("abcdefghinorst") for _ in range(2000))]


def test_ids_and_decoding(word_path, texts):
    ours, theirs = word_bpe.WordBpe(word_path), Tokenizer.from_file(word_path)
    for t in texts:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert list(ours.encode(t)) == ids
        assert "".join(ours.decoded(ids)) == theirs.decode(ids, skip_special_tokens=False)


def test_pieces_of_a_block_are_looked_up_once(word_path, texts, monkeypatch):
    """Repeats in a block cost no further look-up; blocks and long pieces of any size give the same ids."""
    coder = word_bpe.WordBpe(word_path)
    want = [list(coder.encode(t)) for t in texts]
    seen, learn = [], coder._learn
    monkeypatch.setattr(coder, "_learn", lambda pieces: seen.append(len(pieces)) or learn(pieces))
    blocks = list(coder.parts(["the cat, the CAT. The\tcat"] * 1000))
    assert seen == [4] and sum(len(ids) for _, ids in blocks) == 8000
    monkeypatch.setattr(word_bpe, "BLOCK", 7)
    for long in (50, 1 << 20):
        monkeypatch.setattr(word_bpe, "LONG", long)
        got = [[] for _ in texts]
        for rows, ids in coder.parts(texts):
            for row, a, b in rows:
                got[row] += ids[a:b].tolist()
        assert got == want


def test_symbols_of_many_pieces_at_once(word_path):
    """Codes by bytes are those of the spelled symbols, piece by piece."""
    coder = word_bpe.WordBpe(word_path)
    for pieces in ([], ["the", "a", "0", "'s"], ["thé", "\u4e2d\u6587", "x", "\U0001f600", "\ud800", "\u0130\u00df"]):
        codes, sizes = coder._codes(pieces)
        spelled = [coder._symbols(p) for p in pieces]
        assert sizes.tolist() == [len(x) for x in spelled]
        assert codes.tolist() == [int(coder.in_step.code[ord(c)]) for c in "".join(spelled)]


def test_spelling_comes_back(word_path):
    coder = word_bpe.WordBpe(word_path)
    assert "".join(coder.spelled(coder.encode("hello wörld 🙂 thethethethe"))) == "hello wörld 🙂 thethethethe "


def test_tokens_that_stay_whole_side_by_side(word_path, piece_path):
    """Undoing merges from the seam on says the same as merging both tokens' symbols together."""
    r = random.Random(8)
    for merger in (word_bpe.WordBpe(word_path).merger, token_counts.PrefixCounter(piece_path).merger):
        tokens = sorted(merger.tokens)
        short = [t for t in tokens if len(t) <= 3]
        answers = set()
        for k in range(6000):
            left, right = r.choice(short if k % 2 else tokens), r.choice(short if k % 3 else tokens)
            if not bpe.ENDED < ord(left[-1]) < bpe.ENDED + 0x200 and merged(merger, list(left)) == [left]:
                whole = merged(merger, list(left) + list(right)) == [left, right]
                assert merger.beside(left, right) == whole
                answers.add(whole)
        assert answers == {True, False}


def test_streams_equal_plain_merging(word_path):
    merger, r = word_bpe.WordBpe(word_path).merger, random.Random(9)
    for n in [*range(1, 40), 3 * merger.lookahead, *[r.randrange(6 * merger.lookahead, 12 * merger.lookahead) for _ in range(6)]]:
        symbols = [r.choice("aeinorst") for _ in range(n)]
        symbols[-1] = word_bpe.ended(symbols[-1] + "</w>")
        assert list(merger.stream(iter(symbols))) == merged(merger, symbols)
    words = ["".join(r.choice("aeinorst") for _ in range(r.randrange(1, 60))) for _ in range(400)]
    words = [w[:-1] + word_bpe.ended(w[-1] + "</w>") for w in words] + ["x"]
    in_step = bpe.WordsInStep(merger)
    nodes, counts = in_step.encode(words)
    ends = counts.cumsum()
    assert [[in_step.texts[n] for n in nodes[e - c:e]] for e, c in zip(ends, counts)] == [merger.encode(w) for w in words]
    assert [len(x) for x in in_step.encode([])] == [0, 0]


def test_stream_holds_little(word_path):
    merger = word_bpe.WordBpe(word_path).merger
    read = 0

    def symbols():
        nonlocal read
        for c in "abcdefgh" * 2000:
            read += 1
            yield c

    first = next(merger.stream(symbols()))
    assert first and read <= 8 * merger.lookahead


def test_counts_of_every_prefix(piece_path, texts):
    ours = token_counts.PrefixCounter(piece_path)
    theirs = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    for t in texts:
        assert ours.total(t) == len(theirs.encode(t))
    for t in texts[:60]:
        table = ours.prefixes(t)
        assert table == [len(theirs.encode(t[:i])) for i in range(len(t) + 1)]
        assert table[ours.fit(t, 7)] <= 7


def test_counts_in_step(piece_path, monkeypatch):
    """Many texts at once, small blocks and tables, parts on both sides of the longest that is counted in step."""
    r = random.Random(3)
    theirs = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    made = ["a" * 70 + " " + "the" * 40, "日本" * 100, "x" * 65, "é" * 64, "ab" * 32, "\x00\x01", "▁▁ ▁", " " * 200, "", "a", "ab" * 3000]
    made += ["".join(r.choice("aeinorstlmÀéйд,.-' ") for _ in range(r.randrange(1, 80))) for _ in range(800)]
    want = [len(theirs.encode(t)) for t in made]
    ours = token_counts.PrefixCounter(piece_path)
    assert ours.totals(made) == want == [ours.total(t) for t in made] and ours.totals([]) == []
    monkeypatch.setattr(token_counts, "BLOCK", 7)
    ours.in_step.seams, ours._units, ours._parts = bpe.SeamTable(6), bpe.Kept(20), bpe.Kept(20)
    assert ours.totals(made) == want


def test_columns(spark, odd_docs, word_path, piece_path):
    n = odd_docs.count()
    coded = odd_docs.select("doc_id", word_bpe.coding_digest(F.col("text"), word_path).alias("c")).collect()
    counted = odd_docs.select("doc_id", token_counts.token_count(F.col("text"), piece_path).alias("n")).collect()
    assert len(coded) == len(counted) == n
    assert all(r.c.n_tokens == 0 for r in coded if r.doc_id == 1) and all(r.n == 0 for r in counted if r.doc_id == 1)
    assert odd_docs.limit(0).select(word_bpe.encoded(F.col("text"), word_path)).count() == 0
    theirs = Tokenizer.from_file(word_path)
    codes = word_bpe.with_codes(odd_docs.withColumn("ids", F.lit("clash")), word_path)
    assert codes.columns == ["doc_id", "key", "ids", "n_tokens", "decoded"] and word_bpe.with_codes(odd_docs.limit(0), word_path).count() == 0
    wanted = sorted((str(r.doc_id), r.key, theirs.encode(r.text or "", add_special_tokens=False).ids) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.key, list(r.ids)) for r in codes.collect()) == wanted
    assert all(r.decoded == theirs.decode(list(r.ids), skip_special_tokens=False) and r.n_tokens == len(r.ids) for r in codes.collect())
    cut = odd_docs.select(token_counts.truncated(F.col("text"), 3, piece_path).alias("t"))
    assert cut.select(F.max(token_counts.token_count(F.col("t"), piece_path))).first()[0] <= 3
