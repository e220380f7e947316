"""BPE encoding and decoding of the word-end vocabulary as bounded-lookahead streams.

Text is read piece by piece (tokens never cross pieces).  A piece is a stream of symbols, whose tokens
leave once no continuation can change them (:meth:`Merger.stream`); of pieces that end within one window that is at
their end, and many of them advance in step.  Blocks hold the pieces of many texts: each different piece is looked up once
and the ids of the block are one array.  Decoding is a state machine over ids: it gives the library's
text (token texts joined by one space), and the spelling that the ids stand for, bytes to text as soon as
characters are complete.  Results of pieces are kept up to a fixed number.

Edge cases: null and empty texts have no ids and decode to the empty text; special strings inside a
text become their special ids, as in the library; unknown ids raise ``KeyError`` while decoding;
repeated rows and extra columns travel unchanged.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from belfry.llm.bpe import END, ENDED, PAIRS_KEPT, Kept, Merger, WordsInStep

PIECES_KEPT, WINDOW = 80_000, 64  # pieces whose results are kept (twice as many); longest that are one window
BLOCK = 1 << 17   # pieces of neighbouring texts handled at once
LONG = 1 << 20    # characters of a text whose pieces are all cut at once, and of a piece whose ids are held at once
IDS = 4096        # ids of a longer piece handled at once
BATCH_CHARS = 1 << 20  # characters of the texts in one batch of rows


def byte_letters() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes: Latin-1 letters stand for themselves, the rest follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def ended(token: str) -> str:
    """A token with its word end, if it has one, in the last symbol."""
    return token[:-len(END) - 1] + chr(ENDED + ord(token[-len(END) - 1])) if token.endswith(END) and len(token) > len(END) else token


def numbered() -> defaultdict:
    """Numbers, from 0 in order of appearance, of whatever is asked for."""
    return defaultdict(count().__next__)


Block = tuple[list[tuple[int, int, int]], np.ndarray]  # (number of the text, first and last place of its next ids), ids


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        merges = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        whole = {(ended(a), ended(b)): i for (a, b), i in merges.items()}
        self.id_of = {ended(t): i for t, i in self.ids.items()}
        self.merger = Merger(lambda a, b: whole.get((a, b)), self.id_of)
        self.in_step = WordsInStep(self.merger)
        self.id_of_node = np.array([self.id_of.get(t, -1) for t in self.in_step.texts])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.letters = byte_letters()
        of_letter = {c: b for b, c in self.letters.items()}

        def raw(token: str) -> bytes:
            """Bytes of a token's spelling: the end of a word and special strings bring a space."""
            if token in self.special:
                return token.encode("utf-8") + b" "
            last = token.endswith(END) and len(token) > len(END)
            return bytes(of_letter[c] for c in (token[:-len(END)] if last else token)) + b" " * last

        #: what each id adds to the spelling
        self.raw = {i: raw(t) for i, t in self.texts.items()}
        self.table = str.maketrans({chr(b): c for b, c in self.letters.items()})
        #: codes of every byte as a symbol, inside a word and at its end
        self.codes, self.end_codes = (np.array([self.in_step.code[up + ord(self.letters[b])] for b in range(256)], dtype=np.int64) for up in (0, ENDED))
        every = range(max(self.texts, default=-1) + 1)
        #: what each id adds to the list of ids and to the decoded text (a space before each), and to the spelling
        self.numbers, self.words, self.spellings = (pa.array(column, pa.binary()) for column in (
            [b" %d" % i for i in every], [b" " + self.texts[i].encode("utf-8") if i in self.texts else b"" for i in every],
            [self.raw.get(i, b"") for i in every]))
        self._pieces = Kept(PIECES_KEPT)

    def forget(self) -> None:
        """Let kept results go: a worker outlives its task, and other stages need the memory."""
        self._pieces, self.merger._beside = Kept(PIECES_KEPT), Kept(PAIRS_KEPT)
        self.in_step.seams.clear()
        pa.default_memory_pool().release_unused()

    def _symbols(self, piece: str) -> str:
        letters = piece.encode("utf-8", "replace").decode("latin-1").translate(self.table)
        return letters[:-1] + chr(ENDED + ord(letters[-1]))

    def _codes(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the symbols of all pieces together, and how many symbols each has."""
        together = "".join(pieces)
        raw = np.frombuffer(together.encode("utf-8", "replace"), dtype=np.uint8)
        spelled = pieces if together.isascii() else [p.encode("utf-8", "replace") for p in pieces]
        sizes = np.fromiter(map(len, spelled), np.int64, len(pieces))
        codes, last = self.codes[raw], np.cumsum(sizes) - 1
        codes[last] = self.end_codes[raw[last]]
        return codes, sizes

    def _pieces_of(self, text: str) -> Iterator[list[str | int]]:
        """Folded pieces of a text, and the ids of special strings in it, many at a time; a piece above ``LONG`` alone."""
        for part in (self.split_special.split(text) if self.split_special else [text]):
            if part in self.special:
                yield [self.special[part]]
                continue
            folded = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()  # letter by letter: no final sigma
            if len(folded) <= LONG:
                yield self.pieces.findall(folded)
                continue
            found = (m.group() for m in self.pieces.finditer(folded))
            while some := list(islice(found, BLOCK)):
                first = 0
                for i in [i for i, p in enumerate(some) if len(p) > LONG]:
                    yield some[first:i]
                    yield some[i:i + 1]
                    first = i + 1
                yield some[first:]

    def _learn(self, pieces: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each of different pieces, and all their ids."""
        known = list(map(self._pieces.young.get, pieces))
        for i in [i for i, ids in enumerate(known) if ids is None]:
            known[i] = (pieces[i],) if isinstance(pieces[i], int) else self._pieces.get(pieces[i])
        fresh = [i for i, ids in enumerate(known) if ids is None]
        short = [i for i in fresh if len(pieces[i]) <= WINDOW]
        nodes, counts = self.in_step.encode_codes(*self._codes([pieces[i] for i in short]))
        flat, at = self.id_of_node[nodes].tolist(), 0
        for i, n in zip(short, counts.tolist()):
            known[i] = held = tuple(flat[at:at + n])
            self._pieces.put(pieces[i], held)
            at += n
        for i in fresh:
            if known[i] is None:
                known[i] = array("i", (self.id_of[t] for t in self.merger.stream(self._symbols(pieces[i]))))
        return np.fromiter(map(len, known), np.int64, len(known)), np.fromiter(chain.from_iterable(known), np.int32)

    def parts(self, texts: Iterable[str]) -> Iterator[Block]:
        """Ids of all texts in blocks, in the order of the texts."""
        number, places, rows = numbered(), array("i"), []
        for row, text in enumerate(texts):
            for pieces in self._pieces_of(text):
                if len(pieces) == 1 and isinstance(pieces[0], str) and len(pieces[0]) > LONG:
                    yield self._settled(number, places, rows)
                    number, places, rows = numbered(), array("i"), []
                    ids = (self.id_of[t] for t in self.merger.stream(self._symbols(pieces[0])))
                    while some := list(islice(ids, IDS)):
                        yield [(row, 0, len(some))], np.array(some, dtype=np.int32)
                    continue
                first = len(places)
                places.extend(map(number.__getitem__, pieces))
                rows.append((row, first, len(places)))
                if len(places) >= BLOCK:
                    yield self._settled(number, places, rows)
                    number, places, rows = numbered(), array("i"), []
        yield self._settled(number, places, rows)

    def _settled(self, number: dict[str | int, int], places: array, rows: list[tuple[int, int, int]]) -> Block:
        counts, flat = self._learn(list(number))
        which = np.frombuffer(places, dtype=np.int32) if places else np.zeros(0, dtype=np.int32)
        many = counts[which]
        ends = np.cumsum(many)
        shift = (np.cumsum(counts) - counts)[which] - (ends - many)
        ids = flat[np.repeat(shift, many) + np.arange(int(many.sum()))]
        bound = np.r_[0, ends].tolist()
        return [(row, bound[a], bound[b]) for row, a, b in rows], ids

    def encode(self, text: str) -> Iterator[int]:
        """Ids of a text."""
        for _, ids in self.parts([text]):
            yield from ids.tolist()

    @staticmethod
    def shown(table: pa.Array, block: Block) -> list[bytes]:
        """What the ids of each of a block's rows add together, by one of the tables."""
        rows, ids = block
        if not len(ids):
            return [b""] * len(rows)
        taken = table.take(pa.array(ids))
        _, places, data = taken.buffers()
        places, data = np.frombuffer(places, dtype=np.int32), memoryview(data)
        return [bytes(data[places[a]:places[b]]) for _, a, b in rows]

    def decoded(self, ids: Iterable[int]) -> Iterator[str]:
        """Pieces of the library's decoded text."""
        gap = ""
        for i in ids:
            yield gap + self.texts[i]
            gap = " "

    def spelled(self, ids: Iterable[int]) -> Iterator[str]:
        """Spelling of a token stream, words ended by one space."""
        speller, source = Speller(self), iter(ids)
        while some := list(islice(source, IDS)):
            yield speller.read(some)
        yield speller.end()


class Speller:
    """Incremental byte-to-text machine: ids in, text out; an unfinished character waits for its other bytes."""

    def __init__(self, coder: WordBpe):
        self.raw = coder.raw
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def read(self, ids: list[int]) -> str:
        return self.take(b"".join(map(self.raw.__getitem__, ids)))

    def take(self, raw: bytes) -> str:
        return self.state.decode(raw)

    def end(self) -> str:
        return self.state.decode(b"", True)


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string, spelled_sha256 string"
_loaded: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One coder per Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encoded(text: Column, path: str) -> Column:
    """Array of token ids."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = word_bpe(path)
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int32)] for _ in range(len(batch))]
            for rows, ids in coder.parts(t or "" for t in batch):
                for row, a, b in rows:
                    out[row].append(ids[a:b])
            yield pd.Series(list(map(np.concatenate, out)), dtype=object)
        coder.forget()

    return run(text)


def decoded(ids: Column, path: str) -> Column:
    """The library's text of an id array (null: empty)."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = word_bpe(path)
        for batch in batches:
            yield pd.Series(["".join(coder.decoded([] if i is None else i)) for i in batch], dtype=object)

    return run(ids)


def with_codes(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The columns of ``df`` but the text, plus ``ids``, ``n_tokens`` and ``decoded``.

    Rows leave in batches of texts of a bounded size, so a task holds few results at a time.  Input columns of
    these names are replaced.
    """
    added = StructType([StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("decoded", StringType())])
    kept = [f.name for f in df.schema if f.name != text and f.name not in added.names]
    schema = StructType([f for f in df.schema if f.name in kept] + added.fields)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_bpe(path)
        for batch in batches:
            texts, others = batch.column(batch.num_columns - 1), [batch.column(i) for i in range(batch.num_columns - 1)]
            for first, some in portions(texts):
                counts, flat, decoded_of = np.zeros(len(some), dtype=np.int64), [], [[] for _ in some]
                for block in coder.parts(some):
                    flat.append(block[1])
                    for (row, a, b), text in zip(block[0], coder.shown(coder.words, block)):
                        counts[row] += b - a
                        decoded_of[row].append(text)
                decoded_of = pa.array([b"".join(t)[1:] for t in decoded_of], pa.binary()).cast(pa.string())
                ends = np.cumsum(np.r_[0, counts]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    *[c.slice(first, len(some)) for c in others], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat))),
                    pa.array(counts), decoded_of], names=schema.names)
        coder.forget()

    def portions(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
        """Neighbouring texts of a bounded number of characters together, with the place of the first."""
        held, size = [], 0
        for row in range(len(texts)):
            held.append(texts[row].as_py() or "")
            size += len(held[-1])
            if size >= BATCH_CHARS or row == len(texts) - 1:
                yield row + 1 - len(held), held
                held, size = [], 0

    return df.select(*kept, text).mapInArrow(coded, schema)


def coding_digest(text: Column, path: str) -> Column:
    """Struct of token count and digests of ids, decoded text and spelling, one pass, constant memory besides the text."""

    @F.pandas_udf(DIGEST)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = word_bpe(path)
        for batch in batches:
            counts = [0] * len(batch)
            hashes = [[hashlib.sha256() for _ in range(3)] for _ in range(len(batch))]
            spellers = [Speller(coder) for _ in range(len(batch))]
            for block in coder.parts(t or "" for t in batch):
                shown = (coder.shown(table, block) for table in (coder.numbers, coder.words, coder.spellings))
                for (row, a, b), numbers, words, spelled in zip(block[0], *shown):
                    of_ids, of_text, of_spelling = hashes[row]
                    of_ids.update(numbers[not counts[row]:])  # no space before the first
                    of_text.update(words[not counts[row]:])
                    of_spelling.update(spellers[row].take(spelled).encode("utf-8"))
                    counts[row] += b - a
            rows = [(n, *(state.hexdigest() for state in states)) for n, states in zip(counts, hashes)]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "spelled_sha256"])
        coder.forget()

    return run(text)
