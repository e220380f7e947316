"""Exact token counts at every prefix, for the sentence-piece vocabulary.

A text falls into units that no piece crosses (a run of spaces with what follows it; characters that
no longer piece contains stand alone), and a unit into parts, cut between two characters that stand side by
side in no piece.  Within a part the prefix table of :class:`Merger` holds the count of every prefix, so
totals, truncation points and budget checks are look-ups and sums.

Edge cases: null and empty texts count zero tokens; special strings inside a text are plain text, as in
the library's default; repeated rows and extra columns travel unchanged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from belfry.llm.bpe import Kept, Merger, WordsInStep

SPACE = "▁"
UNITS_KEPT = 100_000  # units and parts whose counts are kept (twice as many)
SHORT = 64     # longest part that is counted in step with others; a longer one fills its table alone
BLOCK = 1 << 15  # units counted at once


class PrefixCounter:
    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size())
                 if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        order = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in order):
            raise ValueError("a piece crosses the start of a word: units would not be independent")
        self.order = order
        self.merger = Merger(lambda a, b: order.get(a + b), order)
        joined = sorted({c for p in order if len(p) > 1 for c in p} - {SPACE})
        inside = "[" + "".join(map(regex.escape, joined)) + "]"
        self.units = regex.compile(f"{SPACE}*{inside}+|{SPACE}+|.", regex.DOTALL)
        self.beside = {p[i:i + 2] for p in order for i in range(len(p) - 1)}
        self._units, self._parts = Kept(UNITS_KEPT), Kept(UNITS_KEPT)
        self.in_step = WordsInStep(self.merger)

    def _parts_of(self, unit: str) -> list[str]:
        """The unit, cut where no piece can lie."""
        out, start, beside = [], 0, self.beside
        for i in range(1, len(unit)):
            if unit[i - 1:i + 1] not in beside:
                out.append(unit[start:i])
                start = i
        out.append(unit[start:])
        return out

    def part_counts(self, part: str) -> list[int]:
        """Token counts of every non-empty prefix of one part."""
        counts, order = [0], self.order
        for i, token in enumerate(self.merger.last_tokens(list(part)), 1):
            # characters outside the vocabulary fall back to their bytes
            counts.append(counts[i - len(token)] + (1 if token in order else len(token.encode("utf-8"))))
        return counts[1:]

    def _learn(self, parts: list[str]) -> dict[str, int]:
        """Token counts of different parts."""
        known = {p: n for p in parts if (n := self._parts.get(p)) is not None}
        rest = [p for p in parts if p not in known]
        together = [p for p in rest if 1 < len(p) <= SHORT]
        fresh = dict(zip(together, self.in_step.encode(together)[1].tolist()))
        fresh |= {p: self.part_counts(p)[-1] for p in rest if p not in fresh}
        for part, n in fresh.items():
            if len(part) <= SHORT:
                self._parts.put(part, n)
        return known | fresh

    def _unit_totals(self, units: set[str]) -> dict[str, int]:
        """Token counts of different units."""
        known = {u: n for u in units if (n := self._units.get(u)) is not None}
        cut = {u: self._parts_of(u) for u in units if u not in known}
        learned = self._learn(list({p for parts in cut.values() for p in parts}))
        for unit, parts in cut.items():
            known[unit] = n = sum(map(learned.__getitem__, parts))
            if len(unit) <= SHORT:
                self._units.put(unit, n)
        return known

    def _marked(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE)

    def totals(self, texts: Iterable[str]) -> list[int]:
        """Token counts of many texts; units of neighbouring texts are counted together, a long text in blocks."""
        out: list[int] = []
        held: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            known = self._unit_totals({u for _, units in held for u in units})
            for row, units in held:
                out[row] += sum(map(known.__getitem__, units))
            held.clear()

        for text in texts:
            out.append(0)
            found = (m.group() for m in self.units.finditer(self._marked(text))) if text else iter(())
            while units := list(islice(found, BLOCK)):
                held.append((len(out) - 1, units))
                size += len(units)
                if size >= BLOCK:
                    settle()
                    size = 0
        settle()
        return out

    def total(self, text: str) -> int:
        return self.totals([text])[0]

    def prefixes(self, text: str) -> list[int]:
        """Entry i: tokens of the first i characters."""
        if not text:
            return [0]
        out, base = [], 0
        for found in self.units.finditer(self._marked(text)):
            for part in self._parts_of(found.group()):
                counts = self.part_counts(part)
                out += [base + c for c in counts]
                base += counts[-1]
        return [0] + out[1:]  # out[0] belongs to the mark put before the text

    def fit(self, text: str, budget: int) -> int:
        """Length of the longest prefix whose count is at most ``budget``."""
        table = self.prefixes(text)
        return max(i for i, n in enumerate(table) if n <= budget)


_loaded: dict[str, PrefixCounter] = {}


def prefix_counter(path: str) -> PrefixCounter:
    """One counter per Python worker."""
    if path not in _loaded:
        _loaded[path] = PrefixCounter(path)
    return _loaded[path]


def _column(kind: str, path: str, value) -> callable:
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = prefix_counter(path)
        for batch in batches:
            yield pd.Series([value(counter, t or "") for t in batch])
    return run


def token_count(text: Column, path: str) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = prefix_counter(path)
        for batch in batches:
            yield pd.Series(counter.totals(t or "" for t in batch))

    return run(text)


def prefix_counts(text: Column, path: str) -> Column:
    """Array whose element i counts the tokens of the first i characters."""
    return _column("array<long>", path, lambda c, t: c.prefixes(t))(text)


def truncated(text: Column, budget: int, path: str) -> Column:
    """The longest prefix of at most ``budget`` tokens."""
    return _column("string", path, lambda c, t: t[:c.fit(t, budget)])(text)
