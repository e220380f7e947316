"""Byte-pair merges left to right: the last token of every prefix, by dynamic programming.

``last[i]`` is the last token of the encoding of the first ``i`` symbols.  A token ending at ``i`` is that
last token exactly if merging it next to ``last[i - len]`` leaves both whole, so each step looks back
no further than the longest token that the merges can make: that length is the lookahead that suffices.  The
chains of the newest ``lookahead`` prefixes hold every token boundary a continuation can still use, so what
they share is final and is emitted (:meth:`Merger.stream`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np

END = "</w>"
ENDED = 0xE000  # the symbol that ends a word stands this far up (private use), so that every symbol is one character
PAIRS_KEPT = 100_000
NEVER = -1.0  # rank of what no merge made: single symbols


class Kept:
    """Results kept by key: at most two generations of ``most``, so that what is used often stays."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Merger:
    """``rank(left, right)`` is the merge's priority (lower first) or None; ``tokens`` all token texts.

    Every symbol is one character.
    """

    def __init__(self, rank: Callable[[str, str], int | None], tokens: Iterable[str]):
        self.rank, self.tokens = rank, set(tokens)
        self.lookahead = max(map(len, self.tokens), default=1)
        self._beside = Kept(PAIRS_KEPT)
        self._made: dict[str, tuple[float, str, str] | None] = {}
        ends: dict[str, set[int]] = {}
        for t in self.tokens:
            if len(t) > 1:
                ends.setdefault(t[-3:], set()).add(len(t))
        #: lengths, longest first, of the tokens that end in these three characters (or are the last two of them)
        self.ends = {end: tuple(sorted(found | ends.get(end[1:], set()), reverse=True)) for end, found in ends.items()}

    def made(self, token: str) -> tuple[float, str, str] | None:
        """Rank and parts of the merge that makes the token from its symbols; None if they do not become one token."""
        try:
            return self._made[token]
        except KeyError:
            parts, made = list(token), (NEVER, "", "")
            while len(parts) > 1:
                ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.rank(parts[i], parts[i + 1])) is not None]
                if not ranked:
                    break
                r, i = min(ranked)
                made = r, parts[i], parts[i + 1]
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            self._made[token] = made if len(parts) == 1 else None
            return self._made[token]

    def beside(self, left: str, right: str) -> bool:
        """Whether both tokens stay whole when they meet (an empty left: whether the right one is whole).

        Their merges are undone, the latest first; at each moment the two parts at the seam must not merge before
        the next merge of their own takes one of them away.  Of equal ranks the leftmost merge comes first.
        """
        known = self._beside.get((left, right))
        if known is None:
            known = self._stay_whole(left, right)
            self._beside.put((left, right), known)
        return known

    def _stay_whole(self, left: str, right: str) -> bool:
        made, rank = self.made, self.rank
        if made(right) is None or not left:
            return made(right) is not None
        (of_left, _, inner_left), (of_right, inner_right, _) = made(left), made(right)
        before, or_equal = float("inf"), False
        while True:
            seam = rank(left, right)
            if seam is not None and (seam < before or (or_equal and seam == before)):
                return False
            if of_left > of_right:
                before, or_equal, left = of_left, False, inner_left
                of_left, _, inner_left = made(left)
            elif of_right > NEVER:
                before, or_equal, right = of_right, True, inner_right
                of_right, inner_right, _ = made(right)
            else:
                return True

    def last_tokens(self, symbols: list[str], last: list[str] | None = None) -> list[str]:
        """Last token of every non-empty prefix, from those of the first prefixes on (``last`` grows)."""
        whole = "".join(symbols)
        tokens, pairs, beside, ends = self.tokens, self._beside.young, self.beside, self.ends
        last = [] if last is None else last
        for i in range(len(last) + 1, len(whole) + 1):
            # lengths worth trying: of tokens with the same last three characters, or else two
            for n in ends.get(whole[max(0, i - 3):i]) or ends.get(whole[max(0, i - 2):i], ()):
                if n > i:
                    continue
                token = whole[i - n:i]
                if token in tokens:
                    left = last[i - n - 1] if n < i else ""
                    known = pairs.get((left, token))
                    if known or (known is None and beside(left, token)):
                        break
            else:
                token = whole[i - 1]
            last.append(token)
        return last

    def encode(self, symbols: Iterable[str]) -> list[str]:
        return list(self.stream(symbols))

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of a symbol stream as soon as they are final; holds a few lookaheads of symbols.

        Symbols are taken some lookaheads at a time.  Once the newest prefixes agree on a boundary, the tokens up to it
        are emitted and all but the lookahead before it is let go.
        """
        source = iter(symbols)
        held, last, done = list(islice(source, 6 * self.lookahead)), [], 0
        while True:
            more = list(islice(source, self.lookahead))
            self.last_tokens(held, last)
            if not more:
                yield from self._between(last, done, len(held))
                return
            meet = self._meet(last)
            if meet > done:
                yield from self._between(last, done, meet)
                drop = max(0, meet - self.lookahead)
                held, last, done = held[drop:], last[drop:], meet - drop
            held += more

    def _between(self, last: list[str], start: int, end: int) -> list[str]:
        out = []
        while end > start:
            out.append(last[end - 1])
            end -= len(last[end - 1])
        return out[::-1]

    def _meet(self, last: list[str]) -> int:
        """The boundary at which the token chains of the newest ``lookahead`` prefixes come together."""
        ends = set(range(len(last) - self.lookahead + 1, len(last) + 1))
        while len(ends) > 1:
            top = max(ends)
            ends.discard(top)
            ends.add(max(0, top - len(last[top - 1])))
        return ends.pop()


class SeamTable:
    """Which pairs of tokens stay whole side by side, as an open hash table that answers for many pairs at once."""

    def __init__(self, bits: int = 20):
        self.bits, self.mask = bits, (1 << bits) - 1
        self.clear()

    def clear(self) -> None:
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=bool)
        self.held = 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, known) of the keys."""
        values, known = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
        open_, at = np.arange(len(keys)), self._home(keys)
        while len(open_):
            there = self.keys[at]
            hit = there == keys[open_]
            values[open_[hit]], known[open_[hit]] = self.values[at[hit]], True
            on = ~hit & (there != -1)
            open_, at = open_[on], (at[on] + 1) & self.mask
        return values, known

    def put(self, keys: np.ndarray, values: list[bool]) -> None:
        """Keep new keys; a table that would be more than half full starts over."""
        if self.held + len(keys) > self.mask // 2:
            self.clear()
            keys = keys[:self.mask // 2]
        self.held += len(keys)
        for key, at, value in zip(keys.tolist(), self._home(keys).tolist(), values):
            while self.keys[at] != -1:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = key, value


class WordsInStep:
    """:class:`Merger`'s last tokens for many whole words at once: place by place, all words in step.

    Words are made of symbols that tokens hold.  A trie gives the tokens that start at every place; the words
    then advance together, and each takes the longest token that ends at its place and stays whole beside the
    last token before it.
    """

    def __init__(self, merger: Merger):
        self.merger = merger
        letters = sorted({c for t in merger.tokens for c in t})
        self.code = np.full(0x110000, -1, dtype=np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(len(letters))
        self.size, step = len(letters), {}
        self.texts = ["", *letters]  # node 0: nothing; then one node per letter, and one per further beginning of a token
        for token in sorted(merger.tokens):
            node = int(self.code[ord(token[0])]) + 1
            for i, c in enumerate(token[1:], 1):
                key = node * self.size + int(self.code[ord(c)])
                node = step.get(key)
                if node is None:
                    node = step[key] = len(self.texts)
                    self.texts.append(token[:i + 1])
        self.keys = np.array(sorted(step), dtype=np.int64)
        self.targets = np.array([step[k] for k in self.keys.tolist()], dtype=np.int64)
        self.is_token = np.array([t in merger.tokens for t in self.texts])
        self.seams = SeamTable()

    def _stay_whole(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * len(self.texts) + right
        values, known = self.seams.get(keys)
        if not known.all():
            fresh, back = np.unique(keys[~known], return_inverse=True)
            lefts, rights = np.divmod(fresh, len(self.texts))
            found = [self.merger.beside(self.texts[a], self.texts[b]) for a, b in zip(lefts.tolist(), rights.tolist())]
            self.seams.put(fresh, found)
            values[~known] = np.array(found)[back]
        return values

    def _tokens(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place, length, node) of every token of two letters and more; ``ends`` is each place's word end."""
        places, nodes, length = np.arange(len(codes)), codes + 1, 1
        out = []
        while len(self.keys):
            on = places + length < ends[places]
            places, nodes = places[on], nodes[on]
            if not len(places):
                break
            wanted = nodes * self.size + codes[places + length]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[at] == wanted
            places, nodes, length = places[hit], self.targets[at[hit]], length + 1
            whole = self.is_token[nodes]
            out.append((places[whole], np.full(int(whole.sum()), length), nodes[whole]))
        return tuple(np.concatenate(x) if out else np.zeros(0, dtype=np.int64) for x in (zip(*out) if out else ((), (), ())))

    def _last_tokens(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per place of all words together: node and length of the last token there; first and last place of each word."""
        word_end = np.cumsum(sizes)
        start = np.repeat(word_end - sizes, sizes)
        step = np.arange(len(codes)) - start + 1
        first, length, node = self._tokens(codes, np.repeat(word_end, sizes))
        end = first + length - 1
        order = np.lexsort((-length, end, step[end]))  # by step, then word, then the longest token first
        first, length, node, end = first[order], length[order], node[order], end[order]
        most = int(sizes.max(initial=0))
        bounds = np.searchsorted(step[end], np.arange(most + 2))
        last, taken = codes + 1, np.ones(len(codes), dtype=np.int64)
        for i in range(2, most + 1):
            low, high = bounds[i], bounds[i + 1]
            if low == high:
                continue
            heads = low + np.flatnonzero(np.r_[True, end[low + 1:high] != end[low:high - 1]])
            many = np.diff(np.r_[heads, high])
            nth = 0
            while len(heads):
                tried = heads + nth
                left = np.where(first[tried] > start[end[tried]], last[first[tried] - 1], 0)
                fits = self._stay_whole(left, node[tried])
                won = tried[fits]
                last[end[won]], taken[end[won]] = node[won], length[won]
                nth += 1
                on = ~fits & (many > nth)
                heads, many = heads[on], many[on]
        return last, taken, word_end - sizes, word_end - 1

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of all words' tokens, one word after the other, and how many each word has."""
        sizes = np.array(list(map(len, words)), dtype=np.int64)
        codes = self.code[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.int64)
        return self.encode_codes(codes, sizes)

    def encode_codes(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from the codes of all symbols and the number of symbols of each word."""
        last, taken, start, at = self._last_tokens(codes, sizes)
        counts = np.zeros(len(sizes), dtype=np.int64)
        found = []
        open_ = np.arange(len(sizes))
        while len(open_):
            found.append((open_, counts[open_].copy(), last[at[open_]]))
            counts[open_] += 1
            at[open_] -= taken[at[open_]]
            open_ = open_[at[open_] >= start[open_]]
        nodes = np.zeros(int(counts.sum()), dtype=np.int64)
        ends = np.cumsum(counts)
        for word, nth, node in found:  # nth from the word's end
            nodes[ends[word] - 1 - nth] = node
        return nodes, counts
