"""Levenshtein automata walked along a trie of terms; plain helpers that run inside tasks."""

from __future__ import annotations

from collections.abc import Iterable

#: Matches of words kept in a task's memory.
CACHE_WORDS = 300_000


def edits_allowed(term: str, stem: bool) -> int:
    """Edits that still count as the term: none for short ones, which clean words resemble."""
    n = len(term)
    if stem:
        return 1 if n >= 8 else 0
    return 2 if n >= 9 else 1 if n >= 5 else 0


class Automaton:
    """All strings within `most` edits of a word; a state holds reachable (place, edits) pairs."""

    def __init__(self, word: str, most: int) -> None:
        self.word, self.most = word, most
        self._next: dict[tuple, frozenset] = {}

    def start(self) -> frozenset:
        return self._closed({(0, 0)})

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With skipped characters of the word added, and dominated pairs left out."""
        best: dict[int, int] = {}
        for at, edits in pairs:
            for skip in range(self.most - edits + 1):
                if at + skip <= len(self.word) and edits + skip < best.get(at + skip, self.most + 1):
                    best[at + skip] = edits + skip
        return frozenset(best.items())

    def step(self, state: frozenset, char: str) -> frozenset:
        key = (state, char)
        if key not in self._next:
            pairs = set()
            for at, edits in state:
                if at < len(self.word) and self.word[at] == char:
                    pairs.add((at + 1, edits))
                if edits < self.most:
                    pairs.add((at, edits + 1))
                    if at < len(self.word):
                        pairs.add((at + 1, edits + 1))
            self._next[key] = self._closed(pairs)
        return self._next[key]

    def distance(self, state: frozenset) -> int | None:
        """Edits if the word may end here."""
        return min((edits for at, edits in state if at == len(self.word)), default=None)

    def reached(self, state: frozenset) -> int | None:
        """Edits if the characters read are close to any beginning of the word."""
        return min((edits for _, edits in state), default=None)


class Trie:
    """Terms, each whole or a stem that any ending may follow."""

    def __init__(self, terms: Iterable[tuple[str, bool]]) -> None:
        self.root: dict = {}
        self.starts: set[str] = set()
        self.ends: set[str] = set()
        self.middles: set[str] = set()
        for term, stem in terms:
            node = self.root
            for char in term:
                node = node.setdefault(char, {})
            node["stem" if stem else "whole"] = term
            most = edits_allowed(term, stem)
            part = max(1, len(term) // (most + 1))
            self.starts.add(term[:part])
            if most:
                self.ends.add(term[-part:])
            if most == 2:
                self.middles.add(term[part : 2 * part])
            if stem and most:
                self.middles.add(term[part : 2 * part])
        self.lengths = [sorted({len(p) for p in own}) for own in (self.starts, self.ends, self.middles)]

    def worth(self, word: str) -> bool:
        """False only for words that match no term.

        Cut a term into one part more than the edits it allows: one part is untouched, the first
        at the start of the word, the last at its end, a middle one anywhere inside.
        """
        starts, ends, middles = self.lengths
        return (
            any(word[:n] in self.starts for n in starts)
            or any(word[-n:] in self.ends for n in ends)
            or any(m in word for m in self.middles)
        )

    def match(self, word: str) -> tuple[str, int] | None:
        """The closest term and its edits; of equally close ones the first by text."""
        found: list[tuple[int, str]] = []
        automata = {k: Automaton(word, k) for k in (0, 1, 2)}
        for most, automaton in automata.items():
            self._walk(self.root, automaton, automaton.start(), most, found)
            if found:
                distance, term = min(found)
                return term, distance
        return None

    def _walk(self, node: dict, automaton: Automaton, state: frozenset, most: int, found: list) -> None:
        whole, stem = node.get("whole"), node.get("stem")
        if whole is not None:
            distance = automaton.distance(state)
            if distance is not None and distance <= edits_allowed(whole, False):
                found.append((distance, whole))
        if stem is not None:
            distance = automaton.reached(state)
            if distance is not None and distance <= edits_allowed(stem, True):
                found.append((distance, stem))
        for char, child in node.items():
            if len(char) == 1:
                after = automaton.step(state, char)
                if after:
                    self._walk(child, automaton, after, most, found)


class Matches(dict):
    """Matched term of each word, kept for words seen lately."""

    def __init__(self, terms: Iterable[tuple[str, bool]]) -> None:
        self.trie = Trie(terms)

    def __missing__(self, word: str) -> tuple[str, int] | None:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = self.trie.match(word) if self.trie.worth(word) else None
        return value
