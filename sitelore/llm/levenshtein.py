"""Levenshtein automata intersected with a lexicon trie.

The product of the trie with the automata of its words is determinised lazily:
a state is the set of (trie node, errors) pairs that a prefix can stand for, and
each step from a state by a letter is worked out once.  A word then costs one
look-up a letter and dies, mostly, within a few letters.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Term:
    """``stem``: matches all words that begin with it, exactly; else whole words within ``errors`` edits."""

    text: str
    errors: int = 0
    stem: bool = False


class LexiconAutomaton:
    def __init__(self, terms: list[Term]) -> None:
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.slack = [0]  # most errors that a term below the node allows
        for number, term in enumerate(terms):
            node = 0
            self.slack[0] = max(self.slack[0], term.errors)
            for letter in term.text:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.slack.append(0)
                node = self.children[node][letter]
                self.slack[node] = max(self.slack[node], term.errors)
            self.ends[node].append(number)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.stems: list[tuple[int, int] | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """The state of these pairs and of those a letter missing from the word leads to; -1 if there are none."""
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e < self.slack[child] and (child, e + 1) not in pairs:
                    pairs.add((child, e + 1))
                    todo.append((child, e + 1))
        least: dict[int, int] = {}
        for node, e in pairs:
            least[node] = min(e, least.get(node, e))
        own = frozenset(least.items())
        if not own:
            return -1
        if own not in self.states:
            self.states[own] = len(self.sets)
            self.sets.append(own)
            self.steps.append({})
            words = [(e, t) for node, e in own for t in self.ends[node] if not self.terms[t].stem and e <= self.terms[t].errors]
            stems = [(e, t) for node, e in own for t in self.ends[node] if self.terms[t].stem and e == 0]
            self.accepts.append(min(words, default=None))
            self.stems.append(min(stems, default=None))
        return self.states[own]

    def _step(self, state: int, letter: str) -> int:
        after: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            if e < self.slack[node]:
                after.add((node, e + 1))  # a letter too many
            for own, child in self.children[node].items():
                if own == letter:
                    after.add((child, e))
                elif e < self.slack[child]:
                    after.add((child, e + 1))  # another letter
        return self._state(after)

    def match(self, word: str) -> tuple[int, int] | None:
        """(errors, term number) of the closest term, whole words before stems; None if no term matches."""
        state, stem = self.start, None
        for letter in word:
            found = self.steps[state].get(letter)
            if found is None:
                found = self.steps[state][letter] = self._step(state, letter)
            state = found
            if state < 0:
                return stem
            stem = stem or self.stems[state]
        return self.accepts[state] or stem
