"""A suffix automaton over several word sequences, with occurrence counts."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


class SuffixAutomaton:
    """Of sequences added with a weight each; ``finish`` counts occurrences, then ``repeated`` gives matching statistics."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self.ranked: list[int] = []

    def _split(self, p: int, q: int, word: Hashable) -> int:
        """A state for the strings of q that end at p's length + 1."""
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.count.append(0)
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: Iterable[Hashable], weight: int = 1) -> None:
        nexts, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for word in words:
            q = nexts[last].get(word)
            if q is not None:  # known from another sequence
                last = q if length[q] == length[last] + 1 else self._split(last, q, word)
            else:
                state = len(nexts)
                nexts.append({})
                length.append(length[last] + 1)
                link.append(0)
                count.append(0)
                p = last
                while p >= 0 and word not in nexts[p]:
                    nexts[p][word] = state
                    p = link[p]
                if p >= 0:
                    q = nexts[p][word]
                    link[state] = q if length[q] == length[p] + 1 else self._split(p, q, word)
                last = state
            count[last] += weight

    def finish(self) -> None:
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for state in reversed(order):
            self.count[self.link[state]] += self.count[state]
        self.ranked = [0] * len(self.next)
        for state in order:
            self.ranked[state] = self.length[state] if self.count[state] >= 2 else self.ranked[self.link[state]]

    def repeated(self, words: Sequence[Hashable]) -> list[int]:
        """For each place in a sequence that was added, how many words ending there occur at least twice."""
        state, out = 0, []
        for i, word in enumerate(words, 1):
            state = self.next[state][word]
            out.append(min(i, self.ranked[state]))
        return out
