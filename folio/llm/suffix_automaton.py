"""A generalised suffix automaton over sequences of words, built once and read by many workers."""

from __future__ import annotations


class SuffixAutomaton:
    """All substrings of the given sequences.

    ``next[v]`` maps a word to the following state, ``link[v]`` is the suffix link and ``length[v]`` the longest
    substring of state v. State 0 is the empty string. Two states at most are added for each word.
    """

    def __init__(self, sequences: list[list[bytes]]) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[int]] = []  # the states of each sequence's prefixes
        for words in sequences:
            last, path = 0, []
            for w in words:
                last = self._extend(last, w)
                path.append(last)
            self.ends.append(path)

    def _state(self, length: int, link: int, out: dict[bytes, int]) -> int:
        self.next.append(out)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """A copy of q for the substrings that end p's way."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:  # an earlier sequence has this prefix
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def at_length(self, n: int) -> list[int]:
        """For each state, that of the suffix of n words of its strings; itself where these are shorter."""
        at = list(range(len(self.next)))
        for v in sorted(range(1, len(at)), key=self.length.__getitem__):
            if self.length[self.link[v]] >= n:
                at[v] = at[self.link[v]]
        return at

    def find(self, words: list[bytes]) -> int:
        v = 0
        for w in words:
            v = self.next[v][w]
        return v
