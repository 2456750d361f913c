"""Generalised suffix automaton over sequences of integers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class SuffixAutomaton:
    """Accepts every stretch of the sequences added. Each state stands for stretches with the same end positions; `length` is the
    longest of them, `link` the state of the longest suffix with more end positions. owners(state) are the sequences that hold it."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self._owners: list[set[int]] = [set()]

    def _new(self, length: int, link: int, to: dict[int, int]) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        self._owners.append(set())
        return len(self.next) - 1

    def _clone(self, p: int, q: int, symbol: int) -> int:
        c = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self._owners[c] = set(self._owners[q])
        self.link[q] = c
        while p != -1 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, symbol: int) -> int:
        q = self.next[last].get(symbol)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, symbol)
        cur = self._new(self.length[last] + 1, 0, {})
        p = last
        while p != -1 and symbol not in self.next[p]:
            self.next[p][symbol] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][symbol]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, symbol)
        return cur

    def add(self, sequence: Iterable[int], owner: int) -> int:
        """The state of the whole sequence."""
        last, ends = 0, []
        for symbol in sequence:
            last = self._extend(last, symbol)
            ends.append(last)
        for v in ends:  # every suffix of every prefix
            while v > 0 and owner not in self._owners[v]:
                self._owners[v].add(owner)
                v = self.link[v]
        return last

    def owners(self, state: int) -> set[int]:
        return self._owners[state]

    def matches(self, sequence: Iterable[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: for each position the state and length of the longest stretch that ends there and is held by a sequence."""
        nxt, link, length = self.next, self.link, self.length
        v = n = 0
        for symbol in sequence:
            to = nxt[v].get(symbol)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = nxt[v].get(symbol)
            if to is not None:
                v = to
                n += 1
            yield v, n

    def suffix_state(self, v: int, n: int) -> int:
        """The state of the last n symbols of a stretch of at least n symbols that ended in state v."""
        while self.length[self.link[v]] >= n:
            v = self.link[v]
        return v
