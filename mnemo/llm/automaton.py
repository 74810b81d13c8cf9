"""A generalised suffix automaton."""

from __future__ import annotations


class SuffixAutomaton:
    """Generalised suffix automaton of several sequences, built online."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.last = 0

    def start(self) -> None:
        """A new sequence begins."""
        self.last = 0

    def extend(self, c) -> int:
        """Appends a symbol to the current sequence; returns its state."""
        nxt, link, length = self.next, self.link, self.length
        p = self.last
        q = nxt[p].get(c)
        if q is not None:
            self.last = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            return self.last
        cur = len(nxt)
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        self.last = cur
        return cur

    def _clone(self, p: int, q: int, c) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def stream(self, symbols):
        """Matching statistics: (state, matched length) after each symbol."""
        nxt, link, length = self.next, self.link, self.length
        v = n = 0
        for c in symbols:
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
            yield v, n
