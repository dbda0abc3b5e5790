"""Probabilistic automata inferred from example strings by merging compatible states of their prefix tree."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterable
from math import log, sqrt

#: Log-probability of a character that a state has never seen.
UNSEEN = log(1e-4)


class Automaton:
    """States with the counts of strings that end there and of the characters that leave them.

    Learning starts from the prefix tree. Its states are visited breadth first; each is merged into the first earlier state whose
    frequencies of ending and of every next character, there and along all common continuations, differ by no more than a Hoeffding
    bound at level ``alpha`` allows; a state that fits none stays.
    """

    def __init__(self, strings: Iterable[str], alpha: float = 0.01) -> None:
        self.ends, self.total, self.next = [0], [0], [{}]
        for s in strings:
            self._insert(s)
        self.bound = sqrt(0.5 * log(2 / alpha))
        self._merge_states()
        self.moves = [{c: (to, log(n / self.total[i])) for c, (to, n) in edges.items()} for i, edges in enumerate(self.next)]

    def _insert(self, string: str) -> None:
        at = 0
        for c in string:
            self.total[at] += 1
            edge = self.next[at].get(c)
            if edge is None:
                edge = self.next[at][c] = [len(self.next), 0]
                self.ends.append(0)
                self.total.append(0)
                self.next.append({})
            edge[1] += 1
            at = edge[0]
        self.total[at] += 1
        self.ends[at] += 1

    def _near(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) <= self.bound * (1 / sqrt(n) + 1 / sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            n, m = self.total[x], self.total[y]
            if not n or not m:
                continue
            if not self._near(self.ends[x], n, self.ends[y], m):
                return False
            for c in self.next[x].keys() | self.next[y].keys():
                p, q = self.next[x].get(c), self.next[y].get(c)
                if not self._near(p[1] if p else 0, n, q[1] if q else 0, m):
                    return False
                if p and q:
                    todo.append((p[0], q[0]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Adds the subtree's counts to a state and what follows it."""
        todo = [(into, tree)]
        while todo:
            x, y = todo.pop()
            self.ends[x] += self.ends[y]
            self.total[x] += self.total[y]
            for c, (child, n) in self.next[y].items():
                if (edge := self.next[x].get(c)) is None:
                    self.next[x][c] = [child, n]
                else:
                    edge[1] += n
                    todo.append((edge[0], child))

    def _merge_states(self) -> None:
        settled, border = [0], deque((0, c) for c in sorted(self.next[0]))
        done = {0}
        while border:
            parent, c = border.popleft()
            state = self.next[parent][c][0]
            if state in done:
                continue
            for old in settled:
                if self._compatible(old, state):
                    self.next[parent][c][0] = old
                    self._fold(old, state)
                    break
            else:
                settled.append(state)
                done.add(state)
            border.clear()
            border.extend((s, c) for s in settled for c in sorted(self.next[s]) if self.next[s][c][0] not in done)
        number = {s: i for i, s in enumerate(settled)}
        self.ends = [self.ends[s] for s in settled]
        self.total = [self.total[s] for s in settled]
        self.next = [{c: [number[t], n] for c, (t, n) in self.next[s].items()} for s in settled]

    def log_likelihood(self, string: str) -> float:
        """Log-probability of the string with its end; unseen characters cost UNSEEN and leave the state as it is."""
        at, score = self.walk(string)
        return score + (log(self.ends[at] / self.total[at]) if self.ends[at] else UNSEEN)

    def walk(self, string: str) -> tuple[int, float]:
        """The state after the string, and the log-probability of its characters."""
        at, score, moves = 0, 0.0, self.moves
        for c in string:
            move = moves[at].get(c)
            if move is None:
                score += UNSEEN
            else:
                at = move[0]
                score += move[1]
        return at, score


class Format:
    """An automaton for the characters of strings, and the distribution of their lengths, which merging would blur.

    Lengths that no example has share the weight of ``OTHER`` examples, n having 1 / (n * (n + 1)) of it.
    """

    OTHER = 0.5

    def __init__(self, strings: Iterable[str]) -> None:
        strings = list(strings)
        self.automaton = Automaton(strings)
        self.lengths = Counter(map(len, strings))
        self.n = len(strings)

    def log_likelihood(self, string: str) -> float:
        n = len(string)
        length = log((self.lengths.get(n) or self.OTHER / (n * (n + 1) or 1)) / (self.n + self.OTHER))
        return self.automaton.walk(string)[1] + length
