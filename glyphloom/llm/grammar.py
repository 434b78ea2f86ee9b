"""Inference of probabilistic automata from strings, by merging compatible states of a prefix tree.

The tree of the training strings' prefixes holds how often each state is passed, left by each symbol, and ended in.
States are visited in the order of their depth; one may be merged into an earlier one if, by Hoeffding's bound, neither
their frequencies of ending and of each symbol nor those of the states that follow differ; a merge folds the subtree. Of the
earlier states that it may be merged into, that is taken under which the strings that pass it are likeliest (of equal ones the
earliest): a state that few strings pass differs from none, and would else go to the first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Weight given to every symbol that a state has not seen.
SMOOTH = 0.01


@dataclass(frozen=True)
class Automaton:
    """States with the counts of what follows them."""

    #: Per state: symbol -> (next state, count).
    moves: tuple[dict[str, tuple[int, int]], ...]
    ends: tuple[int, ...]
    totals: tuple[int, ...]
    symbols: int

    def log_likelihood(self, text: str) -> float:
        """Natural logarithm of the probability of the whole string. An unseen symbol leaves the state as it is."""
        state, out = 0, 0.0
        for c in text:
            move = self.moves[state].get(c)
            whole = self.totals[state] + SMOOTH * (self.symbols + 1)
            out += math.log(((move[1] if move else 0) + SMOOTH) / whole)
            state = move[0] if move else state
        return out + math.log((self.ends[state] + SMOOTH) / (self.totals[state] + SMOOTH * (self.symbols + 1)))


def infer(strings: list[str], symbols: int, alpha: float = 0.05) -> Automaton:
    """The automaton of the strings, over an alphabet of so many symbols."""
    moves: list[dict[str, list[int]]] = [{}]
    #: ``ahead``: symbols and ends that the strings which pass a state have from there on.
    ends, totals, ahead = [0], [0], [0]
    for s in sorted(strings):
        state = 0
        totals[0] += 1
        ahead[0] += len(s) + 1
        for k, c in enumerate(s, 1):
            move = moves[state].setdefault(c, [len(moves), 0])
            if move[0] == len(moves):
                moves.append({})
                ends.append(0)
                totals.append(0)
                ahead.append(0)
            move[1] += 1
            state = move[0]
            totals[state] += 1
            ahead[state] += len(s) - k + 1
        ends[state] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if not totals[x] or not totals[y]:
                continue
            if differ(ends[x], totals[x], ends[y], totals[y]):
                return False
            for c in moves[x].keys() | moves[y].keys():
                p, q = moves[x].get(c), moves[y].get(c)
                if differ(p[1] if p else 0, totals[x], q[1] if q else 0, totals[y]):
                    return False
                if p and q:
                    todo.append((p[0], q[0]))
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            totals[x] += totals[y]
            ends[x] += ends[y]
            ahead[x] += ahead[y]
            for c, (nxt, n) in moves[y].items():
                if c in moves[x]:
                    moves[x][c][1] += n
                    todo.append((moves[x][c][0], nxt))
                else:
                    moves[x][c] = [nxt, n]

    def evidence(a: int, b: int) -> float:
        """Logarithm of the likelihood under ``a`` of what the strings do from ``b`` on; uniform where ``a`` knows no way on."""
        out, todo = 0.0, [(a, b)]
        while todo:
            x, y = todo.pop()
            whole = totals[x] + SMOOTH * (symbols + 1)
            out += ends[y] * math.log((ends[x] + SMOOTH) / whole)
            for c, (nxt, n) in moves[y].items():
                p = moves[x].get(c)
                out += n * math.log(((p[1] if p else 0) + SMOOTH) / whole)
                if p:
                    todo.append((p[0], nxt))
                else:
                    out += ahead[nxt] * uniform
        return out

    uniform = -math.log(symbols + 1)
    red = [0]
    blue = [(0, c) for c in sorted(moves[0])]
    while blue:
        parent, c = blue.pop(0)
        b = moves[parent][c][0]
        if b in red:
            continue
        able = [a for a in red if compatible(a, b)]
        if able:
            best = max(able, key=lambda a: evidence(a, b)) if len(able) > 1 else able[0]
            moves[parent][c][0] = best
            fold(best, b)
        else:
            red.append(b)
        known = set(red)
        blue = [(r, s) for r in red for s in sorted(moves[r]) if moves[r][s][0] not in known]
    place = {r: k for k, r in enumerate(red)}
    return Automaton(
        tuple({c: (place[n], k) for c, (n, k) in sorted(moves[r].items())} for r in red),
        tuple(ends[r] for r in red), tuple(totals[r] for r in red), symbols,
    )
