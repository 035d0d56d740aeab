"""Probabilistic automata inferred from samples by merging compatible prefix-tree states.

The prefix tree of the sample counts how often each state is passed and ended
in.  States are taken in breadth-first order; each is merged with the first
kept state of its own depth whose end and transition frequencies do not differ
by more than the Hoeffding bound allows, in all their successors, or else kept
itself.  Merging within a depth keeps the automaton acyclic, so it learns the
lengths of a format besides its characters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass
class _State:
    passed: int = 0
    ended: int = 0
    depth: int = 0
    next: dict[str, int] = field(default_factory=dict)
    taken: dict[str, int] = field(default_factory=dict)


@dataclass
class Automaton:
    """Per state: the log probability to end, and per symbol the next state and its log probability."""

    ends: list[float]
    moves: list[dict[str, tuple[int, float]]]
    floor: float                     # log probability of a symbol that the state has not seen

    def log_likelihood(self, symbols: str, least: float = -math.inf) -> float:
        """Log probability of the string; -inf as soon as it falls below ``least`` or leaves the automaton twice."""
        state, total, lost = 0, 0.0, 0
        for a in symbols:
            move = self.moves[state].get(a)
            if move is None:
                lost += 1
                total += self.floor
                if lost > 1:
                    return -math.inf
                continue
            state = move[0]
            total += move[1]
            if total < least:
                return -math.inf
        return total + self.ends[state]


def _tree(sample: list[str]) -> list[_State]:
    states = [_State()]
    for word in sample:
        s = 0
        states[0].passed += 1
        for a in word:
            if a not in states[s].next:
                states[s].next[a] = len(states)
                states[s].taken[a] = 0
                states.append(_State(depth=states[s].depth + 1))
            states[s].taken[a] += 1
            s = states[s].next[a]
            states[s].passed += 1
        states[s].ended += 1
    return states


def _differ(f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
    bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
    return abs(f1 / n1 - f2 / n2) > bound


def _compatible(states: list[_State], a: int, b: int, alpha: float) -> bool:
    todo = [(a, b)]
    while todo:
        x, y = (states[i] for i in todo.pop())
        if _differ(x.ended, x.passed, y.ended, y.passed, alpha):
            return False
        for sym in {*x.taken, *y.taken}:
            if _differ(x.taken.get(sym, 0), x.passed, y.taken.get(sym, 0), y.passed, alpha):
                return False
            if sym in x.next and sym in y.next and x.next[sym] != y.next[sym]:
                todo.append((x.next[sym], y.next[sym]))
    return True


def _merge(states: list[_State], keep: int, gone: int) -> set[int]:
    """Fold the subtree of ``gone`` into ``keep``; the states that took something in."""
    todo, touched = [(keep, gone)], set()
    while todo:
        k, g = todo.pop()
        touched.add(k)
        x, y = states[k], states[g]
        x.passed += y.passed
        x.ended += y.ended
        for sym, n in y.taken.items():
            x.taken[sym] = x.taken.get(sym, 0) + n
            if sym in x.next:
                todo.append((x.next[sym], y.next[sym]))
            else:
                x.next[sym] = y.next[sym]
    return touched


def infer(sample: list[str], sizes: dict[str, int], alpha: float = 0.05) -> Automaton:
    """Automaton for a sample of strings of symbols; ``sizes`` gives the characters a symbol stands for.

    Probabilities are spread evenly over a symbol's characters.
    """
    states = _tree(sorted(sample))
    kept: list[int] = [0]
    parent: dict[int, tuple[int, str]] = {}
    fresh: list[int] = []

    def offer(s: int) -> None:
        for sym in sorted(states[s].next):
            t = states[s].next[sym]
            if t not in kept_set and t not in parent:
                parent[t] = (s, sym)
                fresh.append(t)

    kept_set, level = {0}, {0: [0]}
    offer(0)
    while fresh:
        t = fresh.pop(0)
        s, sym = parent[t]
        if states[s].next.get(sym) != t:
            continue                    # folded away meanwhile
        match = next((k for k in level.get(states[t].depth, ()) if _compatible(states, k, t, alpha)), None)
        if match is None:
            kept.append(t)
            kept_set.add(t)
            level.setdefault(states[t].depth, []).append(t)
            offer(t)
        else:
            states[s].next[sym] = match
            touched = _merge(states, match, t)
            for k in sorted(touched & kept_set):   # folding may have hung new states below kept ones
                offer(k)
    number = {s: i for i, s in enumerate(kept)}
    ends, moves = [], []
    for s in kept:
        x = states[s]
        total = x.passed + 1
        ends.append(math.log((x.ended + 0.01) / total))
        moves.append({a: (number[x.next[a]], math.log(n / total / sizes.get(a, 1)))
                      for a, n in x.taken.items() if x.next[a] in number})
    return Automaton(ends, moves, math.log(1e-4))
