"""Small deterministic weighted finite-state transducers and their composition."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass


@dataclass
class Transducer:
    """``step[(state, symbol)]`` = (next state, output symbol, weight); state 0 starts, weights multiply."""

    step: dict[tuple[int, Hashable], tuple[int, Hashable, float]]

    @classmethod
    def of(cls, states: Iterable[int], symbols: Iterable[Hashable],
           rule: Callable[[int, Hashable], tuple[int, Hashable, float]]) -> Transducer:
        symbols = list(symbols)
        return cls({(s, a): rule(s, a) for s in states for a in symbols})

    def then(self, other: Transducer) -> Transducer:
        """The composition: the output of this one is the input of the other."""
        number = {(0, 0): 0}
        waiting, step = [(0, 0)], {}
        symbols = {a for _, a in self.step}
        while waiting:
            pair = waiting.pop()
            for a in symbols:
                p, mid, w = self.step[pair[0], a]
                q, out, v = other.step[pair[1], mid]
                if (p, q) not in number:
                    number[p, q] = len(number)
                    waiting.append((p, q))
                step[number[pair], a] = (number[p, q], out, w * v)
        return Transducer(step)

    def run(self, symbols: Iterable[Hashable]) -> list[tuple[Hashable, float]]:
        """Output symbol and weight at each input symbol."""
        state, out = 0, []
        for a in symbols:
            state, b, w = self.step[state, a]
            out.append((b, w))
        return out
