"""Automata whose states are found when they are asked for, and ways to combine them."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable

from fsweave.operators.algebra import closure
from fsweave.plans.machine import EPS, Machine


class Lazy:
    """An automaton given by its starts, ``arcs(state)`` as (label, target) rows, and ``final(state)``.

    Each combinator is again lazy: it keeps what it was made of and asks it for no more
    than is asked of itself.
    """

    def __init__(self, starts: Iterable, arcs: Callable[[object], Iterable[tuple]], final: Callable[[object], bool]):
        self.starts, self.arcs, self.final = frozenset(starts), arcs, final

    @staticmethod
    def of(m: Machine) -> Lazy:
        """A machine's input side."""
        return Lazy(m.starts, lambda q: [(a, j) for a, _, j in m.out(q)], m.finals.__contains__)

    def on(self, q, label) -> list:
        """Targets under one label."""
        return [j for a, j in self.arcs(q) if a == label]

    def cached(self) -> Lazy:
        """Each state's arcs and finality are asked for once."""
        arcs: dict = {}
        ends: dict = {}

        def once(memo, f):
            return lambda q: memo[q] if q in memo else memo.setdefault(q, f(q))

        return Lazy(self.starts, once(arcs, lambda q: list(self.arcs(q))), once(ends, self.final))

    def started_at(self, *states) -> Lazy:
        """The same automaton from other states."""
        return Lazy(states, self.arcs, self.final)

    def renumbered(self) -> Lazy:
        """States as 0, 1, 2 and so on, in the order in which they are met."""
        number: dict = {}
        names: list = []

        def to(q) -> int:
            if q not in number:
                number[q] = len(names)
                names.append(q)
            return number[q]

        return Lazy([to(q) for q in sorted(self.starts, key=repr)], lambda k: [(a, to(j)) for a, j in self.arcs(names[k])], lambda k: self.final(names[k]))

    def closed(self, states: Iterable) -> frozenset:
        """``states`` and what they reach without reading."""
        return frozenset(closure(states, lambda q: self.on(q, EPS)))

    def without_eps(self) -> Lazy:
        """The same language with a label on every arc."""

        def arcs(q):
            return list(dict.fromkeys((a, j) for s in self.closed([q]) for a, j in self.arcs(s) if a != EPS))

        return Lazy(self.starts, arcs, lambda q: any(map(self.final, self.closed([q]))))

    def determinized(self) -> Lazy:
        """Sets of states as states, one arc for each label; of the empty set none."""

        def arcs(subset):
            to: dict = {}
            for q in subset:
                for a, j in self.arcs(q):
                    if a != EPS:
                        to.setdefault(a, []).append(j)
            return [(a, self.closed(js)) for a, js in to.items()]

        start = self.closed(self.starts)
        return Lazy([start] if start else [], arcs, lambda subset: any(map(self.final, subset)))

    def after(self, xs: Iterable) -> frozenset:
        """The states after reading ``xs``."""
        here = self.closed(self.starts)
        for x in xs:
            here = self.closed(j for q in here for j in self.on(q, x))
            if not here:
                break
        return here

    def accepts(self, xs: Iterable) -> bool:
        return any(map(self.final, self.after(xs)))

    def universal_from(self, q, alphabet: Iterable) -> bool:
        """Whether every string over the alphabet is accepted from ``q``; searches no further than the first gap."""
        alphabet, d = frozenset(alphabet), self.started_at(q).determinized()
        seen, todo = set(d.starts), deque(d.starts)
        while todo:
            subset = todo.popleft()
            nexts = dict(d.arcs(subset))
            if not d.final(subset) or alphabet - nexts.keys():
                return False
            for a in alphabet:
                if nexts[a] not in seen:
                    seen.add(nexts[a])
                    todo.append(nexts[a])
        return True

    def materialized(self, most: int | None = None) -> Machine:
        """All states that are reached as a machine; an error if these are over ``most``."""
        found: list = []
        seen, todo = dict.fromkeys(self.starts), deque(self.starts)
        while todo:
            q = todo.popleft()
            for a, j in self.arcs(q):
                found.append((q, a, j))
                if j not in seen:
                    seen[j] = None
                    todo.append(j)
            if most is not None and len(seen) > most:
                raise RuntimeError(f"over {most} states")
        return Machine.acceptor(found, self.starts, [q for q in seen if self.final(q)])
