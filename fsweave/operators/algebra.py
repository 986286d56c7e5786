"""Algebra of machines: closures, products, set operations, determinization, minimization."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

from fsweave.plans.machine import EPS, Machine

#: The write of a left machine that moves alone, inside composition only.
LEFT_ONLY = ("eps", 1)


def closure(seeds: Iterable, step: Callable[[object], Iterable]) -> dict:
    """Everything reachable from ``seeds``, as an ordered set (a dict of None)."""
    seen = dict.fromkeys(seeds)
    todo = deque(seen)
    while todo:
        for t in step(todo.popleft()):
            if t not in seen:
                seen[t] = None
                todo.append(t)
    return seen


def explore(starts: Iterable, arcs: Callable[[object], Iterable[tuple]], final: Callable[[object], bool], reads=(), writes=()) -> Machine:
    """The machine of a lazy description: arcs(state) gives (read, write, target)."""
    starts = list(starts)
    found: list = []

    def step(q):
        rows = [(q, a, b, j) for a, b, j in arcs(q)]
        found.extend(rows)
        return [r[3] for r in rows]

    states = closure(starts, step)
    return Machine.of(found, starts, (q for q in states if final(q)), reads, writes)


# Structure


def reachable(m: Machine) -> frozenset:
    return frozenset(closure(m.starts, lambda q: [j for _, _, j in m.out(q)]))


def coreachable(m: Machine) -> frozenset:
    return reachable(m.reverse())


def trim(m: Machine) -> Machine:
    """States on a path from a start to a final state."""
    return m.keeping(reachable(m) & coreachable(m))


def strong_components(nodes: Iterable, succ: Callable[[object], Iterable]) -> list[list]:
    """Strongly connected components, by two depth-first passes without recursion."""
    nodes = list(nodes)
    done, order = set(), []
    back: dict = defaultdict(list)
    for root in nodes:
        stack = [(root, False)]
        while stack:
            q, leaving = stack.pop()
            if leaving:
                order.append(q)
            elif q not in done:
                done.add(q)
                stack.append((q, True))
                for t in succ(q):
                    back[t].append(q)
                    stack.append((t, False))
    out, placed = [], set()
    for root in reversed(order):
        if root not in placed:
            group = list(closure([root], lambda q: [t for t in back[q] if t not in placed]))
            placed.update(group)
            out.append(group)
    return out


def cyclic(nodes: Iterable, succ: Callable[[object], Iterable]) -> set:
    """Nodes on a cycle."""
    return {q for c in strong_components(nodes, succ) if len(c) > 1 or c[0] in set(succ(c[0])) for q in c}


# Acceptors


def from_string(xs: Iterable) -> Machine:
    xs = list(xs)
    return Machine.acceptor(((i, x, i + 1) for i, x in enumerate(xs)), [0], [len(xs)])


def from_strings(strings: Iterable[Iterable]) -> Machine:
    """A trie whose states are prefixes."""
    strings = [tuple(s) for s in strings]
    return Machine.acceptor(((s[:k], s[k], s[: k + 1]) for s in strings for k in range(len(s))), [()], strings)


def from_pairs(pairs: Iterable[tuple[Iterable, Iterable]]) -> Machine:
    """The finite relation of the pairs; the shorter side is padded with nothing."""
    arcs, starts, finals = [], [], []
    for n, (x, y) in enumerate(pairs):
        x, y = list(x), list(y)
        size = max(len(x), len(y))
        pad = lambda s, k: s[k] if k < len(s) else EPS
        arcs += [((n, k), pad(x, k), pad(y, k), (n, k + 1)) for k in range(size)]
        starts.append((n, 0))
        finals.append((n, size))
    return Machine.of(arcs, starts, finals)


def lift(x) -> Machine:
    return from_string([x])


def universal(alphabet: Iterable) -> Machine:
    alphabet = list(alphabet)
    return Machine.acceptor(((0, a, 0) for a in alphabet), [0], [0], alphabet)


def one() -> Machine:
    return Machine.of([], [0], [0])


def zero() -> Machine:
    return Machine.of([], [], [])


def eps_closure(m: Machine, states: Iterable) -> frozenset:
    """States reachable without reading."""
    return frozenset(closure(states, lambda q: [j for _, j in m.on(q, EPS)]))


def remove_eps(m: Machine) -> Machine:
    """An acceptor of the same language without arcs that read nothing."""
    arcs, finals = [], []
    for q in m.states:
        near = eps_closure(m, [q])
        arcs += [(q, a, j) for s in near for a, _, j in m.out(s) if a != EPS]
        if near & m.finals:
            finals.append(q)
    return Machine.acceptor(arcs, m.starts, finals, m.reads)


def determinize(m: Machine) -> Machine:
    """Subset construction over what is read; states are frozensets."""

    def arcs(subset):
        to: dict = defaultdict(set)
        for q in subset:
            for a, _, j in m.out(q):
                if a != EPS:
                    to[a].add(j)
        return [(a, a, eps_closure(m, js)) for a, js in to.items()]

    start = eps_closure(m, m.starts)
    return explore([start] if start else [], arcs, lambda s: bool(s & m.finals), m.reads, m.reads)


def minimize(m: Machine) -> Machine:
    """The smallest deterministic acceptor, by refining classes of states until they are stable."""
    d = trim(determinize(m))
    kind = {q: q in d.finals for q in d.states}
    count = len(set(kind.values()))
    while True:
        sign = {q: (kind[q], tuple(sorted(((a, kind[j]) for a, _, j in d.out(q)), key=repr))) for q in d.states}
        names = {s: n for n, s in enumerate(sorted(set(sign.values()), key=repr))}
        kind = {q: names[sign[q]] for q in d.states}
        if len(names) == count:
            return d.rename(kind.__getitem__)
        count = len(names)


def minimize_by_reversal(m: Machine) -> Machine:
    """The same machine, by determinizing the reversal twice."""
    return determinize(determinize(m.reverse()).reverse())


def add_sink(m: Machine, alphabet: Iterable) -> Machine:
    """Complete a deterministic acceptor: what is missing leads to a dead state."""
    alphabet = frozenset(alphabet) | m.reads
    sink = "sink"
    missing = [(q, a, a, sink) for q in {*m.states, sink} for a in alphabet if q == sink or not m.on(q, a)]
    return m.with_(missing, starts=[] if m.starts else [sink], reads=alphabet, writes=alphabet)


def complement(m: Machine, alphabet: Iterable) -> Machine:
    full = add_sink(determinize(m), alphabet)
    return Machine.of(full.arcs, full.starts, full.states - full.finals, full.reads, full.writes)


def _apart(a: Machine, b: Machine) -> tuple[Machine, Machine]:
    return a.rename(lambda q: (0, q)), b.rename(lambda q: (1, q))


def union(a: Machine, b: Machine) -> Machine:
    a, b = _apart(a, b)
    return a.with_(b.arcs, b.starts, b.finals, b.reads, b.writes)


def concat(a: Machine, b: Machine) -> Machine:
    a, b = _apart(a, b)
    bridge = [(f, EPS, EPS, s) for f in a.finals for s in b.starts]
    return Machine.of(a.arcs | b.arcs | set(bridge), a.starts, b.finals, a.reads | b.reads, a.writes | b.writes)


def plus(m: Machine) -> Machine:
    return m.with_((f, EPS, EPS, s) for f in m.finals for s in m.starts)


def star(m: Machine) -> Machine:
    return union(one(), plus(m))


def intersection(a: Machine, b: Machine) -> Machine:
    a, b = remove_eps(a), remove_eps(b)

    def arcs(pair):
        p, q = pair
        return [(x, x, (i, j)) for x, _, i in a.out(p) for _, j in b.on(q, x)]

    return explore(((p, q) for p in a.starts for q in b.starts), arcs, lambda s: s[0] in a.finals and s[1] in b.finals, a.reads | b.reads, a.reads | b.reads)


def difference(a: Machine, b: Machine) -> Machine:
    return intersection(a, complement(b, a.reads | b.reads))


def symmetric_difference(a: Machine, b: Machine) -> Machine:
    return union(difference(a, b), difference(b, a))


def derivative(m: Machine, x: Iterable) -> Machine:
    """What may follow ``x`` in the language."""
    now = eps_closure(m, m.starts)
    for a in x:
        now = eps_closure(m, [j for q in now for _, j in m.on(q, a)])
    return Machine.of(m.arcs, now, m.finals, m.reads, m.writes)


def left_quotient(a: Machine, b: Machine) -> Machine:
    """{y : some x of b makes xy a member of a}."""
    both = intersection(a, b)
    reach = {p for p, q in reachable(both) if q in remove_eps(b).finals}
    plain = remove_eps(a)
    return Machine.of(plain.arcs, reach, plain.finals, a.reads | b.reads, a.reads | b.reads)


def right_quotient(a: Machine, b: Machine) -> Machine:
    return left_quotient(a.reverse(), b.reverse()).reverse()


def is_empty(m: Machine) -> bool:
    return not (reachable(m) & m.finals)


def subset(a: Machine, b: Machine) -> bool:
    return is_empty(difference(a, b))


def equal(a: Machine, b: Machine) -> bool:
    return subset(a, b) and subset(b, a)


def accepts(m: Machine, x: Iterable) -> bool:
    return bool(derivative(m, x).starts & m.finals)


def language(m: Machine, longest: int) -> Iterator[tuple]:
    """Members up to a length, shorter ones first; each once."""
    d = determinize(m)
    level = [((), s) for s in d.starts]
    for n in range(longest + 1):
        yield from (x for x, s in level if s in d.finals)
        level = [((*x, a), j) for x, s in level for a, _, j in d.out(s)] if n < longest else []


def is_universal(m: Machine, alphabet: Iterable) -> bool:
    """Whether every string over the alphabet is a member."""
    return is_empty(complement(m, alphabet))


# Transducers


def compose(f: Machine, g: Machine) -> Machine:
    """x becomes z if f makes y of x and g makes z of y.

    An equi-join of f's writes with g's reads over pairs of states.  A third component
    orders moves of one machine alone (left before right), so that each way of lining
    them up is counted once.
    """
    left: dict = defaultdict(list)
    for i, a, b, j in f.arcs:
        left[i].append((a, LEFT_ONLY if b == EPS else b, j))

    def arcs(state):
        p, q, turn = state
        out = []
        for a, b, j in left[p]:
            if b == LEFT_ONLY:
                if turn == 0:
                    out.append((a, EPS, (j, q, 0)))
            else:
                out += [(a, c, (j, k, 0)) for c, k in g.on(q, b)]
        out += [(EPS, c, (p, k, 1)) for c, k in g.on(q, EPS)]
        return out

    return explore(((p, q, 0) for p in f.starts for q in g.starts), arcs, lambda s: s[0] in f.finals and s[1] in g.finals, f.reads, g.writes)


def cross_section(m: Machine, x: Iterable | None = None, y: Iterable | None = None) -> Machine:
    """The relation with one side or both fixed; an acceptor of the free side if one is."""
    out = m
    if x is not None:
        out = compose(from_string(x), out)
    if y is not None:
        out = compose(out, from_string(y))
    return out if (x is None) == (y is None) else out.project(1 if x is not None else 0)


@lru_cache(256)
def endless_states(m: Machine) -> frozenset:
    """States on a cycle that reads nothing and writes something."""
    silent = lambda q: [j for _, j in m.on(q, EPS)]
    at = {q: k for k, part in enumerate(strong_components(m.states, silent)) for q in part}
    rings = {at[i] for i, a, b, j in m.arcs if a == EPS and b != EPS and at[i] == at[j]}
    return frozenset(q for q in m.states if at[q] in rings)


def transduce(m: Machine, x: Iterable, longest: int | None = None) -> Iterator[tuple]:
    """All outputs of one input, each once; with ``longest``, outputs over so many symbols are not followed.

    Without it an input that has endlessly many outputs is an error.  Outputs are nodes
    of a trie (parent, symbol), so that a step costs the same however long they are.
    """
    x = tuple(x)
    live = None
    if longest is None and (rings := endless_states(m)):  # else every search ends by itself
        live = _live(m, x)
        if not all(map(rings.isdisjoint, live)):
            raise ValueError("this input has endlessly many outputs")
        if not live:
            return
    nodes: list = [(0, None, 0)]
    number: dict = {}

    def wrote(y: int, b) -> int:
        if b == EPS:
            return y
        k = number.setdefault((y, b), len(nodes))
        if k == len(nodes):
            nodes.append((y, b, nodes[y][2] + 1))
        return k

    def step(s):
        q, n, y = s
        if longest is not None and nodes[y][2] > longest:
            return []
        out = [(j, n, wrote(y, b)) for b, j in m.on(q, EPS) if live is None or j in live[n]]
        if n < len(x):
            out += [(j, n + 1, wrote(y, b)) for b, j in m.on(q, x[n]) if live is None or j in live[n + 1]]
        return out

    def spelled(y: int) -> tuple:
        out = []
        while y:
            y, b, _ = nodes[y]
            out.append(b)
        return tuple(reversed(out))

    found = set()
    for q, n, y in closure(((q, 0, 0) for q in m.starts if live is None or q in live[0]), step):
        if n == len(x) and q in m.finals and y not in found:
            found.add(y)
            yield spelled(y)


def _live(m: Machine, x: tuple) -> list[set]:
    """The states at each place of ``x`` that are on a path through all of it; empty if there is no path."""
    silent = lambda q: [j for _, j in m.on(q, EPS)]
    ahead = [closure(m.starts, silent)]
    for a in x:
        ahead.append(closure((j for q in ahead[-1] for _, j in m.on(q, a)), silent))
        if not ahead[-1]:
            return []
    live: list[set] = []
    good = {q for q in ahead[-1] if q in m.finals}
    for n in range(len(x), -1, -1):
        if n < len(x):
            good = {q for q in ahead[n] if any(j in good for _, j in m.on(q, x[n]))}
        back: dict = defaultdict(list)
        for q in ahead[n]:
            for j in silent(q):
                back[j].append(q)
        good = set(closure(good, lambda q: back.get(q, ())))
        if not good:
            return []
        live.append(good)
    return live[::-1]


def relation(m: Machine, longest: int) -> set[tuple[tuple, tuple]]:
    """Pairs (x, y) with both sides up to a length."""
    def step(s):
        q, x, y = s
        nexts = [(j, (*x, a) if a != EPS else x, (*y, b) if b != EPS else y) for a, b, j in m.out(q)]
        return [t for t in nexts if len(t[1]) <= longest and len(t[2]) <= longest]

    return {(x, y) for q, x, y in closure(((q, (), ()) for q in m.starts), step) if q in m.finals}


def _cancel(u: tuple, v: tuple) -> tuple[tuple, tuple] | None:
    """What is left of two outputs after their common prefix; None if they disagree."""
    k = 0
    while k < min(len(u), len(v)):
        if u[k] != v[k]:
            return None
        k += 1
    return u[k:], v[k:]


def _pair_moves(t: Machine, pair: tuple) -> Iterator[tuple]:
    """Moves of two copies over a common input: (pair, read, write of one, write of the other)."""
    p, q = pair
    yield from (((j, q), EPS, b, EPS) for b, j in t.on(p, EPS))
    yield from (((p, k), EPS, EPS, c) for c, k in t.on(q, EPS))
    yield from (((j, k), a, b, c) for a, b, j in t.out(p) if a != EPS for c, k in t.on(q, a))


def _spelled(trail: list, k: int) -> tuple[tuple, tuple, tuple]:
    """Input and both outputs along a trail of (parent, read, write, write)."""
    steps = []
    while k:
        k, *labels = trail[k]
        steps.append(labels)
    return tuple(tuple(s[i] for s in reversed(steps) if s[i] != EPS) for i in range(3))


def _ending(t: Machine, pair: tuple) -> tuple[tuple, tuple, tuple]:
    """A shortest common input after which both copies of a live pair end, with both outputs."""
    trail: list = [()]
    seen, todo = {pair}, deque([(pair, 0)])
    while todo:
        pair, k = todo.popleft()
        if pair[0] in t.finals and pair[1] in t.finals:
            return _spelled(trail, k)
        for nxt, *labels in _pair_moves(t, pair):
            if nxt not in seen:
                seen.add(nxt)
                todo.append((nxt, len(trail)))
                trail.append((k, *labels))
    raise ValueError("the pair has no common ending")


def functional_witness(m: Machine) -> tuple[tuple, tuple, tuple] | None:
    """(x, y, z) with y and z different outputs of x, or None if the machine is a function.

    Runs two copies side by side over the same input and tracks by how much one output
    is ahead.  Only pairs of states with a common ending are followed, so outputs that
    disagree make a witness with any ending.  Two ways into a pair with different delays
    cannot both end well either: the ending makes equal outputs of one of them at most.
    Each pair is followed once, so the search ends; no length is limited.
    """
    t = trim(m)
    live = coreachable_pairs(t)
    delay: dict = {}
    trail: list = [()]
    todo = deque(((p, q), ((), ()), 0) for p in t.starts for q in t.starts if (p, q) in live)
    while todo:
        pair, gap, k = todo.popleft()
        if pair in delay and delay[pair][0] == gap:
            continue
        if gap is None or pair in delay:
            end = _ending(t, pair)
            for way in (k, delay.get(pair, (None, k))[1]):
                x, y, z = (u + v for u, v in zip(_spelled(trail, way), end))
                if y != z:
                    return x, y, z
        delay[pair] = gap, k
        if pair[0] in t.finals and pair[1] in t.finals and gap != ((), ()):
            return _spelled(trail, k)
        for nxt, a, b, c in _pair_moves(t, pair):
            if nxt in live:
                todo.append((nxt, _cancel(gap[0] + ((b,) if b != EPS else ()), gap[1] + ((c,) if c != EPS else ())), len(trail)))
                trail.append((k, a, b, c))
    return None


def coreachable_pairs(t: Machine) -> set:
    """Pairs of states from which both can end on a common input."""
    into: dict = defaultdict(lambda: defaultdict(list))
    for i, a, _, j in t.arcs:
        into[j][a].append(i)

    def back(pair):
        p, q = pair
        lone = [(i, q) for i in into[p][EPS]] + [(p, k) for k in into[q][EPS]]
        return lone + [(i, k) for a in into[p] if a != EPS for i in into[p][a] for k in into[q].get(a, [])]

    return set(closure(((p, q) for p in t.finals for q in t.finals), back))


def is_functional(m: Machine) -> bool:
    return functional_witness(m) is None


def make_total(m: Machine, marker) -> Machine:
    """Inputs outside the domain give ``marker``."""
    if marker in m.writes:
        raise ValueError(f"{marker!r} is an output already")
    outside = complement(m.project(0), m.reads).rename(lambda q: ("outside", q))
    silent = [(i, a, EPS, j) for i, a, _, j in outside.arcs]
    ends = [(f, EPS, marker, ("outside", "end")) for f in outside.finals]
    return m.with_([*silent, *ends], outside.starts, [("outside", "end")])


def push_labels(m: Machine) -> Machine:
    """The same relation with every output symbol written as early as possible.

    The delay of a state is the longest common prefix of all outputs from there on; it
    only shrinks, from each state's first estimate, until it is consistent.  An arc then
    writes what its old label and its target's delay have beyond its source's delay,
    as a chain of arcs if that is several symbols; starts write their own delay first.
    """
    t = trim(m)
    delay: dict = {q: () for q in t.finals}
    into: dict = defaultdict(set)
    for i, _, _, j in t.arcs:
        into[j].add(i)

    def common(parts):
        first, *rest = parts
        for r in rest:
            k = 0
            while k < min(len(first), len(r)) and first[k] == r[k]:
                k += 1
            first = first[:k]
        return first

    todo = deque(t.finals)
    while todo:
        for q in into[todo.popleft()]:
            parts = [((b,) if b != EPS else ()) + delay[j] for _, b, j in t.out(q) if j in delay]
            value = common([*parts, ()] if q in t.finals else parts)
            if delay.get(q) != value:
                delay[q] = value
                todo.append(q)
    arcs: list = []

    def chain(i, a, symbols, j, name):
        stops = [i, *((name, k) for k in range(1, max(1, len(symbols)))), j]
        for k in range(max(1, len(symbols))):
            arcs.append((stops[k], a if k == 0 else EPS, symbols[k] if symbols else EPS, stops[k + 1]))

    for n, (i, a, b, j) in enumerate(sorted(t.arcs, key=repr)):
        chain(("q", i), a, (((b,) if b != EPS else ()) + delay[j])[len(delay[i]) :], ("q", j), ("arc", n))
    for n, s in enumerate(sorted(t.starts, key=repr)):
        chain(("start", n), EPS, delay[s], ("q", s), ("lead", n))
    return Machine.of(arcs, [("start", n) for n in range(len(t.starts))], [("q", f) for f in t.finals], m.reads, m.writes)
