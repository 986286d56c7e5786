"""Machine algebra against bounded brute force, and golden decompositions."""

import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fsweave.operators import algebra as A
from fsweave.plans.machine import EPS, Machine, label_ranges
from fsweave.plans.precover import (
    Decomposition,
    LazyPrecover,
    Precover,
    best_first,
    check_decomposition,
    decompose_strings,
    finite_states,
    frontier,
    hub_vocabulary,
    next_symbols,
    preimage,
    regions,
    safe_states,
    safe_subsets,
    start_is_universal,
    strings_below,
    universal_states,
)
from fsweave.sources import catalog

SMALL = [n for n, f in catalog.CATALOG.items() if len(f().reads) < 8]


def texts(pairs):
    return {"".join(x) for x in pairs}


acceptors = st.builds(
    lambda arcs, starts, finals: Machine.acceptor([(i, "ab"[a] if a < 2 else EPS, j) for i, a, j in arcs], starts, finals, "ab"),
    st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.integers(0, 3)), max_size=9),
    st.sets(st.integers(0, 3), min_size=1, max_size=2),
    st.sets(st.integers(0, 3), min_size=1, max_size=2),
)
transducers = st.builds(
    lambda arcs, finals: Machine.of([(i, "ab"[a] if a < 2 else EPS, "xy"[b] if b < 2 else EPS, j) for i, a, b, j in arcs], [0], finals, "ab", "xy"),
    st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.integers(0, 2), st.integers(0, 2)), max_size=7),
    st.sets(st.integers(0, 2), min_size=1, max_size=2),
)


def members(m, n=4):
    return {x for k in range(n + 1) for x in itertools.product("ab", repeat=k) if A.accepts(m, x)}


@settings(max_examples=60, deadline=None)
@given(acceptors, acceptors)
def test_language_operations(a, b):
    everything = {x for k in range(5) for x in itertools.product("ab", repeat=k)}
    la, lb = members(a), members(b)
    assert set(A.language(a, 4)) == la
    assert members(A.union(a, b)) == la | lb
    assert members(A.intersection(a, b)) == la & lb
    assert members(A.difference(a, b)) == la - lb
    assert members(A.symmetric_difference(a, b)) == la ^ lb
    assert members(A.complement(a, "ab")) == everything - la
    assert members(A.concat(a, b)) == {x + y for x in la for y in lb if len(x + y) <= 4}
    assert members(a.reverse().reverse()) == la
    for same in (A.remove_eps(a), A.determinize(a), A.minimize(a), A.minimize_by_reversal(a), A.trim(a), A.add_sink(A.determinize(a), "ab")):
        assert members(same) == la
    assert len(A.minimize(a).states) <= len(A.trim(A.determinize(a)).states)
    assert A.equal(a, A.minimize(a)) and A.subset(A.intersection(a, b), a)
    assert A.is_universal(a, "ab") <= (la == everything)
    assert members(A.derivative(a, "a")) >= {x[1:] for x in la if x[:1] == ("a",)}


@settings(max_examples=40, deadline=None)
@given(acceptors)
def test_star_and_quotients(a):
    la = members(a)
    star = members(A.star(a))
    assert () in star and la <= star
    short = A.from_strings(["a", "ab"])
    left = {x[1:] for x in members(a, 6) if x[:1] == ("a",)} | {x[2:] for x in members(a, 6) if x[:2] == ("a", "b")}
    assert members(A.left_quotient(a, short)) == {x for x in left if len(x) <= 4}
    right = {x[:-1] for x in members(a, 6) if x[-1:] == ("a",)} | {x[:-2] for x in members(a, 6) if x[-2:] == ("a", "b")}
    assert members(A.right_quotient(a, short)) == {x for x in right if len(x) <= 4}


@settings(max_examples=40, deadline=None)
@given(transducers, transducers)
def test_composition(f, g):
    g = g.relabel(read=lambda c: {"a": "x", "b": "y"}[c])
    have = {p for p in A.relation(A.compose(f, g), 3)}
    mid = A.relation(f, 6)
    want = {(x, z) for x, y in mid for y2, z in A.relation(g, 6) if y == y2 and len(x) <= 3 and len(z) <= 3}
    assert want <= have


@settings(max_examples=60, deadline=None)
@given(transducers)
def test_push_labels_and_totals(f):
    assert A.relation(A.push_labels(f), 3) == A.relation(f, 3)
    total = A.make_total(f, "!")
    for x in strings_below(f, 3):
        inside = A.accepts(f.project(0), x)
        assert A.is_empty(A.cross_section(total, x, "!")) == inside


@settings(max_examples=60, deadline=None)
@given(transducers)
def test_functionality(f):
    witness = A.functional_witness(f)
    if witness:
        x, y, z = witness
        assert y != z and not A.is_empty(A.cross_section(f, x, y)) and not A.is_empty(A.cross_section(f, x, z))
    else:
        assert all(len(set(A.transduce(f, x, 12))) <= 1 for x in strings_below(f, 4))


@settings(max_examples=40, deadline=None)
@given(transducers, st.text("xy", max_size=2))
def test_decomposition_parts_the_precover(f, target):
    f = f.with_(writes="xy")
    if any(a == EPS for _, a, _, _ in f.arcs):  # outputs without bound are cut in the brute force
        f = Machine.of([x for x in f.arcs if x[1] != EPS], f.starts, f.finals, "ab", "xy")
    assert check_decomposition(f, target, 4)
    d = Decomposition(f, target)
    for x in strings_below(f, 4):
        assert (d.part_of(x) != "") == any(y[: len(target)] == tuple(target) for y in A.transduce(f, x, 12))
        lazy = LazyPrecover(f, target)
        k = lazy.run(x)
        assert (k is not None and lazy.is_final(k)) == (d.part_of(x) != "")


GOLDEN = [
    ("sdd1", "", {"a"}, set()),
    ("sdd1", "a", {"a"}, set()),
    ("sdd1", "aa", {"aa"}, set()),
    ("split_copy", "c", {"a"}, set()),
    ("anbn", "b", {"aaa"}, {"a"}),
    ("anbn", "c", set(), {"aa"}),
    ("anbn", "bb", {"aaa"}, set()),
    ("backticks", "b", {"a"}, set()),
    ("backticks", "`", {"`a"}, {"`"}),
    ("backticks", '"', {"``"}, set()),
    ("backticks", "`b", {"`a"}, set()),
    ("duplicate", "1", {"1"}, set()),
    ("duplicate", "115", {"15"}, set()),
]


@pytest.mark.parametrize("name,target,q,r", GOLDEN)
def test_golden_decompositions(name, target, q, r):
    m = catalog.CATALOG[name]()
    got = Decomposition(m, target).strings(5)
    assert (texts(got[0]), texts(got[1])) == (q, r)
    assert decompose_strings(m, target, 5) == got
    step = Decomposition(m)
    for y in target:
        step = step >> y
    assert step.strings(5) == got
    assert best_first(m, target, lambda x: -len(x), 500, beam=200)[0] == got[0]


@pytest.mark.parametrize("name", SMALL)
def test_catalog_machines(name):
    m = catalog.CATALOG[name]()
    assert A.is_functional(m) == (name not in ("split_copy", "torn_hub"))
    for target in [(), *((y,) for y in sorted(m.writes))]:
        assert check_decomposition(m, target, 4)
        rules = [Precover(m, target, rule) for rule in ("grow", "pop", "mark")]
        for x in strings_below(m, 3):
            ends = set()
            for p in rules:
                s = p.start
                for a in x:
                    s = p.step(s).get(a, frozenset())
                ends.add(p.final(s))
            assert len(ends) == 1
        nexts = {y for y in m.writes if any(Decomposition(m, (*target, y)).strings(6))}
        assert nexts <= next_symbols(m, target)
        assert set(Decomposition(m, target).next()) >= nexts
    assert set(regions(m)) == m.states
    assert finite_states(m) | universal_states(m) <= safe_states(m)
    seeds = [frozenset([q]) for q in m.states]
    assert {s for s in seeds if next(iter(s)) in safe_states(m)} <= safe_subsets(m, seeds) | {s for s in seeds if any(a == EPS for a, _, _ in m.out(next(iter(s))))}


def test_out_of_alphabet_targets_are_refused():
    with pytest.raises(ValueError):
        Decomposition(catalog.delete_b(), "z")
    assert Decomposition(catalog.delete_b(), "b").strings(4) == (set(), set())  # in the alphabet, but nothing writes it


def test_universality_and_hubs():
    assert start_is_universal(catalog.delete_b()) and not start_is_universal(catalog.no_hub())
    assert universal_states(catalog.gated()) == {"1"}
    assert hub_vocabulary(catalog.torn_hub(), "0") is None
    assert hub_vocabulary(catalog.token_trie([("t1", "ab"), ("t2", "a")]), ()) == {"t1": (("a", "b"), ()), "t2": (("a",), ())}
    assert texts(A.language(preimage(catalog.newspeak(), "ungood"), 6)) == {"bad", "ungood"}
    assert frontier(catalog.delete_b(), "A") == {0}


def test_cross_sections_and_pairs():
    m = A.from_pairs([("ab", "x"), ("b", "yy")])
    assert texts(A.language(A.cross_section(m, x="ab"), 3)) == {"x"}
    assert texts(A.language(A.cross_section(m, y="yy"), 3)) == {"b"}
    assert A.relation(A.cross_section(m, x="ab", y="yy"), 3) == set()
    assert texts(A.language(A.from_strings(["", "a", "ab"]), 3)) == {"", "a", "ab"}
    assert len(A.strong_components([1, 2, 3], {1: [2], 2: [1, 3], 3: []}.get)) == 2


def test_labels_and_pictures():
    assert label_ranges("abcdxz") == "a-dxz" and label_ranges("abcdefg", "abcdefgh") == "^h"
    assert '"a-d"' in catalog.letters((c, c) for c in "abcd").dot()


def test_unusual_labels():
    for a, b in ((1, 2), (b"x", b"y"), (("p", 1), ("p", 2))):
        m = A.union(A.from_string([a, b]), A.from_string([b]))
        assert A.accepts(m, [a, b]) and not A.accepts(m, [a])


def test_log_mass_closed_form():
    from fsweave.operators import ngram, scoring

    class Model:
        eos = ngram.EOS

        def logp(self, ctx, x):
            return math.log({"a": 0.6, "b": 0.3, ngram.EOS: 0.1}[x])

    got = scoring.OutputModel(catalog.delete_b(), Model(), expansions=3000).logp_next("A")
    assert abs(math.exp(got["A"]) - 6 / 7) < 1e-4 and abs(math.exp(got[ngram.EOS]) - 1 / 7) < 1e-4


@pytest.mark.parametrize("length", [80, 3000])
def test_late_endings_disprove_functionality(length):
    """Two branches write different first symbols and end many symbols later."""
    arcs = [("s", "a", y, (y, 0)) for y in "xy"] + [((y, k), "a", "-", (y, k + 1)) for y in "xy" for k in range(length)]
    m = Machine.of(arcs, ["s"], [("x", length), ("y", length)], "a", "xy-")
    x, y, z = A.functional_witness(m)
    assert len(x) == len(y) == len(z) == length + 1 and {y[0], z[0]} == {"x", "y"}
    assert not A.is_functional(m) and len(list(A.transduce(m, x))) == 2


@settings(max_examples=60, deadline=None)
@given(transducers, st.lists(st.integers(0, 5), max_size=4))
def test_longer_targets_equal_new_ones(f, picks):
    """A chain of extensions, and all next symbols, against decompositions from scratch."""
    if not f.writes:
        return
    d, letters = Decomposition(f), sorted(f.writes, key=repr)
    for k in picks:
        d = d >> letters[k % len(letters)]
        fresh = Decomposition(f, d.target)
        assert d.strings(4) == fresh.strings(4) and len(d.q_stops) == len(fresh.q_stops) and d.size == fresh.size
        for y, child in d.next().items():
            assert child.strings(3) == Decomposition(f, (*d.target, y)).strings(3)


def test_longer_targets_reuse_moves():
    m = catalog.newspeak()
    d = Decomposition(m)
    for k, y in enumerate("ungoodungoodungood"):
        d = d >> y
        if k > 3:
            assert d.made <= 8 and d.reused > k
    first, *others = (d >> y for y in "aeiu")
    assert first.reused > 0 and all(o.reused > 0 for o in others)


def test_lazy_automata():
    """Combinators against the machines they describe."""
    from fsweave.plans.lazy import Lazy

    m = Machine.acceptor([(0, "a", 0), (0, "b", 0), (0, "a", 1), (1, EPS, 2), (2, "b", 3), (3, EPS, 0)], [0], [3])
    lazy, asked = Lazy.of(m), []
    counted = Lazy(lazy.starts, lambda q: asked.append(q) or lazy.arcs(q), lazy.final).cached()
    forms = [lazy, counted, lazy.without_eps(), lazy.determinized(), lazy.determinized().renumbered(), counted.without_eps().determinized().renumbered().cached()]
    for x in itertools.chain.from_iterable(itertools.product("ab", repeat=n) for n in range(7)):
        assert {g.accepts(x) for g in forms} == {A.accepts(m, x)}
    assert len(asked) == len(set(asked))
    assert all(A.equal(g.materialized(), m) for g in forms)
    assert lazy.started_at(2).accepts("b") and not lazy.started_at(2).accepts("a")
    assert forms[4].starts == frozenset([0]) and forms[4].materialized().states <= frozenset(range(8))
    with pytest.raises(RuntimeError):
        Lazy([0], lambda q: [("a", q + 1)], lambda q: False).materialized(50)
    full = Lazy.of(A.universal("ab"))
    assert all(full.universal_from(q, "ab") for q in full.starts) and not lazy.universal_from(0, "ab") and not any(full.universal_from(q, "abc") for q in full.starts)
