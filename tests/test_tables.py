"""Beams and decompositions kept in tables, against plain versions."""

import math
import random
from collections import defaultdict
from functools import cache

import pytest

from fsweave.operators import beams
from fsweave.operators.algebra import language
from fsweave.operators.ngram import EOS, ngram_counts
from fsweave.operators.precovers import Precovers
from fsweave.plans.machine import EPS, Machine
from fsweave.plans.precover import decompose_strings, next_symbols, preimage
from fsweave.sources import catalog

# Beams: two regions and silent tokens, under a trigram model of tokens

MOVES = [(s, t, t.lower(), "one") for s in ("one", "two") for t in ("a", "b", "ab", "ba", "A", "Ab", "abb")]
MOVES += [("one", "!", "", "two"), ("two", "?", "", "three"), ("two", ".", ".", "one"), ("three", ";", ";a", "one")]


def sequences(seed=4, n=120):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        xs = [rng.choice(["a", "b", "ab", "ba", "A", "Ab", "abb"]) for _ in range(rng.randint(0, 5))]
        if rng.random() < 0.4:
            xs += ["!", *rng.choice([["?"], ["?", ";"], [".", "a"], ["a"], []])]
        out.append(xs)
    return out


def tables_of(spark, n=3):
    seqs = spark.createDataFrame([(xs,) for xs in sequences()], "symbols array<string>")
    model = beams.context_model(ngram_counts(seqs, n, " "), n)
    moves = spark.createDataFrame(MOVES, "state string, token string, spelling string, next string")
    return beams.HubTables(moves, model, ["one"], ["one", "two", "three"])


class Plain:
    """The same model and machine in dictionaries, trained anew."""

    def __init__(self, n=3):
        counts = defaultdict(lambda: defaultdict(int))
        for xs in sequences():
            xs = [*xs, EOS]
            for k, x in enumerate(xs):
                for o in range(min(n - 1, k) + 1):
                    counts[tuple(xs[k - o : k])][x] += 1
        self.p = {c: {x: v / sum(row.values()) for x, v in row.items()} for c, row in counts.items()}
        self.n = n

    def after(self, ctx, token):
        return (*ctx, token)[-(self.n - 1) :]

    def tokens(self, state, ctx):
        return [(t, sp, nx, self.p[ctx][t]) for s, t, sp, nx in MOVES if s == state and t in self.p[ctx]]

    def starts(self, y):
        @cache
        def go(state, ctx, k):
            if k == len(y):
                return 1.0
            total = 0.0
            for t, sp, nx, p in self.tokens(state, ctx):
                if y.startswith(sp, k):
                    total += p * go(nx, self.after(ctx, t), k + len(sp))
                elif sp.startswith(y[k:]):
                    total += p
            return total

        return go("one", (), 0)

    def whole(self, y):
        @cache
        def go(state, ctx, k):
            total = self.p[ctx].get(EOS, 0.0) if k == len(y) else 0.0
            return total + sum(p * go(nx, self.after(ctx, t), k + len(sp)) for t, sp, nx, p in self.tokens(state, ctx) if y.startswith(sp, k))

        return go("one", (), 0)

    # a beam, step by step

    def mass(self, state, ctx, node):
        return sum(p for _, sp, _, p in self.tokens(state, ctx) if sp.startswith(node))

    def begun(self, beam):
        out, todo = dict(beam), list(beam.items())
        while todo:
            (state, ctx, node), w = todo.pop()
            for t, sp, nx, p in self.tokens(state, ctx):
                if sp == node:
                    h = (nx, self.after(ctx, t), "")
                    out[h] = out.get(h, 0.0) + w * p
                    todo.append((h, w * p))  # silent tokens may follow
        return out

    def beam(self, y, k, ratio):
        beam = self.begun({("one", (), ""): 1.0})
        for c in y:
            moved = {(s, ctx, node + c): w for (s, ctx, node), w in beam.items() if self.mass(s, ctx, node + c) > 0}
            share = {h: w * self.mass(*h) for h, w in moved.items()}
            best = sorted(share, key=lambda h: (-share[h], h[0], " ".join(h[1]), h[2]))[:k]
            kept = {h: moved[h] for h in best if share[h] * ratio >= max(share.values())}
            beam = self.begun(kept)
        return beam

    def nexts(self, beam):
        out = defaultdict(float)
        for (s, ctx, node), w in beam.items():
            for c in "ab.;":
                if m := self.mass(s, ctx, node + c):
                    out[c] += w * m
            if node == "":
                out[EOS] += w * self.p[ctx].get(EOS, 0.0)
        total = sum(out.values())
        return {c: v / total for c, v in out.items() if v}


TARGETS = ["", "abba", "ab", "aabba", "b.a", "a;ab", "abz", None, "ab"]


def test_beams_without_bounds_are_exact(spark):
    plain = Plain()
    found = beams.decode(spark.createDataFrame([(t,) for t in TARGETS], "x string"), "x", tables_of(spark))
    logprefix = {r.prefix: r.logp for r in found.logprefix().collect()}
    logprob = {r.prefix: r.logp for r in found.logprob().collect()}
    prefixes = {t[:k] for t in TARGETS if t is not None for k in range(len(t) + 1)}
    for y in prefixes:
        for got, want in ((logprefix.get(y), plain.starts(y)), (logprob.get(y), plain.whole(y))):
            assert (got is None and want == 0) or abs(math.exp(got) - want) < 1e-12
    nexts = defaultdict(dict)
    for r in found.next_symbols().collect():
        nexts[r.prefix][r.sym] = r.p
    for y in prefixes & set(logprefix):
        want = {c: plain.starts(y + c) for c in "ab.;"} | {EOS: plain.whole(y)}
        for c, p in want.items():
            assert abs(nexts[y].get(c, 0.0) - p / sum(want.values())) < 1e-9
    found.drop()


def test_sums_in_any_order_leave_one_row_for_each_prefix(spark, monkeypatch):
    plain, tables, ln = Plain(), tables_of(spark), beams.F.ln
    # as on several executors, where the last digits of a sum depend on the order in which its parts come in
    monkeypatch.setattr(beams.F, "ln", lambda c: ln(c) + (beams.F.rand() - 0.5) * 1e-13)
    found = beams.decode(spark.createDataFrame([(t,) for t in TARGETS], "x string"), "x", tables)
    assert found.rows.where("prefix = 'abba'").select("logz").distinct().count() > 1
    ended = [(r.prefix, r.logp) for r in found.logprob().collect()]
    assert len(ended) == len(dict(ended)) > 5
    assert all(abs(math.exp(p) - plain.whole(y)) < 1e-9 for y, p in ended)
    nexts = [(r.prefix, r.sym) for r in found.next_symbols().collect()]
    assert len(nexts) == len(set(nexts))
    begun = found.rows.where("node = ''")
    assert begun.count() == begun.select("prefix", "state", "ctx").distinct().count()
    found.drop()


@pytest.mark.parametrize("k, ratio", [(1, 1e9), (3, 1e9), (50, 3.3)])
def test_bounded_beams_equal_a_plain_beam(spark, k, ratio):
    plain = Plain()
    found = beams.decode(spark.createDataFrame([(t,) for t in TARGETS], "x string"), "x", tables_of(spark), k=k, ratio=ratio)
    got = defaultdict(dict)
    for r in found.next_symbols().collect():
        got[r.prefix][r.sym] = r.p
    for y in ["", "ab", "abba", "aabba", "b.a"]:
        want = plain.nexts(plain.beam(y, k, ratio)) if plain.beam(y, k, ratio) else {}
        assert got[y].keys() == want.keys() and all(abs(got[y][c] - want[c]) < 1e-9 for c in want)


def test_extension_bounds_and_odd_targets(spark):
    tables = tables_of(spark)
    ask = lambda xs, **bounds: beams.decode(spark.createDataFrame([(x,) for x in xs], "x string"), "x", tables, **bounds)
    assert [r.prefix for r in ask([None]).logprefix().collect()] == [""] == [r.prefix for r in ask([]).logprefix().collect()]
    full = {r.prefix: r.logp for r in ask(["abba"]).logprefix().collect()}
    some = {r.prefix: r.logp for r in ask(["abba"], most=1).logprefix().collect()}
    few = {r.prefix: r.logp for r in ask(["abba"], extend=0.4).logprefix().collect()}
    assert all(some[y] <= full[y] + 1e-12 and few[y] <= full[y] + 1e-12 for y in some) and some != full
    plan = beams.F.row_number().over(beams.Window.partitionBy("prefix").orderBy("w"))
    text = ask(["ab"]).rows.withColumn("rank", plan).where("rank <= 3")._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2  # within tasks, then for each prefix


def test_endless_silence_is_an_error(spark):
    model = spark.createDataFrame([("", "-", 1.0, "")], "ctx string, token string, p double, to string")
    moves = spark.createDataFrame([("q", "-", "", "q")], "state string, token string, spelling string, next string")
    with pytest.raises(RuntimeError):
        beams.HubTables(moves, model, ["q"], ["q"]).quietly(spark.createDataFrame([("", "q", "", 1.0)], "prefix string, next string, to string, p double"), ["prefix"], 5)


# Decompositions

MACHINES = {
    "newspeak": catalog.newspeak("abdu"),
    "delete": Machine.of([(0, "a", "A", 0), (0, "b", EPS, 0)], [0], [0]),
    "duplicate": Machine.of([(0, "a", "a", 1), (1, EPS, "a", 0), (0, "b", "b", 2), (2, EPS, "b", 0)], [0], [0]),
    "late": Machine.of([(0, "a", EPS, 1), (0, "a", EPS, 2), (1, "a", "a", 3), (2, "b", "b", 4), (3, "a", "a", 3), (4, "a", "b", 4), (4, "b", "b", 4)], [0], [3, 4]),
    "two ends": Machine.of([(0, "a", "x", 1), (0, "a", "y", 2), (1, "a", "x", 1), (2, "b", "x", 2)], [0], [1, 2]),
}


def targets_of(m, length):
    out, level = [()], [()]
    for _ in range(length):
        level = [(*y, s) for y in level for s in next_symbols(m, y)]
        out += level
    return out


@pytest.mark.parametrize("name", MACHINES)
def test_decompositions_equal_a_search_for_each_target(spark, name):
    m, longest = MACHINES[name], 5
    targets = targets_of(m, 2)
    made = Precovers(spark, m).decompose(spark.createDataFrame([("".join(y),) for y in targets] + [(None,)], "x string"), "x", longest)
    pairs = made.pairs().select("target", "source").collect()
    assert len(pairs) == len(set(pairs))  # no pair is worked out twice
    got, exact = defaultdict(set), defaultdict(set)
    for r in made.parts().collect():
        got[r.target, r.part].add(r.source)
    for r in made.exact(longest).collect():
        exact[r.target].add(r.source)
    for y in targets:
        q, r = decompose_strings(m, y, longest)
        text = "".join(y)
        assert got[text, "Q"] == {"".join(x) for x in q} and got[text, "R"] == {"".join(x) for x in r}
        assert exact[text] == {"".join(x) for x in language(preimage(m, y), longest)}


@pytest.mark.parametrize("name", ["newspeak", "duplicate", "late"])
def test_one_search_gives_all_next_symbols(spark, name):
    m, longest = MACHINES[name], 5
    targets = targets_of(m, 1)
    df = spark.createDataFrame([("".join(y),) for y in targets], "x string")
    got = defaultdict(set)
    for r in Precovers(spark, m).decompose(df, "x", longest).next_symbols(df, "x", longest).collect():
        got[r.target, r.sym, r.part].add(r.source)
    for y in targets:
        for s in m.writes - {EPS}:
            q, r = decompose_strings(m, (*y, s), longest)
            assert got["".join(y), s, "Q"] == {"".join(x) for x in q} and got["".join(y), s, "R"] == {"".join(x) for x in r}


def test_shared_starts_are_worked_out_once(spark):
    p = Precovers(spark, catalog.newspeak())
    run = lambda xs: p.decompose(spark.createDataFrame([(x,) for x in xs], "x string"), "x").pairs().count()
    assert run(["cab", "cabs", "ca"]) == run(["cabs"]) < run(["cab"]) + run(["cabs"]) and run([]) == run([""]) == 1
    assert run(["cabs", "dog"]) == run(["cabs"]) + run(["dog"]) - 1  # only the empty target is shared
