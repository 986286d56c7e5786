"""Hubs with many tokens."""

import itertools
import math

from fsweave.operators import ngram, scoring
from fsweave.plans.machine import EPS, Machine


def test_a_hub_of_many_tokens_is_scored_whole():
    spelled = ["".join(p) for p in itertools.islice(itertools.product("abcdefghijk", repeat=4), 12_000)]
    spelled += ["z" + c for c in "abc"]
    p = {("t%d" % k,): (0.5 if s[0] == "z" else 1.0) for k, s in enumerate(spelled)}
    total = sum(p.values())
    model = ngram.FiniteModel({})
    arcs, number = [], {}
    for k, s in enumerate(spelled):  # silent paths write the spelling, the last arc reads the token
        at = 0
        for n, c in enumerate(s):
            to = number.setdefault(s[: n + 1], len(number) + 1)
            arcs.append((at, EPS, c, to))
            at = to
        arcs.append((at, "t%d" % k, EPS, 0))
    m = Machine.of(arcs, [0], [0])

    class One:
        """One token, or the end after it."""

        eos = model.eos

        def logp_next(self, xs):
            return {self.eos: 0.0} if xs else {t[0]: math.log(w / total) for t, w in p.items()} | {self.eos: float("-inf")}

        def logp(self, xs, a):
            return self.logp_next(xs).get(a, float("-inf"))

    hubs = {0: {"t%d" % k: (tuple(s), 0) for k, s in enumerate(spelled)}}  # the regions of so large a machine are not needed here
    beam = scoring.HubBeam(m, One(), hubs=hubs)
    state, done = beam.start(), ""
    for c in ("", *"abcd"):
        if c:
            state, done = beam.advance(state, c), done + c
        got = beam.logp_next(state)
        mass = sum(w for (t,), w in p.items() if spelled[int(t[1:])].startswith(done))
        for d in "abcz":
            want = sum(w for (t,), w in p.items() if spelled[int(t[1:])].startswith(done + d)) / mass
            assert abs(math.exp(got.get(d, float("-inf"))) - want) < 1e-9
