"""Small machines by name, built from rules; used by queries and tests."""

from __future__ import annotations

import string
from collections.abc import Iterable

from fsweave.plans.machine import EPS, Machine


def table(text: str, starts: str, finals: str, **more) -> Machine:
    """A machine from lines of arcs ``source read/write target``; ``-`` stands for nothing."""
    arcs = []
    for line in text.split(";"):
        i, label, j = line.split()
        a, b = label.split("/")
        arcs.append((i, EPS if a == "-" else a, EPS if b == "-" else b, j))
    return Machine.of(arcs, starts.split(), finals.split(), **more)


def letters(mapping: Iterable[tuple[str, str]]) -> Machine:
    """One state that writes ``b`` for ``a``, for each pair; ``EPS`` deletes."""
    return Machine.of(((0, a, b, 0) for a, b in mapping), [0], [0])


def lowercase() -> Machine:
    return letters((c, c.lower()) for c in string.ascii_letters + " ")


def togglecase() -> Machine:
    return letters((c, c.swapcase()) for c in string.ascii_letters + " ")


def delete_b() -> Machine:
    """Writes A for a and nothing for b; b is in the output alphabet though nothing writes it."""
    return letters([("a", "A"), ("b", EPS)]).with_(writes=["b"])


def newspeak(alphabet: str = string.ascii_lowercase) -> Machine:
    """Rewrites ``bad`` as ``ungood``, guessing at each b; a guess that fails has no arc to go on."""
    arcs = []
    for state, forbidden in ((0, ""), (2, ""), (4, "d")):
        for c in alphabet:
            if c in forbidden:
                continue
            if c == "b":
                arcs += [(state, c, c, 2), (state, c, "u", 1)]
            else:
                arcs.append((state, c, c, 4 if state == 2 and c == "a" else 0))
    chain = [(1, "a", "n", 3), (3, "d", "g", 5), (5, EPS, "o", 6), (6, EPS, "o", 7), (7, EPS, "d", 0)]
    return Machine.of([*arcs, *chain], [0], [0, 2, 4])


def parity(alphabet: str = "ab") -> Machine:
    """Writes 1 after an even number of symbols, 0 after an odd one."""
    swaps = [(s, c, EPS, 1 - s) for s in (0, 1) for c in alphabet]
    return Machine.of([*swaps, (0, EPS, "1", 2), (1, EPS, "0", 2)], [0], [2])


def parity_copy() -> Machine:
    """a^n becomes b^n for even n, c^n for odd n."""
    return table("s -/- e0; e0 a/b e1; e1 a/b e0; e0 -/- t; s -/- o0; o0 a/c o1; o1 a/c o0; o1 -/- t", "s", "t")


def duplicate(alphabet: str = "12345", times: int = 2) -> Machine:
    """Every symbol ``times`` times."""
    arcs = []
    for c in alphabet:
        stops = [0, *((c, k) for k in range(1, times)), 0]
        arcs += [(stops[k], c if k == 0 else EPS, c, stops[k + 1]) for k in range(times)]
    return Machine.of(arcs, [0], [0])


def comma_separator(domain: Iterable[str], mark: str = "|") -> Machine:
    """Marks a comma that is followed by anything but a digit."""
    domain = frozenset(domain) | set("0123456789,")
    arcs = [(0, c, c, 1 if c == "," else 0) for c in domain]
    arcs += [(1, d, d, 0) for d in "0123456789"] + [(1, EPS, mark, 2), (2, ",", ",", 1)]
    arcs += [(2, c, c, 0) for c in domain - set("0123456789,")]
    return Machine.of(arcs, [0], [0, 1])


# The arcs of the machines below written as text (state, read/write, target; - is nothing) define what
# is known of their outputs and decompositions, so they stand as they are.  What has a rule is built from it.


def backticks() -> Machine:
    """Two backticks become a double quote, one stays, a becomes b."""
    return table('s a/- c; c -/b s; s `/- q; q -/` p; q `/" d; d -/- s; p a/- c', "s", "s p d")


def anbn() -> Machine:
    """a becomes b, aa becomes c, and a^n becomes b^n from three on."""
    return table("s a/- 1; 1 -/b 2; 1 a/- 3; 3 -/c 4; 3 a/b 5; 5 -/b 6; 6 -/b 7; 7 a/b 7", "s", "2 4 7")


def count_mod3(alphabet: str = "ab") -> Machine:
    """Writes the number of symbols mod 3."""
    steps = [(k, c, EPS, (k + 1) % 3) for k in range(3) for c in alphabet]
    return Machine.of([*steps, *((k, EPS, str(k), "end") for k in range(3))], [0], ["end"])


def has_mark() -> Machine:
    """Writes 1 if the text of a and # has a #, else nothing."""
    return table("0 a/- 0; 0 #/- 1; 1 a/- 1; 1 #/- 1; 1 -/1 3", "0", "0 3")


def small() -> Machine:
    return table("0 a/x 1; 0 b/x 2; 2 a/a 3; 2 b/b 3; 3 a/a 3; 3 b/b 3", "0", "0 1 3")


def lookahead() -> Machine:
    return table("0 a/- 1; 1 a/x 11; 11 a/x 111; 0 b/x 2; 2 a/a 3; 2 b/b 3; 3 a/a 4; 3 b/b 4; 4 a/a 4; 4 b/b 4", "0", "0 111 4")


def triplets() -> Machine:
    """Copies (aaa or bbb)*."""
    return table("0 a/a 1; 1 a/a 2; 2 a/a 0; 0 b/b 3; 3 b/b 4; 4 b/b 0", "0", "0")


def split_copy() -> Machine:
    """Not a function: ab becomes c or cx."""
    return table("0 a/- 1; 0 a/c 2; 0 b/y 4; 1 b/c 3; 2 a/x 4; 3 -/x 4; 4 a/x 4; 4 b/x 4", "0", "2 3 4")


def sdd1() -> Machine:
    return table("0 -/a 1; 0 a/a 2; 1 a/- 2; 1 -/- 1; 2 a/a 2; 2 b/b 2", "0", "2")


def gated() -> Machine:
    """Gates a and b lead to states that accept part or all; c leads to the universal one."""
    return table("0 a/y 1; 0 b/y 2; 0 c/y 1; 1 a/a 1; 1 b/b 1; 1 c/c 1; 2 a/a 2", "0", "1 2")


def complementary() -> Machine:
    """After x, pairs of states that are universal only together."""
    arcs = [(0, "x", "y", k) for k in range(1, 5)]
    for k, own in ((1, "ab"), (2, "cdx"), (3, "ac"), (4, "bdx")):
        arcs += [(k, c, c, t) for c in own for t in ((1, 2) if k < 3 else (3, 4))]
    return Machine.of(arcs, [0], [1, 2, 3, 4])


def two_hubs(alphabet: str = "ab") -> Machine:
    return Machine.of([("h0", "a", "x", "h1"), ("h1", "b", "y", "h0"), *(("h0", c, c, "h0") for c in alphabet if c != "a"), *(("h1", c, c, "h1") for c in alphabet if c != "b")], ["h0"], ["h0", "h1"])


def escaping_hub() -> Machine:
    return table("r -/x A; r -/y B; A a/- r; B b/- C; C a/a C; C b/b C; C -/- D; D a/a E; E a/a E; E b/b E", "r", "r C E")


def hub_ring(n: int = 3, alphabet: str = "ab") -> Machine:
    return Machine.of(((i, c, c, (i + 1) % n) for i in range(n) for c in alphabet), [0], range(n))


def torn_hub() -> Machine:
    """Not a function: b becomes y or z."""
    return table("0 a/x 0; 0 b/y 0; 0 b/z 0", "0", "0")


def no_hub() -> Machine:
    return table("0 a/x 1; 1 b/y 0", "0", "0 1")


def token_trie(vocabulary: Iterable[tuple[str, Iterable[str]]], wrapped: bool = False) -> Machine:
    """Reads tokens, writes their spelling: the symbols come first, the token is read when they are out.

    States are prefixes of spellings; the root is start and final.
    """
    arcs = set()
    for token, spelling in vocabulary:
        spelling = tuple(spelling)
        arcs |= {(spelling[:k], EPS, spelling[k], spelling[: k + 1]) for k in range(len(spelling))}
        arcs.add((spelling, token, EPS, ()))
    if wrapped:  # a copy loop over x and y in front, and a bar that leads to the trie
        return Machine.of([*arcs, ("w", "x", "x", "w"), ("w", "y", "y", "w"), ("w", EPS, "|", ())], ["w"], [()])
    return Machine.of(arcs, [()], [()])


def scaled_newspeak(n: int = 3, alphabet: str = string.ascii_lowercase) -> Machine:
    """Pairs of letters (i, i + 1) become one upper-case letter, for the first n letters."""
    arcs = []
    for state in (0, *((c, "seen") for c in alphabet[:n])):
        ban = alphabet[alphabet.index(state[0]) + 1] if state else ""
        for i, c in enumerate(alphabet):
            if c == ban:
                continue
            arcs.append((state, c, c, (c, "seen") if i < n else 0))
            if i < n:
                arcs.append((state, c, EPS, (c, "joined")))
    arcs += [((alphabet[i], "joined"), alphabet[i + 1], alphabet[i].upper(), 0) for i in range(n)]
    return Machine.of(arcs, [0], [0, *((c, "seen") for c in alphabet[:n])])


CATALOG = {
    f.__name__: f
    for f in (
        lowercase, togglecase, delete_b, newspeak, parity, parity_copy, duplicate, backticks, anbn, count_mod3, has_mark, small,
        lookahead, triplets, split_copy, sdd1, gated, complementary, two_hubs, escaping_hub, hub_ring, torn_hub, no_hub, scaled_newspeak,
    )
}
