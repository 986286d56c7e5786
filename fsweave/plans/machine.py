"""Immutable finite-state machines: arc sets that become tables or compiled arrays.

A machine is a set of arcs ``(source, read, write, target)`` with start and final
states.  An acceptor is a machine that writes what it reads.  ``EPS`` reads or writes
nothing.  Alphabets hold every label of the arcs except ``EPS`` and may be larger.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPS = ""
Arc = tuple[Hashable, Hashable, Hashable, Hashable]

#: Schemas of a machine as tables; ``EPS`` is the empty string there, never null.
ARC_SCHEMA = "src int, ilabel string, olabel string, dst int"
STATE_SCHEMA = "state int, is_start boolean, is_final boolean"


@dataclass(frozen=True)
class Machine:
    arcs: frozenset[Arc]
    starts: frozenset
    finals: frozenset
    reads: frozenset
    writes: frozenset

    @staticmethod
    def of(arcs: Iterable[Arc], starts: Iterable, finals: Iterable, reads: Iterable = (), writes: Iterable = ()) -> Machine:
        arcs = frozenset(arcs)
        return Machine(
            arcs,
            frozenset(starts),
            frozenset(finals),
            frozenset(reads) | {a for _, a, _, _ in arcs} - {EPS},
            frozenset(writes) | {b for _, _, b, _ in arcs} - {EPS},
        )

    @staticmethod
    def acceptor(arcs: Iterable[tuple], starts: Iterable, finals: Iterable, labels: Iterable = ()) -> Machine:
        labels = frozenset(labels)
        return Machine.of(((i, a, a, j) for i, a, j in arcs), starts, finals, labels, labels)

    @cached_property
    def states(self) -> frozenset:
        return self.starts | self.finals | {s for i, _, _, j in self.arcs for s in (i, j)}

    @cached_property
    def by_source(self) -> dict:
        """source -> [(read, write, target)], in a fixed order."""
        out: dict = defaultdict(list)
        for i, a, b, j in sorted(self.arcs, key=repr):
            out[i].append((a, b, j))
        return dict(out)

    @cached_property
    def by_read(self) -> dict:
        """(source, read) -> [(write, target)]."""
        out: dict = defaultdict(list)
        for i, rows in self.by_source.items():
            for a, b, j in rows:
                out[i, a].append((b, j))
        return dict(out)

    def out(self, state) -> list[tuple]:
        return self.by_source.get(state, [])

    def on(self, state, label) -> list[tuple]:
        return self.by_read.get((state, label), [])

    @property
    def is_acceptor(self) -> bool:
        return all(a == b for _, a, b, _ in self.arcs)

    def with_(self, arcs=(), starts=(), finals=(), reads=(), writes=()) -> Machine:
        """A machine with further arcs, states and labels."""
        return Machine.of(self.arcs | set(arcs), self.starts | set(starts), self.finals | set(finals), self.reads | set(reads), self.writes | set(writes))

    def keeping(self, states: Iterable) -> Machine:
        """Only these states and the arcs between them; the alphabets stay."""
        kept = frozenset(states)
        return Machine.of((x for x in self.arcs if x[0] in kept and x[3] in kept), self.starts & kept, self.finals & kept, self.reads, self.writes)

    def spawn(self, arcs: bool = False, starts: bool = False, finals: bool = False) -> Machine:
        """A copy of the chosen parts, with the same alphabets."""
        return Machine.of(self.arcs if arcs else (), self.starts if starts else (), self.finals if finals else (), self.reads, self.writes)

    def rename(self, f: Callable) -> Machine:
        """States renamed; ones that get the same name are merged."""
        return Machine.of(((f(i), a, b, f(j)) for i, a, b, j in self.arcs), map(f, self.starts), map(f, self.finals), self.reads, self.writes)

    def merge(self, states: Iterable, name) -> Machine:
        joined = frozenset(states)
        return self.rename(lambda q: name if q in joined else q)

    def renumber(self) -> Machine:
        """States 0, 1, ... in order of discovery from the starts, then the rest."""
        number: dict = {}
        for q in [*sorted(self.starts, key=repr), *sorted(self.states, key=repr)]:
            todo = [q]
            while todo:
                s = todo.pop(0)
                if s not in number:
                    number[s] = len(number)
                    todo += [j for _, _, j in self.out(s)]
        return self.rename(number.__getitem__)

    def relabel(self, read: Callable = lambda a: a, write: Callable = lambda b: b) -> Machine:
        """Labels mapped; ``EPS`` stays."""
        f, g = (lambda a: a if a == EPS else read(a)), (lambda b: b if b == EPS else write(b))
        return Machine.of(((i, f(a), g(b), j) for i, a, b, j in self.arcs), self.starts, self.finals, map(f, self.reads), map(g, self.writes))

    @property
    def T(self) -> Machine:
        """What was written is read, and the other way round."""
        return Machine.of(((i, b, a, j) for i, a, b, j in self.arcs), self.starts, self.finals, self.writes, self.reads)

    def reverse(self) -> Machine:
        return Machine.of(((j, a, b, i) for i, a, b, j in self.arcs), self.finals, self.starts, self.reads, self.writes)

    def project(self, side: int) -> Machine:
        """The acceptor of what is read (0) or written (1)."""
        labels = (self.reads, self.writes)[side]
        return Machine.acceptor(((x[0], x[1 + side], x[3]) for x in self.arcs), self.starts, self.finals, labels)

    # Tables

    def to_df(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Arc table and state table, states numbered."""
        m = self.renumber()
        arcs = [(i, str(a), str(b), j) for i, a, b, j in sorted(m.arcs, key=repr)]
        states = [(q, q in m.starts, q in m.finals) for q in sorted(m.states)]
        return spark.createDataFrame(arcs, ARC_SCHEMA), spark.createDataFrame(states, STATE_SCHEMA)

    @staticmethod
    def from_df(arcs: DataFrame, states: DataFrame) -> Machine:
        """Collect a machine; only for machines, which are small, never for data."""
        rows = arcs.select("src", "ilabel", "olabel", "dst").distinct().collect()
        ends = states.select("state", "is_start", "is_final").collect()
        return Machine.of(map(tuple, rows), (r[0] for r in ends if r[1]), (r[0] for r in ends if r[2]))

    def dot(self) -> str:
        """Graphviz text; parallel arcs share an edge whose label lists ranges."""
        m = self.renumber()
        edges: dict = defaultdict(list)
        for i, a, b, j in sorted(m.arcs, key=repr):
            edges[i, j].append((str(a), str(b)))
        lines = ["digraph machine {", "  rankdir=LR;"]
        for q in sorted(m.states):
            lines.append(f'  {q} [shape={"doublecircle" if q in m.finals else "circle"}{", penwidth=2" if q in m.starts else ""}];')
        for (i, j), labels in sorted(edges.items()):
            same = label_ranges([a for a, b in labels if a == b])
            text = ", ".join([same] * bool(same) + [f"{a or 'ε'}:{b or 'ε'}" for a, b in labels if a != b]).replace('"', '\\"')
            lines.append(f'  {i} -> {j} [label="{text}"];')
        return "\n".join([*lines, "}"])


def label_ranges(labels: Iterable[str], alphabet: Iterable[str] = ()) -> str:
    """Single characters as ranges (``a-d``), or as the complement (``^x``) where that is shorter."""
    def islands(chars: Iterable[str]) -> str:
        runs: list[list[int]] = []
        for c in sorted({ord(x) for x in chars if len(x) == 1}):
            if runs and c == runs[-1][1] + 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        return "".join(chr(a) if a == b else chr(a) + chr(b) if b == a + 1 else f"{chr(a)}-{chr(b)}" for a, b in runs)

    labels, alphabet = list(labels), frozenset(alphabet)
    parts = [islands(labels), *sorted(x if x else "ε" for x in labels if len(x) != 1)]
    text = ",".join(p for p in parts if p)
    missing = "^" + islands(alphabet - set(labels))
    return missing if alphabet and len(missing) < len(text) else text


def label_table(arcs: DataFrame) -> DataFrame:
    """The same compression as a query: src, dst, first and last label of each run of identity labels."""
    from pyspark.sql import Window

    rows = arcs.where((F.col("ilabel") == F.col("olabel")) & (F.length("ilabel") == 1)).select("src", "dst", F.ascii("ilabel").alias("code"), "ilabel").distinct()
    island = F.col("code") - F.row_number().over(Window.partitionBy("src", "dst").orderBy("code"))
    return rows.withColumn("island", island).groupBy("src", "dst", "island").agg(F.min("code").alias("a"), F.max("code").alias("b")).select("src", "dst", F.chr("a").alias("first_label"), F.chr("b").alias("last_label"))
