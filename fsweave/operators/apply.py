"""Machines applied to columns: built-in expressions where the machine's shape allows, else Arrow batches."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fsweave.operators.algebra import compose, determinize, trim
from fsweave.plans.machine import EPS, Machine
from fsweave.plans.precover import Decomposition

#: Characters with a meaning in regular expressions' classes.
_CLASS_SPECIALS = "\\]^-[&~"
#: Characters of a block of a fold; characters of an input beyond which its output is not remembered.
FOLD, LONG = 256, 64


def _class(chars) -> str:
    return "[" + "".join("\\" + c if c in _CLASS_SPECIALS else c for c in sorted(chars)) + "]"


def is_letter_map(m: Machine) -> bool:
    """One state, one output of at most one character for each input character."""
    t = trim(m)
    reads = [a for _, a, _, _ in t.arcs]
    return len(t.states) == 1 and len(reads) == len(set(reads)) and all(len(str(a)) == 1 for a in reads) and all(len(str(b)) <= 1 for _, _, b, _ in t.arcs)


def translate_column(m: Machine, column: Column) -> Column:
    """A letter map as ``translate``; inputs outside the domain give null."""
    pairs = [(a, b) for _, a, b, _ in trim(m).arcs]
    kept, gone = [p for p in pairs if p[1]], [a for a, b in pairs if not b]
    moved = [(a, b) for a, b in kept if a != b]
    text = F.translate(column, "".join(a for a, _ in moved) + "".join(gone), "".join(b for _, b in moved))
    return F.when(column.rlike(f"^{_class([a for a, _ in pairs])}*$"), text)


def sequential_form(m: Machine, limit: int = 512) -> tuple[list[dict], list[str | None]] | None:
    """Deterministic steps with delayed output: state -> {symbol: (output, state)}, and final outputs.

    Subsets carry for each machine state what its output has beyond the common part;
    the common part is written at once.  None if a delay never ends or the machine is
    no function (an input with two outputs).
    """
    t = trim(m)
    useful = {q for q in t.states if q in t.finals or any(a != EPS for a, _, _ in t.out(q))}

    def settle(pairs: set) -> tuple[str, frozenset] | None:
        done, todo = set(pairs), list(pairs)
        while todo:
            q, y = todo.pop()
            for b, j in t.on(q, EPS):
                s = (j, y + b)
                if s not in done:
                    if len(y) > 64 or len(done) > limit:
                        return None
                    done.add(s)
                    todo.append(s)
        done = {s for s in done if s[0] in useful}
        texts = [y for _, y in done]
        first, last = min(texts, default=""), max(texts, default="")
        k = 0
        while k < len(first) and first[k] == last[k]:
            k += 1
        return first[:k], frozenset((q, y[k:]) for q, y in done)

    begin = settle({(q, "") for q in t.starts})
    if begin is None:
        return None
    lead, start = begin
    number, states, steps, finals = {start: 0}, [start], [], []
    k = 0
    while k < len(states):
        subset = states[k]
        ends = {y for q, y in subset if q in t.finals}
        if len(ends) > 1 or len(states) > limit:
            return None
        finals.append(ends.pop() if ends else None)
        to: dict = defaultdict(set)
        for q, y in subset:
            for a, b, j in t.out(q):
                if a != EPS:
                    to[a].add((j, y + b))
        row = {}
        for a, pairs in to.items():
            got = settle(pairs)
            if got is None:
                return None
            y, target = got
            if any(len(z) > 64 for _, z in target):
                return None
            if target not in number:
                number[target] = len(states)
                states.append(target)
            row[a] = (y, number[target])
        steps.append(row)
        k += 1
    if lead:  # what every output begins with is written with the first step or the end
        steps.append({a: (lead + y, j) for a, (y, j) in steps[0].items()})
        finals.append(None if finals[0] is None else lead + finals[0])
        shift = len(steps) - 1
        order = [shift, *range(shift)]
        at = {old: new for new, old in enumerate(order)}
        steps = [{a: (y, at[j]) for a, (y, j) in steps[i].items()} for i in order]
        finals = [finals[i] for i in order]
    return steps, finals


def aggregate_column(m: Machine, column: Column) -> Column | None:
    """A machine with a sequential form as a fold over characters, inside the JVM.

    The fold carries the state and the pieces written; pieces are joined once for each
    block of ``FOLD`` characters and once at the end, since a fold copies what it carries
    at each step.  A step looks up one map by state and character.  Inputs outside the
    domain give null.
    """
    form = sequential_form(m)
    if form is None:
        return None
    steps, finals = form
    table = [F.lit(f"{i} {a}") for i, row in enumerate(steps) for a in row]
    values = [F.struct(F.lit(y).alias("y"), F.lit(j).alias("q")) for row in steps for y, j in row.values()]
    lookup = F.map_from_arrays(F.array(*table), F.array(*values))
    nothing = F.lit(None).cast("struct<y:string,q:int>")
    none = F.array().cast("array<string>")
    begin = F.struct(F.lit(0).alias("q"), none.alias("ys"))

    def step(acc, c):
        hit = F.when(acc["q"] >= 0, F.try_element_at(lookup, F.concat(acc["q"].cast("string"), F.lit(" "), c))).otherwise(nothing)
        return F.struct(F.coalesce(hit["q"], F.lit(-1)).alias("q"), F.array_append(acc["ys"], F.coalesce(hit["y"], F.lit(""))).alias("ys"))

    def block(acc, text):
        pieces = F.aggregate(F.split(text, ""), F.struct(acc["q"].alias("q"), none.alias("ys")), step, lambda r: F.struct(r["q"].alias("q"), F.array_join(r["ys"], "").alias("y")))
        # an array of one, so that the block is folded once and used twice
        return F.get(F.transform(F.array(pieces), lambda r: F.struct(r["q"].alias("q"), F.array_append(acc["ys"], r["y"]).alias("ys"))), 0)

    last = F.map_from_arrays(F.array(*[F.lit(i) for i, y in enumerate(finals) if y is not None]), F.array(*[F.lit(y) for y in finals if y is not None]))
    end = F.aggregate(F.regexp_extract_all(column, F.lit(f"(?s).{{1,{FOLD}}}"), 0), begin, block, lambda r: F.concat(F.array_join(r["ys"], ""), F.try_element_at(last, r["q"])))
    return F.when(column.isNotNull(), end)


def apply_batches(df: DataFrame, m: Machine, column: str, to: str) -> DataFrame:
    """Any functional machine, in Arrow batches: the first output of each input, or null."""
    form = sequential_form(m)
    shared = df.sparkSession.sparkContext.broadcast(form if form is not None else m)

    def run(batches):
        plan = shared.value
        memo: dict[str, str | None] = {}

        def one(x: str) -> str | None:
            if isinstance(plan, tuple):
                steps, finals = plan
                q, out = 0, []
                for c in x:
                    hit = steps[q].get(c)
                    if hit is None:
                        return None
                    out.append(hit[0])
                    q = hit[1]
                return None if finals[q] is None else "".join(out) + finals[q]
            from fsweave.operators.algebra import transduce

            return next(("".join(y) for y in transduce(plan, x)), None)

        for batch in batches:
            values = []
            for x in batch.column(batch.schema.get_field_index(column)).to_pylist():
                if x is None:
                    values.append(None)
                    continue
                if len(x) > LONG:
                    values.append(one(x))
                    continue
                if x not in memo:
                    if len(memo) > 100_000:
                        memo.clear()
                    memo[x] = one(x)
                values.append(memo[x])
            yield batch.append_column(to, pa.array(values, pa.string()))

    from pyspark.sql.types import StringType, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(to, StringType()))


def apply(df: DataFrame, m: Machine, column: str, to: str) -> DataFrame:
    """``df`` with the machine's output of ``column`` as ``to``; null outside the domain.

    A letter map becomes ``translate``, a tiny sequential machine a fold, anything else
    Arrow batches, which were several times faster than folds over larger tables.  ``df`` must not have a column ``to``.
    """
    if is_letter_map(m):
        return df.withColumn(to, translate_column(m, F.col(column)))
    form = sequential_form(m)
    if form is not None and sum(map(len, form[0])) <= 24:
        return df.withColumn(to, aggregate_column(m, F.col(column)))
    return apply_batches(df, m, column, to)


def apply_all(df: DataFrame, machines: list[Machine], column: str, to: str) -> DataFrame:
    """Several machines one after the other, fused into their composition."""
    m = machines[0]
    for g in machines[1:]:
        m = trim(compose(m, g)).renumber()
    return apply(df, m, column, to)


def relation_rows(df: DataFrame, m: Machine, column: str, to: str, longest: int | None = None) -> DataFrame:
    """One row for each output of each input, for machines that are no functions.

    An input with endlessly many outputs is an error, unless ``longest`` bounds them.
    """
    shared = df.sparkSession.sparkContext.broadcast(m)

    def run(batches):
        from fsweave.operators.algebra import transduce

        for batch in batches:
            at, out = [], []
            for k, x in enumerate(batch.column(batch.schema.get_field_index(column)).to_pylist()):
                for y in transduce(shared.value, x, longest) if x is not None else ():
                    at.append(k)
                    out.append("".join(y))
            yield batch.take(pa.array(at, pa.int64())).append_column(to, pa.array(out, pa.string()))

    from pyspark.sql.types import StringType, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(to, StringType()))


def totalized(value: Column, marker: str) -> Column:
    """An applied machine made total: the marker where it gave null."""
    return F.coalesce(value, F.lit(marker))


def regex_of(m: Machine, prefix: bool = False, limit: int = 4000) -> str | None:
    """A regular expression of an acceptor's language, by removing states; None if it grows over ``limit``.

    With ``prefix`` the final states stand for "and anything after".  None too if anything
    but a single class is repeated: Java's matcher recurses into repeated groups and
    does not survive long strings.
    """
    d = trim(determinize(m)).renumber()
    if not d.states:
        return r"^(?!)"
    begin, end = "begin", "end"
    edge: dict = defaultdict(lambda: None)

    def add(i, j, text):
        edge[i, j] = text if edge[i, j] is None else f"{edge[i, j]}|{text}"

    grouped: dict = defaultdict(list)
    for i, a, _, j in d.arcs:
        grouped[i, j].append(a)
    for (i, j), chars in grouped.items():
        add(i, j, _class(chars))
    single = {text for text in edge.values() if text is not None}
    for s in d.starts:
        add(begin, s, "")
    for f in d.finals:
        add(f, end, "")
    for q in sorted(d.states, reverse=True):
        loop = edge[q, q]
        if loop is not None and loop not in single:
            return None
        again = f"{loop}*" if loop is not None else ""
        into = [(i, t) for (i, j), t in list(edge.items()) if j == q and i != q and t is not None]
        out = [(j, t) for (i, j), t in list(edge.items()) if i == q and j != q and t is not None]
        for i, a in into:
            for j, b in out:
                add(i, j, f"(?:{a}){again}(?:{b})")
                if len(edge[i, j]) > limit:
                    return None
        for pair in [p for p in edge if q in p]:
            del edge[pair]
    return f"(?s)^(?:{edge[begin, end]}){'' if prefix else '$'}" if edge[begin, end] is not None else r"^(?!)"


def accepts_column(m: Machine, column: Column) -> Column | None:
    """Membership in an acceptor's language as ``rlike``."""
    text = regex_of(m)
    return None if text is None else column.rlike(text.replace("$", r"\z") if text.endswith("$") else text)


def flag_members(df: DataFrame, m: Machine, column: str, to: str) -> DataFrame:
    """``df`` with whether ``m`` takes ``column``: by pattern, or by a broadcast automaton if that is too large.

    A null is no member.
    """
    test = accepts_column(m, F.col(column))
    if test is not None:
        return df.withColumn(to, F.coalesce(test, F.lit(False)))
    shared = df.sparkSession.sparkContext.broadcast(determinize(m).renumber())

    def run(batches):
        d = shared.value
        (start,) = d.starts
        moves: dict = defaultdict(dict)
        for i, a, _, j in d.arcs:
            moves[i][a] = j

        def member(x) -> bool:
            q = start
            for a in x:
                q = moves[q].get(a)
                if q is None:
                    return False
            return q in d.finals

        for batch in batches:
            xs = batch.column(batch.schema.get_field_index(column)).to_pylist()
            yield batch.append_column(to, pa.array([x is not None and member(x) for x in xs], pa.bool_()))

    from pyspark.sql.types import BooleanType, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(to, BooleanType()))


def precover_column(m: Machine, target: str, column: Column) -> Column | None:
    """``f(column) starts with target`` as a test of the column itself.

    Q becomes a prefix pattern and R a whole pattern, so the filter runs on the source
    text before the machine does, and constant prefixes can reach the scan.
    """
    d = Decomposition(m, target)
    parts = [(regex_of(d.quotient, prefix=True), d.q_stops), (regex_of(d.remainder), d.r_stops)]
    if any(text is None for text, stops in parts if stops):
        return None
    tests = [column.rlike(text.replace("$", r"\z") if text.endswith("$") else text) for text, stops in parts if stops]
    if not tests:
        return F.lit(False)
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def flag_parts(df: DataFrame, m: Machine, target: str, column: str, to: str) -> DataFrame:
    """``df`` with where ``column`` stands in the precover of ``target``: Q (or below a string of Q), R or nothing.

    By patterns, or by a broadcast automaton where these will not do.  A null stands nowhere.
    """
    d = Decomposition(m, target)
    patterns = [(name, regex_of(part, prefix=name == "Q")) for name, part, stops in (("Q", d.quotient, d.q_stops), ("R", d.remainder, d.r_stops)) if stops]
    if all(text is not None for _, text in patterns):
        part = F.lit("")
        for name, text in reversed(patterns):
            part = F.when(F.col(column).rlike(text.replace("$", r"\z") if text.endswith("$") else text), name).otherwise(part)
        return df.withColumn(to, part)
    shared = df.sparkSession.sparkContext.broadcast(d)

    def run(batches):
        d = shared.value
        for batch in batches:
            xs = batch.column(batch.schema.get_field_index(column)).to_pylist()
            yield batch.append_column(to, pa.array(["" if x is None else d.part_of(x) for x in xs], pa.string()))

    from pyspark.sql.types import StringType, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(to, StringType()))


def filter_by_output(df: DataFrame, m: Machine, column: str, target: str) -> DataFrame:
    """Rows whose output starts with ``target``; by pattern, or by a broadcast automaton if that is too large."""
    test = precover_column(m, target, F.col(column))
    if test is not None:
        return df.where(test)
    shared = df.sparkSession.sparkContext.broadcast(Decomposition(m, target))

    def run(batches):
        d = shared.value
        for batch in batches:
            xs = batch.column(batch.schema.get_field_index(column)).to_pylist()
            yield batch.filter(pa.array([x is not None and d.part_of(x) != "" for x in xs], pa.bool_()))

    return df.mapInArrow(run, df.schema)
