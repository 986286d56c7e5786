"""Registered queries that run one operator each on machines and compare what it made with SQL on the words.

A machine is built, an operator turns it into another, and all words (with their
counts) go through the result.  The SQL says the same without machines.
"""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fsweave.functions import rewrite
from fsweave.operators import algebra
from fsweave.operators.apply import apply, flag_members
from fsweave.plans.lazy import Lazy
from fsweave.plans.machine import Machine
from fsweave.plans.precover import Decomposition, next_symbols, preimage
from fsweave.plans.queries import _LOWER, _WORDS, lower_words, query, words
from fsweave.sources import catalog, corpora

ALPHABET = string.ascii_lowercase
#: Syllables of the languages below.
SYLLABLES = ("th", "he", "in", "er", "an", "on", "re", "ed", "nd")
_SYLLABLES = "|".join(SYLLABLES)


def flags(rows: DataFrame, column: str, machines: dict[str, Machine]) -> DataFrame:
    """A boolean column for each machine: whether it takes ``column``."""
    for name, m in machines.items():
        rows = flag_members(rows, m, column, name)
    return rows


def anything() -> Machine:
    return algebra.universal(ALPHABET)


def containing(text: str) -> Machine:
    return algebra.concat(algebra.concat(anything(), algebra.from_string(text)), anything())


def ending(text: str) -> Machine:
    return algebra.concat(anything(), algebra.from_string(text))


# Set operations and quotients


@query(
    f"""WITH {_LOWER} SELECT x, contains(x, 'th') OR contains(x, 'er') AS any_of, contains(x, 'th') AND contains(x, 'er') AS both, contains(x, 'th') AND NOT contains(x, 'er') AS less,
    contains(x, 'th') <> contains(x, 'er') AS one_of, NOT contains(x, 'th') AS none, ends_with(x, 'er') AS ends FROM l"""
)
def q50_set_operations(spark, sf_dir):
    a, b = containing("th"), containing("er")
    made = {
        "any_of": algebra.union(a, b),
        "both": algebra.intersection(a, b),
        "less": algebra.difference(a, b),
        "one_of": algebra.symmetric_difference(a, b),
        "none": algebra.complement(a, ALPHABET),
        "ends": algebra.concat(anything(), algebra.from_string("er")),
    }
    return flags(lower_words(spark, sf_dir).select("x"), "x", made)


@query(
    f"""WITH {_LOWER} SELECT x, regexp_full_match(x, '({_SYLLABLES})*') AS star, regexp_full_match(x, '({_SYLLABLES})+') AS plus, x IN ({', '.join(repr(s) for s in SYLLABLES)}) AS member,
    x = 'a' AS single, x = '' AS one, FALSE AS zero, TRUE AS everything FROM l"""
)
def q51_closures_and_constants(spark, sf_dir):
    some = algebra.from_strings(SYLLABLES)
    made = {"star": algebra.star(some), "plus": algebra.plus(some), "member": some, "single": algebra.lift("a"), "one": algebra.one(), "zero": algebra.zero(), "everything": anything()}
    return flags(lower_words(spark, sf_dir).select("x"), "x", made)


@query(
    f"""WITH {_LOWER} SELECT x, regexp_full_match('th' || x, '[a-z]*t?he[a-z]*(ed|er)') AS derivative,
    regexp_full_match('t' || x, '[a-z]*t?he[a-z]*(ed|er)') OR regexp_full_match('the' || x, '[a-z]*t?he[a-z]*(ed|er)') OR regexp_full_match('an' || x, '[a-z]*t?he[a-z]*(ed|er)') AS left_of,
    regexp_full_match(x || 'd', '[a-z]*t?he[a-z]*(ed|er)') OR regexp_full_match(x || 'er', '[a-z]*t?he[a-z]*(ed|er)') AS right_of FROM l"""
)
def q52_quotients_of_machines(spark, sf_dir):
    m = algebra.concat(containing("he"), algebra.from_strings(["ed", "er"]))
    made = {
        "derivative": algebra.derivative(m, "th"),
        "left_of": algebra.left_quotient(m, algebra.from_strings(["t", "the", "an"])),
        "right_of": algebra.right_quotient(m, algebra.from_strings(["d", "er"])),
    }
    return flags(lower_words(spark, sf_dir).select("x"), "x", made)


# Forms of one language


@query(f"WITH {_LOWER}, f AS (SELECT unnest(['eps-free', 'deterministic', 'minimal', 'by reversal', 'with sink', 'reversed twice', 'trimmed', 'renumbered', 'lazy']) AS form) SELECT form, x, n FROM f, l WHERE regexp_full_match(x, '({_SYLLABLES})*[a-z]?({_SYLLABLES})+')")
def q53_forms_of_a_language(spark, sf_dir):
    """The same members by every form of a machine with silent moves and many ways."""
    some = algebra.from_strings(SYLLABLES)
    m = algebra.concat(algebra.concat(algebra.star(some), algebra.union(algebra.one(), Machine.acceptor([(0, c, 1) for c in ALPHABET], [0], [1]))), algebra.plus(some))
    made = {
        "eps-free": algebra.remove_eps(m),
        "deterministic": algebra.determinize(m),
        "minimal": algebra.minimize(m),
        "by reversal": algebra.minimize_by_reversal(m),
        "with sink": algebra.add_sink(algebra.determinize(m), ALPHABET),
        "reversed twice": m.reverse().reverse(),
        "trimmed": algebra.trim(m),
        "renumbered": m.renumber(),
        "lazy": Lazy.of(m).without_eps().determinized().renumbered().cached().materialized(),
    }
    rows = flags(lower_words(spark, sf_dir).select("x", "n"), "x", made)
    forms = F.array(*[F.when(F.col(f"`{k}`"), F.lit(k)) for k in made])
    return rows.select(F.explode(F.array_compact(forms)).alias("form"), "x", "n")


@query("SELECT DISTINCT p_type AS x, contains(p_type, 'TIN') AS inside, p_type = 'STANDARD ANODIZED TIN' AS equal FROM part")
def q54_language_predicates(spark, sf_dir):
    """For each part type whether its own language is a part of another, and whether it equals one; machines are made in the tasks."""
    anything = algebra.universal(string.ascii_uppercase + " ")
    inside = algebra.minimize(algebra.concat(algebra.concat(anything, algebra.from_string("TIN")), anything))
    shared = spark.sparkContext.broadcast((inside, algebra.from_strings(["STANDARD ANODIZED TIN"])))

    def run(batches):
        big, one = shared.value
        for batch in batches:
            own = [algebra.from_string(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([algebra.subset(m, big) for m in own], pa.bool_()), pa.array([algebra.equal(m, one) for m in own], pa.bool_())], names=["x", "inside", "equal"])

    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("x")).distinct().mapInArrow(run, "x string, inside boolean, equal boolean")


# Relations


@query(f"WITH {_WORDS} SELECT lower(word) AS x, count(*) = 1 AS functional, CAST(count(*) AS BIGINT) AS outputs FROM w GROUP BY 1")
def q55_functionality(spark, sf_dir):
    """The machine of each lower-case word's spellings: whether it is a function, checked by its witness if not, and how many outputs it has."""

    def run(batches):
        for batch in batches:
            functional, outputs = [], []
            for x, ys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = algebra.from_pairs([(x, y) for y in ys])
                witness = algebra.functional_witness(m)
                if witness is not None and ("".join(witness[0]) != x or witness[1] == witness[2] or not {"".join(witness[1]), "".join(witness[2])} <= set(ys)):
                    raise ValueError(f"{witness} is no witness for {x}")
                functional.append(witness is None)
                outputs.append(len(set(algebra.transduce(m, x))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(functional, pa.bool_()), pa.array(outputs, pa.int64())], names=["x", "functional", "outputs"])

    # a word of k letters has 2 ** k spellings at most; those that occur are few
    forms = words(spark, sf_dir).groupBy(F.lower("word").alias("x")).agg(F.collect_set("word").alias("ys"))
    return forms.mapInArrow(run, "x string, functional boolean, outputs long")


_TARGETS = ("ungood", "then", "aungoodb", "unde")


@query(f"WITH {_LOWER}, t AS (SELECT unnest({list(_TARGETS)!r}) AS y), u AS (SELECT DISTINCT replace(y, 'ungood', 'bad') AS x, y FROM t) SELECT x, y FROM u UNION SELECT l.x, t.y FROM l JOIN t ON replace(l.x, 'bad', 'ungood') = t.y")
def q56_cross_sections(spark, sf_dir):
    """Words with given outputs, by preimage machines, and the shortest member of each preimage."""
    m, rows, best = catalog.newspeak(), lower_words(spark, sf_dir).select("x"), []
    out = None
    for y in _TARGETS:
        back = preimage(m, y)
        best += [(("".join(x)), y) for x in [next(algebra.language(back, len(y)))]]
        one = flag_members(rows, back, "x", "hit").where("hit").select("x", F.lit(y).alias("y"))
        out = one if out is None else out.unionByName(one)
    return out.unionByName(spark.createDataFrame(best, "x string, y string")).distinct()


@query(f"WITH {_LOWER} SELECT x, replace(x, 'bad', 'ungood') AS y, replace(x, 'bad', 'ungood') AS z FROM l")
def q57_pushed_labels(spark, sf_dir):
    """A machine whose labels come early, and the composition of its pieces, give what the machine gives."""
    m = catalog.newspeak()
    copy = catalog.letters((c, c) for c in ALPHABET)
    rows = apply(lower_words(spark, sf_dir).select("x"), algebra.push_labels(m), "x", "y")
    return apply(rows, algebra.trim(algebra.compose(algebra.compose(copy, m), copy)).renumber(), "x", "z")


# Decomposition


@query(f"WITH {_LOWER}, y AS (SELECT x, replace(x, 'bad', 'ungood') AS y FROM l), k AS (SELECT x, y, unnest(range(0, least(length(y), 3))) AS k FROM y) SELECT left(y, CAST(k AS INT)) AS target, substr(y, CAST(k AS INT) + 1, 1) AS sym, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY ALL")
def q58_next_symbols_by_decomposition(spark, sf_dir):
    """How many words go on with each symbol after each target of up to two: decompositions of all next symbols, one from another.

    A task follows its words' own targets, so it decomposes those only.
    """
    shared = spark.sparkContext.broadcast(catalog.newspeak())

    def run(batches):
        root, known = Decomposition(shared.value), {}
        known[""] = root
        for batch in batches:
            target, sym = [], []
            for x in batch.column(0).to_pylist():
                here = ""
                while len(here) < 3:
                    d = known[here]
                    step = None
                    for y in sorted(next_symbols(d.m, d.target)):
                        if here + y not in known:
                            known[here + y] = d >> y
                        if known[here + y].part_of(x):
                            step = y
                            break
                    if step is None:
                        break
                    target.append(here)
                    sym.append(step)
                    here += step
            yield pa.RecordBatch.from_pydict({"target": pa.array(target, pa.string()), "sym": pa.array(sym, pa.string())})

    found = lower_words(spark, sf_dir).select("x").mapInArrow(run, "target string, sym string")
    return found.groupBy("target", "sym").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LOWER} SELECT x, starts_with(replace(x, 'bad', 'ungood'), t) AS inside, t AS target FROM l, (SELECT unnest(['u', 'un', 'ung', 'ungo', 'ungoo', 'ungood', 'ungooda']) AS t)")
def q59_longer_targets(spark, sf_dir):
    """Membership in the precover of ever longer targets, each decomposition made from the one before."""
    d, out, rows = Decomposition(catalog.newspeak()), None, lower_words(spark, sf_dir).select("x")
    for y in "ungooda":
        d = d >> y
        q = algebra.concat(d.quotient, anything()) if d.q_stops else algebra.zero()
        m = algebra.union(q, d.remainder) if d.r_stops else q
        one = flag_members(rows, algebra.minimize(m), "x", "inside").withColumn("target", F.lit("".join(d.target)))
        out = one if out is None else out.unionByName(one)
    return out


# Structure of machines


@query("WITH p AS (SELECT DISTINCT p_type AS t FROM part), a AS (SELECT DISTINCT left(t, CAST(k AS INT)) AS node FROM (SELECT t, unnest(range(0, length(t) + 1)) AS k FROM p)) SELECT CAST((SELECT count(*) FROM a) AS BIGINT) AS states, CAST((SELECT count(*) FROM a) - 1 AS BIGINT) AS arcs, CAST((SELECT count(*) FROM p) AS BIGINT) AS members")
def q60_type_trie(spark, sf_dir):
    """The trie of the part types, whose number does not grow with the data."""
    types = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_type").distinct()
    if types.count() > 100_000:
        raise ValueError("these strings are too many for one machine")
    m = algebra.from_strings([r[0] for r in types.collect()])
    n = sum(1 for _ in algebra.language(m, max(len(r[0]) for r in types.collect())))
    return spark.createDataFrame([(len(m.states), len(m.arcs), n)], "states long, arcs long, members long")


@query("SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ ]+')) AS BIGINT) AS n FROM documents")
def q61_separators(spark, sf_dir):
    """Runs of a mark become one separator; what it parts is counted."""
    parts = F.split(rewrite.separators(F.coalesce("text", F.lit("")), " ", "\x1f"), "\x1f")
    return corpora.documents(spark, sf_dir).select("doc_id", F.size(F.filter(parts, lambda p: p != "")).cast("long").alias("n"))
