"""Products, functionality and components of machines that are tables of arcs, for machines too large for one process.

Arcs are (src, ilabel, olabel, dst), states (state, is_start, is_final); the empty label
is silent.  States may have any type that can be a join key.  Everything grows from a
frontier, so only what can be reached is ever made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fsweave.operators.fixpoint import PARTS, cut, fixpoint

# Composition


def compose_silent(f: DataFrame, f_states: DataFrame, g: DataFrame, g_states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs and states of ``f`` followed by ``g``, where either may write or read nothing.

    A state is (p, q, turn).  Where f writes nothing or g reads nothing, each may move
    alone, or both at once; so that a pair of paths is not met in several orders, both
    move together first (turn 0), and then one of them alone, f (turn 1) or g (turn 2),
    until they meet at a label again.
    """
    left = f.select(F.col("src").alias("p"), "ilabel", F.col("olabel").alias("mid"), F.col("dst").alias("p2"))
    right = g.select(F.col("src").alias("q"), F.col("ilabel").alias("mid"), "olabel", F.col("dst").alias("q2"))
    loud, quiet = left.where("mid <> ''"), left.where("mid = ''").drop("mid")
    heard, unheard = right.where("mid <> ''"), right.where("mid = ''").drop("mid")

    def moves(new: DataFrame) -> DataFrame:
        """(p, q, turn, ilabel, olabel, p2, q2, turn2) out of states."""
        columns = ["p", "q", "turn", "ilabel", "olabel", "p2", "q2", "turn2"]
        meet = new.join(loud, "p").join(heard, ["q", "mid"]).withColumn("turn2", F.lit(0))
        both = new.where("turn = 0").join(quiet, "p").join(unheard, "q").withColumn("turn2", F.lit(0))
        one = new.where("turn <> 2").join(quiet, "p").withColumns({"olabel": F.lit(""), "q2": F.col("q"), "turn2": F.lit(1)})
        other = new.where("turn <> 1").join(unheard, "q").withColumns({"ilabel": F.lit(""), "p2": F.col("p"), "turn2": F.lit(2)})
        out = meet.select(*columns)
        for part in (both, one, other):
            out = out.unionByName(part.select(*columns))
        return out

    starts = f_states.where("is_start").select(F.col("state").alias("p")).join(g_states.where("is_start").select(F.col("state").alias("q")))  # starts are few
    pairs = fixpoint(starts.select("p", "q", F.lit(0).alias("turn")), lambda new: moves(new).select(F.col("p2").alias("p"), F.col("q2").alias("q"), F.col("turn2").alias("turn")))
    arcs = moves(pairs).select(F.struct("p", "q", "turn").alias("src"), "ilabel", "olabel", F.struct(F.col("p2").alias("p"), F.col("q2").alias("q"), F.col("turn2").alias("turn")).alias("dst"))
    ends = lambda s, name, at: s.where(name).select(F.col("state").alias(at), F.lit(True).alias(f"{name}_{at}"))
    states = pairs
    for s, at in ((f_states, "p"), (g_states, "q")):
        states = states.join(ends(s, "is_start", at), at, "left").join(ends(s, "is_final", at), at, "left")
    both = lambda name: F.coalesce(F.col(f"{name}_p") & F.col(f"{name}_q"), F.lit(False))
    states = states.select(F.struct("p", "q", "turn").alias("state"), (both("is_start") & (F.col("turn") == 0)).alias("is_start"), both("is_final").alias("is_final"))
    return arcs.distinct(), states


# Functionality


def conflicts(arcs: DataFrame, states: DataFrame, first: bool = True) -> DataFrame:
    """(p, q, left, right): pairs of states that prove a machine to have two outputs for one input; none if it is a function.

    Pairs of states that one input leads to are searched, with what either side has written
    beyond the other (its lead).  In a function a pair from which both sides can end
    together has one lead, so a pair's first lead is followed, and a second one proves the
    conflict, as do outputs that part, or a lead that is left at the end.  Leads are compared by
    aggregation for each pair.  With ``first`` the search is over as soon as a round finds
    a conflict; without, it goes on from the other pairs, so that every conflict that does
    not follow from one before it is found.
    """
    both = arcs.select("src", "ilabel", "olabel", "dst")
    left = both.select(F.col("src").alias("p"), F.col("ilabel").alias("a"), F.col("olabel").alias("u"), F.col("dst").alias("p2"))
    right = both.select(F.col("src").alias("q"), F.col("ilabel").alias("a"), F.col("olabel").alias("v"), F.col("dst").alias("q2"))
    stay = F.lit("")

    def moves(new: DataFrame) -> DataFrame:
        keep = [c for c in new.columns if c not in ("p", "q")]
        columns = ["p", "q", *keep, "u", "v", "p2", "q2"]
        read = new.join(left.where("a <> ''"), "p").join(right.where("a <> ''"), ["q", "a"]).select(*columns)
        one = new.join(left.where("a = ''"), "p").withColumns({"v": stay, "q2": F.col("q")}).select(*columns)
        other = new.join(right.where("a = ''"), "q").withColumns({"u": stay, "p2": F.col("p")}).select(*columns)
        return read.unionByName(one).unionByName(other)

    start = states.where("is_start").select(F.col("state").alias("p"))
    begin = start.join(start.select(F.col("p").alias("q")))  # starts are few
    found = fixpoint(begin, lambda new: moves(new).select(F.col("p2").alias("p"), F.col("q2").alias("q")))
    edges = cut(moves(found).distinct())
    end = states.where("is_final").select("state")
    ends = found.join(end.withColumnRenamed("state", "p"), "p", "left_semi").join(end.withColumnRenamed("state", "q"), "q", "left_semi").select("p", "q")
    back = edges.select(F.col("p2").alias("p"), F.col("q2").alias("q"), F.col("p").alias("p1"), F.col("q").alias("q1"))
    live = fixpoint(ends, lambda new: new.join(back, ["p", "q"]).select(F.col("p1").alias("p"), F.col("q1").alias("q")))
    edges = cut(edges.join(live.select(F.col("p").alias("p2"), F.col("q").alias("q2")), ["p2", "q2"], "left_semi"))
    new = cut(begin.join(live, ["p", "q"], "left_semi").select("p", "q", F.lit("").alias("left"), F.lit("").alias("right")))
    lead = lambda a, b: F.when(F.startswith(a, F.col(b)), F.expr(f"substring({a}, length({b}) + 1)")).otherwise(F.when(F.startswith(b, F.col(a)), "").otherwise(F.col(a)))
    parts, wrong = [new], []
    at_end = ends.withColumn("ends", F.lit(True))
    while True:
        moved = new.join(edges, ["p", "q"]).select(F.col("p2").alias("p"), F.col("q2").alias("q"), F.concat("left", "u").alias("l"), F.concat("right", "v").alias("r"))
        parted = ~(F.startswith("l", F.col("r")) | F.startswith("r", F.col("l")))
        leads = moved.select("p", "q", lead("l", "r").alias("left"), lead("r", "l").alias("right"), parted.alias("parted")).distinct()
        known = union_of(parts).select("p", "q", F.struct("left", "right").alias("before"))
        groups = leads.groupBy("p", "q").agg(F.min(F.struct("left", "right")).alias("low"), F.max(F.struct("left", "right")).alias("high"), F.max("parted").alias("parted"))
        groups = groups.join(known, ["p", "q"], "left").join(at_end, ["p", "q"], "left")
        bad = F.col("parted") | (F.col("low") != F.col("high")) | F.coalesce(F.col("low") != F.col("before"), F.lit(False))
        bad = bad | (F.coalesce("ends", F.lit(False)) & ((F.col("low.left") != "") | (F.col("low.right") != "")))
        round_ = cut(groups.select("p", "q", "low.*", bad.alias("bad"), F.col("before").isNull().alias("fresh")))
        wrong.append(round_.where("bad").select("p", "q", "left", "right"))
        new = round_.where("fresh AND NOT bad").select("p", "q", "left", "right")
        if new.isEmpty() or (first and not wrong[-1].isEmpty()):
            return union_of(wrong).distinct()
        parts = [cut(union_of([*parts, new]))] if len(parts) >= PARTS else [*parts, new]


def union_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Components


def components(arcs: DataFrame, states: DataFrame) -> DataFrame:
    """(state, component, cyclic): strongly connected components by colouring, each named by its smallest state.

    States without arcs in or out among those left are components by themselves and go
    first, again and again.  The others take the smallest state that reaches them as
    their colour; what reaches that state within the colour is its component.  The
    states settled go, and the search is repeated on the rest.  ``cyclic``: more than one
    state, or an arc to itself.
    """
    hop = cut(arcs.select("src", "dst").where("src <> dst").distinct())
    loops = arcs.where("src = dst").select(F.col("src").alias("state")).distinct()
    rest = cut(states.select("state").distinct())
    settled: list[DataFrame] = []
    while not rest.isEmpty():
        trivial = rest.join(hop.select(F.col("src").alias("state")), "state", "left_anti").unionByName(rest.join(hop.select(F.col("dst").alias("state")), "state", "left_anti")).distinct()
        trivial = cut(trivial)
        if not trivial.isEmpty():
            settled.append(trivial.select("state", F.col("state").alias("component"), F.lit(1).alias("n")))
            gone = trivial
        else:
            colour = cut(rest.select("state", F.col("state").alias("colour")))
            while True:
                come = hop.join(colour.withColumnRenamed("state", "src"), "src").select(F.col("dst").alias("state"), "colour")
                better = colour.unionByName(come).groupBy("state").agg(F.min("colour").alias("colour"))
                better = cut(better)
                same = better.join(colour, ["state", "colour"], "left_anti").isEmpty()
                colour = better
                if same:
                    break
            inside = hop.join(colour.withColumnRenamed("state", "src").withColumnRenamed("colour", "c1"), "src").join(colour.withColumnRenamed("state", "dst"), "dst").where("c1 = colour").select("src", F.col("dst").alias("state"), "colour")
            inside = cut(inside)
            roots = colour.where("state = colour").select("state", "colour")
            back = fixpoint(roots, lambda new, inside=inside: new.join(inside, ["state", "colour"]).select(F.col("src").alias("state"), "colour"))
            sizes = back.groupBy("colour").agg(F.count(F.lit(1)).alias("n"))
            done = cut(back.join(sizes, "colour").select("state", F.col("colour").alias("component"), "n"))
            settled.append(done)
            gone = done.select("state")
        rest = cut(rest.join(gone, "state", "left_anti"))
        hop = cut(hop.join(rest.withColumnRenamed("state", "src"), "src", "left_semi").join(rest.withColumnRenamed("state", "dst"), "dst", "left_semi"))
    out = union_of([states.select("state", F.col("state").alias("component"), F.lit(1).alias("n")).limit(0), *settled])
    return out.join(loops.withColumn("loop", F.lit(True)), "state", "left").select("state", "component", ((F.col("n") > 1) | F.coalesce("loop", F.lit(False))).alias("cyclic"))


def endless(arcs: DataFrame, states: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(state, cyclic, finite): whether a state lies on a cycle, and whether only finitely many paths leave it."""
    parts = components(arcs, states) if parts is None else parts
    back = cut(arcs.select(F.col("dst").alias("state"), F.col("src").alias("to")).distinct())
    into = fixpoint(parts.where("cyclic").select("state"), lambda new: new.join(back, "state").select(F.col("to").alias("state")))
    return parts.join(into.withColumn("goes_on", F.lit(True)), "state", "left").select("state", "component", "cyclic", F.col("goes_on").isNull().alias("finite"))
