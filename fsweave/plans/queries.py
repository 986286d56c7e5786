"""The registered queries of the library, each with its SQL where SQL can say it."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fsweave.functions import logmath, rewrite
from fsweave.operators import algebra, fixpoint, ngram, scoring
from fsweave.operators.apply import aggregate_column, apply, apply_all, filter_by_output, flag_members, flag_parts, relation_rows, totalized
from fsweave.plans.machine import EPS, Machine
from fsweave.plans.precover import Decomposition, regions, universal_states
from fsweave.sources import catalog, corpora

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_WORDS = "w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents) GROUP BY word)"
_LOWER = f"{_WORDS}, l AS (SELECT lower(word) AS x, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY 1)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, n): ASCII words and how often they occur.  Machines then run once for each word."""
    return corpora.ascii_words(corpora.documents(spark, sf_dir)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def lower_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, n): the lower-case machine's outputs."""
    return apply(words(spark, sf_dir), catalog.lowercase(), "word", "x").groupBy("x").agg(F.sum("n").alias("n"))


def over_letters(make: Callable[[str], Machine]) -> Machine:
    return make(string.ascii_letters)


# Application


@query(f"WITH {_WORDS} SELECT lower(word) AS x, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / (SELECT sum(n) FROM w), 9) AS p FROM w GROUP BY 1")
def q01_lowercase_pushforward(spark, sf_dir):
    out = lower_words(spark, sf_dir)
    total = out.agg(F.sum("n").alias("total"))
    return out.join(F.broadcast(total)).select("x", "n", F.round(F.col("n") / F.col("total"), 9).alias("p"))  # total is one row


@query(f"WITH {_WORDS} SELECT word, translate(word, '{string.ascii_letters}', '{string.ascii_letters.swapcase()}') AS y FROM w")
def q02_togglecase_apply(spark, sf_dir):
    return apply(words(spark, sf_dir).select("word"), catalog.togglecase(), "word", "y")


@query(f"WITH {_WORDS} SELECT word, translate(word, 'ab', 'A') AS y FROM w")
def q03_delete_symbol_apply(spark, sf_dir):
    m = catalog.letters((c, {"a": "A", "b": EPS}.get(c, c)) for c in string.ascii_letters)
    return apply(words(spark, sf_dir).select("word"), m, "word", "y")


@query(f"WITH {_LOWER} SELECT x, replace(x, 'bad', 'ungood') AS y FROM l")
def q04_newspeak_apply(spark, sf_dir):
    return apply(lower_words(spark, sf_dir).select("x"), catalog.newspeak(), "x", "y")


@query(f"WITH {_WORDS} SELECT word, CASE WHEN length(word) % 2 = 0 THEN '1' ELSE '0' END AS y FROM w")
def q05_parity_apply(spark, sf_dir):
    return apply(words(spark, sf_dir).select("word"), over_letters(catalog.parity), "word", "y")


@query(f"WITH {_WORDS} SELECT word, regexp_replace(word, '(.)', '\\1\\1', 'g') AS y FROM w")
def q06_duplicate_apply(spark, sf_dir):
    return apply(words(spark, sf_dir).select("word"), over_letters(catalog.duplicate), "word", "y")


_LINES = "SELECT DISTINCT CAST(l_linenumber AS VARCHAR) || ',' || l_returnflag || ',' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || ',,' AS x FROM lineitem"


@query(
    f"""WITH d AS ({_LINES}) SELECT x, array_to_string(list_transform(range(1, length(x) + 1),
    lambda i: substr(x, i, 1) || CASE WHEN substr(x, i, 1) = ',' AND i < length(x) AND substr(x, i + 1, 1) NOT BETWEEN '0' AND '9' THEN '|' ELSE '' END), '') AS y FROM d"""
)
def q07_comma_separator_apply(spark, sf_dir):
    text = F.concat(F.col("l_linenumber").cast("string"), F.lit(","), "l_returnflag", F.lit(","), F.col("l_quantity").cast("int").cast("string"), F.lit(",,"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(text.alias("x")).distinct()
    return apply(lines, catalog.comma_separator(string.ascii_uppercase), "x", "y")


_TICKS = "et" + "".join(c for c in string.ascii_lowercase if c not in "et")


@query(f"WITH {_LOWER}, t AS (SELECT DISTINCT translate(x, '{_TICKS}', 'a`') AS x FROM l) SELECT x, replace(replace(x, '``', '\"'), 'a', 'b') AS y FROM t")
def q08_backtick_apply(spark, sf_dir):
    ticks = lower_words(spark, sf_dir).select(F.translate("x", _TICKS, "a`").alias("x")).distinct()
    return apply(ticks, catalog.backticks(), "x", "y")


@query(f"WITH {_WORDS}, t AS (SELECT DISTINCT repeat('a', length(word)) AS x FROM w) SELECT x, CASE length(x) WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE repeat('b', length(x)) END AS y FROM t")
def q09_anbn_apply(spark, sf_dir):
    return apply(words(spark, sf_dir).select(F.expr("repeat('a', length(word))").alias("x")).distinct(), catalog.anbn(), "x", "y")


@query(f"WITH {_WORDS} SELECT word, CAST(length(word) % 3 AS VARCHAR) AS y FROM w")
def q10_mod3_apply(spark, sf_dir):
    return apply(words(spark, sf_dir).select("word"), over_letters(catalog.count_mod3), "word", "y")


def _containing(text: str, alphabet: str) -> Machine:
    anything = algebra.universal(alphabet)
    return algebra.concat(algebra.concat(anything, algebra.from_string(text)), anything)


@query(f"WITH {_LOWER} SELECT x, n FROM l WHERE contains(x, 'th') AND NOT contains(x, 'he')")
def q11_domain_filter(spark, sf_dir):
    m = algebra.difference(_containing("th", string.ascii_lowercase), _containing("he", string.ascii_lowercase))
    return flag_members(lower_words(spark, sf_dir), algebra.minimize(m), "x", "member").where("member").drop("member")


@query(f"WITH {_WORDS} SELECT word, CASE WHEN regexp_full_match(word, '[a-z]*') THEN replace(word, 'bad', 'ungood') ELSE 'FAIL' END AS y FROM w")
def q12_make_total(spark, sf_dir):
    m = algebra.make_total(catalog.newspeak().with_(reads=string.ascii_uppercase), "FAIL")
    return apply(words(spark, sf_dir).select("word"), m, "word", "y")


@query(f"WITH {_WORDS} SELECT word, coalesce(CASE WHEN NOT regexp_full_match(word, '[a-z]*') THEN 'FAIL' END, word) AS y FROM w")
def q12b_total_by_column(spark, sf_dir):
    m = catalog.letters((c, c) for c in string.ascii_lowercase)
    return apply(words(spark, sf_dir).select("word"), m, "word", "z").select("word", totalized(F.col("z"), "FAIL").alias("y"))


@query(f"WITH {_WORDS} SELECT word, replace(lower(word), 'bad', 'ungood') AS y FROM w")
def q13_compose_apply(spark, sf_dir):
    return apply_all(words(spark, sf_dir).select("word"), [catalog.lowercase(), catalog.newspeak()], "word", "y")


# Machines as tables: a forest of parts, each arc from a part to the part with an eighth of its key

_ARCS = "a AS (SELECT DISTINCT CAST(p_partkey AS INT) AS src, CASE WHEN p_size < 10 THEN '' ELSE p_brand END AS ilabel, left(p_type, 1) AS olabel, CAST(p_partkey // 8 AS INT) AS dst FROM part)"
_STATES = "s AS (SELECT state, state % 97 = 5 AS is_start, state IN (1, 3) AS is_final FROM (SELECT src AS state FROM a UNION SELECT dst FROM a))"


def part_machine(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    label = F.when(F.col("p_size") < 10, "").otherwise(F.col("p_brand"))
    arcs = part.select(F.col("p_partkey").cast("int").alias("src"), label.alias("ilabel"), F.left("p_type", F.lit(1)).alias("olabel"), F.floor(F.col("p_partkey") / 8).cast("int").alias("dst")).distinct()
    states = arcs.select(F.col("src").alias("state")).union(arcs.select("dst")).distinct()
    return arcs, states.select("state", (F.col("state") % 97 == 5).alias("is_start"), F.col("state").isin(1, 3).alias("is_final"))


_TOGGLE = f"c AS (SELECT unnest(string_split('{string.ascii_letters} ', '')) AS x)"


@query(f"WITH {_TOGGLE} SELECT 0 AS p, 0 AS q, f.x AS ilabel, translate(lower(f.x), '{string.ascii_lowercase}', '{string.ascii_uppercase}') AS olabel, 0 AS p2, 0 AS q2 FROM c f JOIN c g ON lower(f.x) = g.x")
def q14_compose_arcs(spark, sf_dir):
    return fixpoint.compose_arcs(catalog.lowercase().to_df(spark)[0], catalog.togglecase().to_df(spark)[0])


@query(f"WITH {_ARCS} SELECT DISTINCT src, olabel AS label, dst FROM a")
def q15_project_tape(spark, sf_dir):
    return fixpoint.project_arcs(part_machine(spark, sf_dir)[0], 1)


@query(f"WITH {_ARCS} SELECT src, olabel AS ilabel, ilabel AS olabel, dst FROM a")
def q16_transpose(spark, sf_dir):
    return fixpoint.transpose_arcs(part_machine(spark, sf_dir)[0])


_REACH = f"""{_ARCS}, {_STATES},
f(state) AS (SELECT state FROM s WHERE is_start UNION SELECT a.dst FROM f JOIN a ON a.src = f.state),
b(state) AS (SELECT state FROM s WHERE is_final UNION SELECT a.src FROM b JOIN a ON a.dst = b.state)"""


@query(f"WITH RECURSIVE {_REACH} SELECT state, 'forward' AS way FROM f UNION ALL SELECT state, 'backward' FROM b")
def q17_reachable(spark, sf_dir):
    arcs, states = part_machine(spark, sf_dir)
    ways = [fixpoint.reach(arcs, states, back).withColumn("way", F.lit("backward" if back else "forward")) for back in (False, True)]
    return ways[0].unionByName(ways[1])


@query(f"WITH RECURSIVE {_REACH} SELECT a.* FROM a WHERE src IN (SELECT f.state FROM f JOIN b USING (state)) AND dst IN (SELECT f.state FROM f JOIN b USING (state))")
def q18_trim_arcs(spark, sf_dir):
    return fixpoint.trim_arcs(*part_machine(spark, sf_dir))


@query(f"WITH RECURSIVE {_ARCS}, {_STATES}, e(src, dst) AS (SELECT state, state FROM s UNION SELECT e.src, a.dst FROM e JOIN a ON a.src = e.dst AND a.ilabel = '') SELECT * FROM e")
def q19_eps_closure(spark, sf_dir):
    return fixpoint.eps_pairs(*part_machine(spark, sf_dir))


_NEXT_SET = "(SELECT list(DISTINCT a.dst ORDER BY a.dst) FROM a WHERE list_contains(d.m, a.src) AND a.label = l.label)"


@query(
    f"""WITH RECURSIVE a AS (SELECT DISTINCT CAST(n_regionkey AS INT) AS src, CAST(length(n_name) % 3 AS VARCHAR) AS label, CAST(n_nationkey // 5 AS INT) AS dst FROM nation),
l AS (SELECT DISTINCT label FROM a), d(m) AS (SELECT [0] UNION SELECT n FROM (SELECT {_NEXT_SET} AS n FROM d, l) WHERE n IS NOT NULL)
SELECT array_to_string(m, ' ') AS members, label, array_to_string(n, ' ') AS next FROM (SELECT d.m, l.label, {_NEXT_SET} AS n FROM d, l) WHERE n IS NOT NULL"""
)
def q20_powerset_states(spark, sf_dir):
    """The subset construction of an automaton over regions, with the nations as arcs."""
    label = (F.length("n_name") % 3).cast("string")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    arcs = nation.select(F.col("n_regionkey").cast("int").alias("src"), label.alias("ilabel"), F.lit("").alias("olabel"), F.floor(F.col("n_nationkey") / 5).cast("int").alias("dst")).distinct()
    states = spark.range(5).select(F.col("id").cast("int").alias("state"), (F.col("id") == 0).alias("is_start"), F.lit(True).alias("is_final"))
    return fixpoint.subsets(arcs, states).select(F.array_join(F.col("members").cast("array<string>"), " ").alias("members"), "label", F.array_join(F.col("next").cast("array<string>"), " ").alias("next"))


@query("WITH RECURSIVE g(x) AS (SELECT '' UNION ALL SELECT x || c FROM g, (VALUES ('a'), ('b')) v(c) WHERE length(x) < 6) SELECT x, translate(x, 'ab', 'A') AS y FROM g")
def q21_relation_bounded(spark, sf_dir):
    m = catalog.delete_b()
    pairs = [("".join(x), "".join(y)) for x in algebra.language(m.project(0), 6) for y in algebra.transduce(m, x)]
    return spark.createDataFrame(pairs, "x string, y string")


_EN_FR = """e AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS x FROM documents WHERE lang = 'en'),
f AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS x FROM documents WHERE lang = 'fr')"""


@query(
    f"""WITH {_EN_FR} SELECT 'union' AS op, x FROM (SELECT x FROM e UNION SELECT x FROM f) UNION ALL SELECT 'intersect', x FROM (SELECT x FROM e INTERSECT SELECT x FROM f)
UNION ALL SELECT 'except', x FROM (SELECT x FROM e EXCEPT SELECT x FROM f) UNION ALL SELECT 'symdiff', x FROM ((SELECT x FROM e EXCEPT SELECT x FROM f) UNION (SELECT x FROM f EXCEPT SELECT x FROM e))"""
)
def q22_language_sets(spark, sf_dir):
    docs = corpora.documents(spark, sf_dir)
    sides = docs.where(F.col("lang").isin("en", "fr")).select("lang", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("w"))
    flags = sides.groupBy(F.lower("w").alias("x")).agg(F.bool_or(F.col("lang") == "en").alias("e"), F.bool_or(F.col("lang") == "fr").alias("f"))
    e, f = F.col("e"), F.col("f")
    ops = F.array(F.lit("union"), F.when(e & f, "intersect"), F.when(e & ~f, "except"), F.when(e != f, "symdiff"))
    return flags.select(F.explode(F.filter(ops, lambda o: o.isNotNull())).alias("op"), "x")


@query(
    f"""WITH {_LOWER}, b AS (SELECT x FROM l WHERE length(x) <= 2), k AS (SELECT x, unnest(range(1, length(x))) AS i FROM l WHERE length(x) > 1 AND TRUE)
SELECT 'derivative' AS op, substr(x, 3) AS y FROM l WHERE starts_with(x, 'th')
UNION ALL SELECT 'left', y FROM (SELECT DISTINCT substr(l.x, length(b.x) + 1) AS y FROM l JOIN b ON b.x = left(l.x, length(b.x)) AND length(b.x) = 1 UNION SELECT DISTINCT substr(l.x, 3) FROM l JOIN b ON b.x = left(l.x, 2) AND length(b.x) = 2)
UNION ALL SELECT 'right', y FROM (SELECT DISTINCT left(l.x, length(l.x) - 1) AS y FROM l JOIN b ON b.x = right(l.x, 1) AND length(b.x) = 1 UNION SELECT DISTINCT left(l.x, length(l.x) - 2) FROM l JOIN b ON b.x = right(l.x, 2) AND length(b.x) = 2 AND length(l.x) >= 2)"""
)
def q23_quotients(spark, sf_dir):
    x = lower_words(spark, sf_dir).select("x")
    b = x.where(F.length("x") <= 2).withColumnRenamed("x", "b")
    cut = x.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).where(F.length("x") >= F.col("k"))
    left = cut.select(F.expr("left(x, k)").alias("b"), F.expr("substr(x, k + 1)").alias("y")).join(b, "b", "left_semi").select(F.lit("left").alias("op"), "y").distinct()
    right = cut.select(F.expr("right(x, k)").alias("b"), F.expr("left(x, length(x) - k)").alias("y")).join(b, "b", "left_semi").select(F.lit("right").alias("op"), "y").distinct()
    return x.where(F.col("x").startswith("th")).select(F.lit("derivative").alias("op"), F.expr("substr(x, 3)").alias("y")).unionByName(left).unionByName(right)


@query(f"WITH {_WORDS} SELECT lower(word) AS x, count(DISTINCT word) AS outputs FROM w GROUP BY 1 HAVING count(DISTINCT word) > 1")
def q24_functionality_violations(spark, sf_dir):
    pairs = words(spark, sf_dir).select(F.lower("word").alias("x"), F.col("word").alias("y"))
    return pairs.groupBy("x").agg(F.countDistinct("y").alias("outputs")).where("outputs > 1")


@query("SELECT CAST(state AS INT) AS state, CAST(state % 3 AS INT) AS class FROM range(12) t(state)")
def q25_minimize_classes(spark, sf_dir):
    # twelve states that count symbols; three suffice to know the count mod 3
    m = Machine.acceptor([(i, c, (i + 1) % 12) for i in range(12) for c in "ab"], [0], [0, 3, 6, 9])
    arcs = spark.createDataFrame([(i, a, b, j) for i, a, b, j in m.arcs], "src int, ilabel string, olabel string, dst int")
    states = spark.createDataFrame([(i, i == 0, i % 3 == 0) for i in range(12)], "state int, is_start boolean, is_final boolean")
    return fixpoint.classes(arcs, states)


@query("SELECT * FROM (VALUES ('gated', 1), ('two_hubs', 2), ('hub_ring', 3), ('no_hub', 0), ('newspeak', 0), ('complementary', 0)) t(machine, universal)")
def q26_universal_states(spark, sf_dir):
    rows = []
    for name in ("gated", "two_hubs", "hub_ring", "no_hub", "complementary"):
        m = catalog.CATALOG[name]()
        arcs, states = m.to_df(spark)
        n = fixpoint.universal_arcs(arcs, states, len(m.reads)).count()
        rows.append((name, n))
    rows.append(("newspeak", len(universal_states(catalog.newspeak()))))
    return spark.createDataFrame(rows, "machine string, universal int")


# Decomposition


@query(f"WITH {_LOWER} SELECT x, n FROM l WHERE starts_with(replace(x, 'bad', 'ungood'), 'un')")
def q27_precover_filter(spark, sf_dir):
    return filter_by_output(lower_words(spark, sf_dir), catalog.newspeak(), "x", "un")


@query(f"WITH {_WORDS} SELECT word, 'th' AS target, CASE WHEN lower(word) LIKE 'th%' THEN 'Q' ELSE '' END AS part FROM w UNION ALL SELECT word, '1', CASE WHEN length(word) % 2 = 0 THEN 'R' ELSE '' END FROM w")
def q28_decomposition_members(spark, sf_dir):
    rows = words(spark, sf_dir).select("word")
    out = [flag_parts(rows, m, target, "word", "part").withColumn("target", F.lit(target)) for target, m in (("th", catalog.lowercase()), ("1", over_letters(catalog.parity)))]
    return out[0].unionByName(out[1])


_NEXT = "CASE WHEN length(y) = 2 THEN '<EOS>' ELSE substr(y, 3, 1) END"


@query(f"WITH {_LOWER}, t AS (SELECT replace(x, 'bad', 'ungood') AS y, n FROM l) SELECT {_NEXT} AS sym, CAST(sum(n) AS BIGINT) AS n FROM t WHERE starts_with(y, 'th') GROUP BY 1")
def q29_next_symbol_counts(spark, sf_dir):
    rows = apply(filter_by_output(lower_words(spark, sf_dir), catalog.newspeak(), "x", "th"), catalog.newspeak(), "x", "y")
    sym = F.when(F.length("y") == 2, ngram.EOS).otherwise(F.substring("y", 3, 1))
    return rows.groupBy(sym.alias("sym")).agg(F.sum("n").alias("n"))


# N-gram models

_GRAMS = """t AS (SELECT x, n, unnest(range(1, length(x) + 2)) AS k FROM l),
o AS (SELECT k, x, n, unnest(range(0, least(2, k - 1) + 1)) AS ord FROM t),
g AS (SELECT CAST(ord AS INT) AS ord, substr(x, k - ord, ord) AS ctx, CASE WHEN k = length(x) + 1 THEN '<EOS>' ELSE substr(x, k, 1) END AS sym, CAST(sum(n) AS BIGINT) AS cnt FROM o GROUP BY ALL)"""


def _letters(spark, sf_dir) -> DataFrame:
    """The letters of each word with the number of its occurrences."""
    return ngram.symbols(lower_words(spark, sf_dir), "x", F.col("x"), "n")


@query(f"WITH {_LOWER}, {_GRAMS} SELECT ord, ctx, sym, cnt FROM g")
def q30_ngram_counts(spark, sf_dir):
    return ngram.ngram_counts(_letters(spark, sf_dir), 3, weight="n")


@query(
    f"""WITH {_LOWER}, {_GRAMS}, a AS (SELECT DISTINCT sym FROM g), c AS (SELECT ord, ctx, sum(cnt) AS total FROM g GROUP BY ALL)
SELECT c.ord, c.ctx, a.sym, round(ln((coalesce(g.cnt, 0) + 0.5) / (c.total + 0.5 * (SELECT count(*) FROM a))), 6) AS logp FROM c CROSS JOIN a LEFT JOIN g ON g.ord = c.ord AND g.ctx = c.ctx AND g.sym = a.sym"""
)
def q31_ngram_logprob(spark, sf_dir):
    return ngram.smoothed(ngram.ngram_counts(_letters(spark, sf_dir), 3, weight="n"), 0.5).withColumn("logp", F.round("logp", 6))


@query(
    f"""WITH {_LOWER}, e AS (SELECT x, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS x FROM documents WHERE lang = 'en') GROUP BY 1),
t AS (SELECT x, n, unnest(range(1, length(x) + 2)) AS k FROM e), o AS (SELECT k, x, n, unnest(range(0, least(2, k - 1) + 1)) AS ord FROM t),
g AS (SELECT ord, substr(x, k - ord, ord) AS ctx, CASE WHEN k = length(x) + 1 THEN '<EOS>' ELSE substr(x, k, 1) END AS sym, CAST(sum(n) AS BIGINT) AS cnt FROM o GROUP BY ALL),
c AS (SELECT ord, ctx, sum(cnt) AS total FROM g GROUP BY ALL),
q AS (SELECT l.x, k, unnest(range(0, least(2, k - 1) + 1)) AS ord FROM (SELECT x, unnest(range(1, length(x) + 2)) AS k FROM l) l),
h AS (SELECT q.x, q.k, q.ord, c.total, coalesce(g.cnt, 0) AS cnt FROM q JOIN c ON c.ord = q.ord AND c.ctx = substr(q.x, q.k - q.ord, q.ord)
 LEFT JOIN g ON g.ord = q.ord AND g.ctx = c.ctx AND g.sym = CASE WHEN q.k = length(q.x) + 1 THEN '<EOS>' ELSE substr(q.x, q.k, 1) END),
m AS (SELECT x, k, arg_max(total, ord) AS total, arg_max(cnt, ord) AS cnt FROM h GROUP BY ALL)
SELECT x, round(sum(ln((cnt + 0.1) / (total + 2.7))), 5) AS logp FROM m GROUP BY x"""
)
def q32_ngram_backoff_score(spark, sf_dir):
    docs = corpora.documents(spark, sf_dir).where(F.col("lang") == "en")
    english = corpora.ascii_words(docs).groupBy(F.lower("word").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    counts = fixpoint.cut(ngram.ngram_counts(ngram.symbols(english, "x", F.col("x"), "n"), 3, weight="n"))
    return ngram.score(_letters(spark, sf_dir), "x", counts, 3, 0.1, 27).withColumn("logp", F.round("logp", 5))


_EVENTS = """e AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)"""


def event_sequences(spark, sf_dir) -> DataFrame:
    """(user_id, symbols): event types in order."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.struct("ts", "event_id", "event_type").alias("e"))
    return rows.groupBy("user_id").agg(F.array_sort(F.collect_list("e")).alias("e")).select("user_id", F.col("e.event_type").alias("symbols"))


@query(
    f"""WITH {_EVENTS}, b AS (SELECT prev, event_type, count(*) AS c FROM e WHERE prev IS NOT NULL GROUP BY ALL), t AS (SELECT prev, sum(c) AS t FROM b GROUP BY 1),
n AS (SELECT coalesce(count(*), 0) AS users FROM (SELECT DISTINCT user_id FROM events)), z AS (SELECT last AS prev, count(*) AS c FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1) GROUP BY 1),
u AS (SELECT event_type, count(*) AS c FROM events GROUP BY 1), a AS (SELECT sum(c) + (SELECT users FROM n) AS t FROM u)
SELECT user_id, round(sum(CASE WHEN e.prev IS NULL THEN ln(u.c / a.t) ELSE ln(b.c / (t.t + coalesce(z.c, 0))) END), 5) AS logp
FROM e LEFT JOIN b ON b.prev = e.prev AND b.event_type = e.event_type LEFT JOIN t ON t.prev = e.prev LEFT JOIN z ON z.prev = e.prev LEFT JOIN u ON u.event_type = e.event_type CROSS JOIN a GROUP BY user_id"""
)
def q33_sequence_logprob(spark, sf_dir):
    sequences = fixpoint.cut(event_sequences(spark, sf_dir))
    counts = fixpoint.cut(ngram.ngram_counts(sequences, 2, sep="\x1f"))
    return ngram.score(sequences, "user_id", counts, 2, 0.0, 6, sep="\x1f", end=False).withColumn("logp", F.round("logp", 5))


# Induced distributions

_OUT = f"{_LOWER}, y AS (SELECT replace(x, 'bad', 'ungood') AS y, sum(n) / (SELECT sum(n) FROM l) AS p FROM l GROUP BY 1)"


def outputs(spark, sf_dir) -> DataFrame:
    """(y, p): the distribution of outputs of the newspeak machine over the words."""
    rows = apply(lower_words(spark, sf_dir), catalog.newspeak(), "x", "y")
    total = rows.agg(F.sum("n").alias("t"))
    return scoring.pushforward(rows.join(F.broadcast(total)).select("y", (F.col("n") / F.col("t")).alias("p")), "y", "p")  # total is one row


@query(f"WITH {_OUT}, k AS (SELECT DISTINCT left(y, 2) AS prefix FROM y) SELECT prefix, round(sum(p), 9) AS mass FROM k JOIN y ON left(y, 2) = prefix OR (length(prefix) < 2 AND starts_with(y, prefix)) GROUP BY 1")
def q34_prefix_mass(spark, sf_dir):
    out = fixpoint.cut(outputs(spark, sf_dir))
    return scoring.prefix_mass(out, "y", "p", out.select(F.left("y", F.lit(2)).alias("prefix"))).withColumn("mass", F.round("mass", 9))


@query(f"WITH {_OUT}, t AS (SELECT {_NEXT} AS sym, sum(p) AS m FROM y WHERE starts_with(y, 'un') GROUP BY 1) SELECT sym, round(ln(m / (SELECT sum(m) FROM t)), 6) AS logp FROM t")
def q35_logp_next(spark, sf_dir):
    return scoring.next_symbol_table(outputs(spark, sf_dir), "y", "p", "un").select("sym", F.round(F.ln("p"), 6).alias("logp"))


@query(f"WITH {_OUT} SELECT y, round(p, 9) AS p FROM y")
def q36_exact_preimage_prob(spark, sf_dir):
    return outputs(spark, sf_dir).withColumn("p", F.round("p", 9))


@query(f"WITH {_LOWER}, v AS (SELECT x, n / (SELECT sum(n) FROM l) AS p FROM l) SELECT left(x, k) AS node, round(sum(p), 9) AS mass FROM (SELECT *, unnest(range(0, length(x) + 1)) AS k FROM v) GROUP BY 1")
def q37_trie_mass(spark, sf_dir):
    rows = lower_words(spark, sf_dir)
    total = rows.agg(F.sum("n").alias("t"))
    vocabulary = rows.join(F.broadcast(total)).select("x", F.ln(F.col("n") / F.col("t")).alias("logp"))  # total is one row
    return scoring.trie_mass(vocabulary, "x", "logp").withColumn("mass", F.round("mass", 9))


@query(f"WITH {_LOWER}, {_GRAMS} SELECT ord, ctx, sym, cnt, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ord, ctx ORDER BY cnt DESC, sym) AS r FROM g) WHERE r <= 3")
def q38_topk_next(spark, sf_dir):
    return logmath.top_k(ngram.ngram_counts(_letters(spark, sf_dir), 3, weight="n"), ["ord", "ctx"], "cnt", 3, ["sym"])


@query(f"WITH {_LOWER}, {_GRAMS}, b AS (SELECT ctx, arg_min(sym, (-cnt, sym)) AS sym FROM g WHERE ord = 1 GROUP BY 1) SELECT ctx, sym AS best FROM b")
def q38b_argmax_next(spark, sf_dir):
    counts = ngram.ngram_counts(_letters(spark, sf_dir), 2, weight="n").where("ord = 1")
    return counts.groupBy("ctx").agg(F.min_by("sym", F.struct((-F.col("cnt")).alias("neg"), "sym")).alias("best"))


@query(f"WITH {_LOWER} SELECT left(x, 3) AS node, CAST(length(x) AS INT) AS ctx, round(ln(sum(CAST(n AS DOUBLE))), 6) AS logw FROM l GROUP BY ALL")
def q39_beam_merge(spark, sf_dir):
    hyps = lower_words(spark, sf_dir).select(F.left("x", F.lit(3)).alias("node"), F.length("x").alias("ctx"), F.ln("n").alias("logw"))
    return scoring.merge_hypotheses(hyps, ["node", "ctx"], "logw").withColumn("logw", F.round("logw", 6))


@query(f"WITH {_LOWER}, h AS (SELECT left(x, 1) AS k, x, n, max(n) OVER (PARTITION BY left(x, 1)) AS top FROM l) SELECT k, x, n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, x) AS r FROM h WHERE n * 20 >= top) WHERE r <= 5")
def q39b_beam_prune(spark, sf_dir):
    hyps = lower_words(spark, sf_dir).select(F.left("x", F.lit(1)).alias("k"), "x", "n", F.ln("n").alias("logw"))
    return scoring.prune(hyps, ["k"], "logw", 5, 20.0 * (1 + 1e-12), ["x"]).select("k", "x", "n")


@query(
    """SELECT * FROM (VALUES ('two_hubs', 'h0', 'hub'), ('two_hubs', 'h1', 'hub'), ('escaping_hub', 'r', 'hub'), ('escaping_hub', 'A', 'hub'), ('escaping_hub', 'B', 'hub'), ('escaping_hub', 'C', 'corridor'),
('escaping_hub', 'D', 'corridor'), ('escaping_hub', 'E', 'hub'), ('no_hub', '0', 'corridor'), ('no_hub', '1', 'corridor'), ('torn_hub', '0', 'plateau'), ('hub_ring', '0', 'hub'), ('hub_ring', '1', 'hub'), ('hub_ring', '2', 'hub')) t(machine, state, region)"""
)
def q40_region_labels(spark, sf_dir):
    rows = [(name, str(q), kind) for name in ("two_hubs", "escaping_hub", "no_hub", "torn_hub", "hub_ring") for q, kind in regions(catalog.CATALOG[name]()).items()]
    return spark.createDataFrame(rows, "machine string, state string, region string")


@query(f"WITH {_LOWER} SELECT x AS token, x AS spelling FROM l")
def q40b_hub_vocab(spark, sf_dir):
    """The vocabulary of a token machine's hub, from its arc table: tokens join the paths that spell them."""
    v = lower_words(spark, sf_dir).select(F.col("x").alias("token"), F.col("x").alias("spelling"))
    arcs = fixpoint.vocabulary_arcs(v)
    entries = arcs.where(F.col("ilabel") != "").select(F.col("ilabel").alias("token"), F.col("src").alias("spelling"), "dst")
    return entries.groupBy("token").agg(F.min("spelling").alias("spelling"), F.countDistinct("spelling", "dst").alias("ways")).where("ways = 1").select("token", "spelling")


# Rewriting


def _detokenize_sql(column: str) -> str:
    for kind, a, b in rewrite.DETOKENIZE:
        quote = lambda t: "'" + t.replace("'", "''") + "'"
        if kind == "text":
            column = f"replace({column}, {quote(a)}, {quote(b)})"
        else:
            column = f"regexp_replace({column}, {quote(a)}, {quote(b.replace('$1', chr(92) + '1'))}, 'g')"
    return column


@query(f"SELECT doc_id, md5({_detokenize_sql('text')}) AS digest FROM documents")
def q41_detokenize(spark, sf_dir):
    return corpora.documents(spark, sf_dir).select("doc_id", F.md5(rewrite.detokenize(F.col("text")).cast("binary")).alias("digest"))


@query()
def q41b_treebank_tokens(spark, sf_dir):
    tokens = corpora.documents(spark, sf_dir).select(F.explode(rewrite.treebank_tokens(F.col("text"))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH t AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS k FROM embeddings), m AS (SELECT vec_id, max(v) AS m FROM t GROUP BY 1),
z AS (SELECT t.vec_id, m + ln(sum(exp(v - m))) AS z FROM t JOIN m USING (vec_id) GROUP BY t.vec_id, m)
SELECT vec_id, CAST(k AS INT) AS k, round(v - z, 5) AS logp FROM t JOIN z USING (vec_id)"""
)
def q42_log_softmax(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", F.posexplode(logmath.log_softmax(F.col("embedding"))).alias("k", "logp")).withColumn("logp", F.round("logp", 5))


# Search and sampling


def _memoryless() -> ngram.FiniteModel:
    """Strings over a, b, c with probability .5, .4, .1 a symbol and the end .2, up to length 6, normalized."""
    p, level = {}, {(): 1.0}
    share = {"a": 0.5, "b": 0.4, "c": 0.1}
    for _ in range(7):
        p |= {x: w * 0.2 for x, w in level.items()}
        level = {(*x, a): w * 0.8 * q for x, w in level.items() for a, q in share.items()}
    total = sum(p.values())
    return ngram.FiniteModel({x: w / total for x, w in p.items()})


_STRINGS = "WITH RECURSIVE g(x, w) AS (SELECT '', CAST(1 AS DOUBLE) UNION ALL SELECT x || c, w * 0.8 * p FROM g, (VALUES ('a', CAST(0.5 AS DOUBLE)), ('b', 0.4), ('c', 0.1)) v(c, p) WHERE length(x) < 6)"


@query(f"{_STRINGS} SELECT 'ac' AS source, 'Q' AS part, round(ln(sum(CASE WHEN starts_with(x, 'ac') THEN w END) / sum(w)), 9) AS logw FROM g")
def q43_enumerate_best_sources(spark, sf_dir):
    found = scoring.enumerate_sources(catalog.letters(zip("abc", "xyz")), _memoryless(), "xz", 200)
    return spark.createDataFrame([("".join(x), part, round(float(w), 9)) for x, part, w in found], "source string, part string, logw double")


@query()
def q43b_importance_estimate(spark, sf_dir):
    """Seeded walks in parallel; the mean of exp(logw) estimates the prefix probability."""
    import pandas as pd

    shared = spark.sparkContext.broadcast((catalog.letters(zip("abc", "xyz")), _memoryless()))

    def run(batches):
        import numpy as np

        m, model = shared.value
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "logw": [scoring.importance_weight(m, model, "xz", np.random.default_rng([7, int(i)])) for i in pdf["id"]]})

    walks = spark.range(0, 2000, 1, 8).mapInPandas(run, "id long, logw double")
    return walks.agg(F.count(F.lit(1)).alias("walks"), F.avg(F.exp("logw")).alias("estimate"))


@query("SELECT * FROM (VALUES ('', 'A', round(ln(6 / 7), 6)), ('', '<EOS>', round(ln(1 / 7), 6)), ('A', 'A', round(ln(6 / 7), 6)), ('A', '<EOS>', round(ln(1 / 7), 6)), ('AA', 'A', round(ln(6 / 7), 6)), ('AA', '<EOS>', round(ln(1 / 7), 6))) t(target, sym, logp)")
def q44_induced_model(spark, sf_dir):
    """P(a) .6, P(b) .3, end .1 through the machine that deletes b: 6/7 and 1/7 at every step."""
    class Memoryless:
        eos = ngram.EOS
        share = {"a": 0.6, "b": 0.3, ngram.EOS: 0.1}

        def logp(self, ctx, x):
            import math

            return math.log(self.share[x])

    model = scoring.OutputModel(catalog.delete_b(), Memoryless(), expansions=3000)
    rows = [(t, y, round(lp, 6)) for t in ("", "A", "AA") for y, lp in model.logp_next(t).items()]
    return spark.createDataFrame(rows, "target string, sym string, logp double").where("sym <> 'b'")


_SPOKEN = "s AS (SELECT conv_id, string_agg(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '' ORDER BY turn, text) AS t FROM conversations GROUP BY 1)"


@query(f"WITH {_SPOKEN} SELECT CAST(conv_id AS VARCHAR) AS key, CAST(length(t) AS BIGINT) AS n, md5(upper(t)) AS written FROM s WHERE length(t) > 0")
def q45_follow_symbols(spark, sf_dir):
    """The letters of each conversation, one after another, through a machine in one keyed pass; what it wrote is compared by digest."""
    from fsweave.streaming.incremental import follow_batch

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("string").alias("key"), "turn", "text")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("turn", "text"))
    letters = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", "")
    rows = turns.select("key", rank.alias("at"), letters.alias("x")).where("x <> ''")
    symbols = rows.select("key", "at", F.posexplode(F.split("x", "")).alias("k", "symbol"))
    seq = F.col("at").cast("long") * (1 << 32) + F.col("k")
    done = follow_batch(symbols.select("key", seq.alias("seq"), "symbol"), catalog.letters((c, c.upper()) for c in string.ascii_lowercase))
    return done.select("key", "n", F.md5(F.col("written").cast("binary")).alias("written"))


@query(f"WITH {_WORDS} SELECT word, word AS y FROM w WHERE regexp_full_match(word, '[a-z]*') UNION ALL SELECT word, upper(word) FROM w WHERE regexp_full_match(word, '[a-z]*')")
def q46_relation_rows(spark, sf_dir):
    both = algebra.union(catalog.letters((c, c) for c in string.ascii_lowercase), catalog.letters((c, c.upper()) for c in string.ascii_lowercase))
    return relation_rows(words(spark, sf_dir).select("word"), both, "word", "y")


@query(f"WITH {_LOWER} SELECT DISTINCT left(x, k - 1) AS prefix, substr(x, k, 1) AS label, left(x, k) AS next FROM (SELECT x, unnest(range(1, length(x) + 1)) AS k FROM l)")
def q47_trie_arcs(spark, sf_dir):
    return fixpoint.trie_arcs(lower_words(spark, sf_dir), "x")


@query("SELECT n_nationkey, CAST(k - 1 AS INT) AS src, substr(n_name, k, 1) AS label, CAST(k AS INT) AS dst FROM (SELECT *, unnest(range(1, length(n_name) + 1)) AS k FROM nation)")
def q48_string_arcs(spark, sf_dir):
    return fixpoint.string_arcs(spark.read.parquet(f"{sf_dir}/nation.parquet"), "n_name", "n_nationkey")


@query("SELECT conv_id, bool_and(coalesce(prev <> role, TRUE)) AS alternates FROM (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY conv_id")
def q49_role_sequences(spark, sf_dir):
    """Which conversations an acceptor of alternating roles takes, roles named by one letter each."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.struct("turn", "role").alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.substring(t["role"], 1, 1)), "")
    m = Machine.acceptor([(i, c, c) for c in "usat" for i in ("", *"usat") if i != c], [""], ["", *"usat"])
    return rows.groupBy("conv_id").agg(text.alias("x")).select("conv_id", aggregate_column(m, F.col("x")).isNotNull().alias("alternates"))

