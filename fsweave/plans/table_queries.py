"""Registered queries of operators that keep their whole state in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fsweave.operators import beams, graphs, ngram
from fsweave.operators.fixpoint import cut
from fsweave.operators.precovers import Precovers
from fsweave.plans.queries import _LOWER, lower_words, query
from fsweave.sources import catalog, corpora

# Beam decoding: words with a sign after them, cut into tokens of one, two and three letters

_MARKED = "[A-Za-z]+[,.;:!?]?"


def marked_words(spark, sf_dir) -> DataFrame:
    """(letters, sign, n): words, the sign after them or nothing, and how often they occur."""
    found = corpora.documents(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(_MARKED), 0)).alias("word"))
    counted = found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.regexp_extract("word", "^[A-Za-z]+", 0).alias("letters"), F.regexp_extract("word", "[,.;:!?]$", 0).alias("sign"), "n")


def token_sequences(words: DataFrame, sizes=(1, 2, 3)) -> DataFrame:
    """(symbols, n): each word in tokens of one size, once for each size; a sign is a token of its own."""
    rows = words.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    starts = F.sequence(F.lit(1), F.length("letters"), F.col("size"))
    tokens = F.transform(starts, lambda i: F.substring("letters", i, F.col("size")))
    return rows.select(F.when(F.col("sign") == "", tokens).otherwise(F.array_append(tokens, F.col("sign"))).alias("symbols"), "n")


def spelling_tables(spark, sf_dir) -> tuple[DataFrame, beams.HubTables]:
    """The words, and the machine that writes letters in lower case and signs not at all, under a bigram model of tokens."""
    words = cut(marked_words(spark, sf_dir))
    model = cut(beams.context_model(ngram.ngram_counts(token_sequences(words), 2, " ", "n"), 2))
    tokens = model.where(F.col("to").isNotNull()).select("token").distinct()
    sign = F.col("token").rlike("^[^A-Za-z]")
    moves = tokens.select(F.lit("word").alias("state"), "token", F.when(sign, "").otherwise(F.lower("token")).alias("spelling"), F.when(sign, "end").otherwise("word").alias("next"))
    return words, beams.HubTables(moves, model, ["word"], ["word", "end"])


_TOKENS = f"""w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_MARKED}')) AS word FROM documents) GROUP BY word),
c AS (SELECT regexp_extract(word, '^[A-Za-z]+') AS l, regexp_extract(word, '[,.;:!?]$') AS q, n FROM w),
t AS (SELECT list_concat(list_transform(range(1, length(l) + 1, s), lambda i: substr(l, i, s)), CASE WHEN q = '' THEN [] ELSE [q] END) AS toks, n FROM c, range(1, 4) r(s)),
b AS (SELECT unnest(list_prepend('<S>', toks)) AS prev, unnest(list_append(toks, '<EOS>')) AS tok, n FROM t),
g AS (SELECT '' AS ctx, tok, sum(n) AS c FROM b GROUP BY tok UNION ALL SELECT prev, tok, sum(n) FROM b WHERE prev <> '<S>' GROUP BY ALL),
m AS (SELECT ctx, tok, c / sum(c) OVER (PARTITION BY ctx) AS p FROM g),
s AS (SELECT ctx, tok, lower(tok) AS sp, p FROM m WHERE regexp_matches(tok, '^[A-Za-z]')),
e AS (
  SELECT m.ctx, sum(CASE WHEN m.tok = '<EOS>' THEN m.p ELSE m.p * z.p END) AS p FROM m LEFT JOIN m AS z ON z.ctx = m.tok AND z.tok = '<EOS>' WHERE m.tok = '<EOS>' OR regexp_matches(m.tok, '^[^A-Za-z<]') GROUP BY m.ctx),
x AS (SELECT DISTINCT lower(l) AS x FROM c),
a(x, k, wait, ctx, p) AS (
  SELECT x, 0, 0, '', 1.0::DOUBLE FROM x
  UNION ALL
  SELECT x, k + 1, wait, ctx, sum(p) FROM (
    SELECT x, k, wait - 1 AS wait, ctx, p FROM a WHERE wait > 0
    UNION ALL
    SELECT f.x, f.k, f.len - 1, s.tok, f.p * s.p FROM (SELECT x, k, ctx, p, len FROM a, (VALUES (1), (2), (3)) v(len) WHERE wait = 0 AND k + len <= length(x)) f
    JOIN s ON s.ctx = f.ctx AND s.sp = substr(f.x, f.k + 1, f.len) AND length(s.sp) = f.len) GROUP BY x, k, wait, ctx)"""


@query(
    f"""WITH RECURSIVE {_TOKENS},
h AS (SELECT ctx, left(sp, j) AS pre, sum(p) AS mass FROM s, range(1, 3) r(j) WHERE j < length(sp) GROUP BY ALL),
y AS (
  SELECT x, sum(CASE WHEN k = length(x) THEN a.p ELSE a.p * mass END) AS starts, sum(CASE WHEN k = length(x) THEN a.p * e.p END) AS whole
  FROM a LEFT JOIN h ON k < length(x) AND h.ctx = a.ctx AND h.pre = substr(x, k + 1) LEFT JOIN e ON k = length(x) AND e.ctx = a.ctx WHERE wait = 0 GROUP BY x)
SELECT x, round(ln(starts), 6) AS starts, round(ln(whole), 6) AS whole FROM y"""
)
def q62_beams_of_words(spark, sf_dir):
    """For each word in lower case, the log probabilities that an output starts with it and that it is the output, by beams over all words at once."""
    words, tables = spelling_tables(spark, sf_dir)
    targets = words.select(F.lower("letters").alias("x")).distinct()
    found = beams.decode(targets, "x", tables)
    ends = found.logprob().select(F.col("prefix").alias("x"), F.round("logp", 6).alias("whole"))
    return targets.join(found.logprefix().select(F.col("prefix").alias("x"), F.round("logp", 6).alias("starts")), "x").join(ends, "x", "left").select("x", "starts", "whole")


# Decompositions of all prefixes of all words at once, under the machine that writes bad as ungood

#: Sources that write a start of ``y`` and go on, with how far what they have written is settled.
_SOURCES = """v(y, k, x) AS (
  SELECT y, 0, '' FROM y
  UNION ALL
  SELECT y, CAST(k + step AS INT), x || put FROM (
    SELECT y, k, x, 1 AS step, substr(y, k + 1, 1) AS put FROM v WHERE k < length(y)
    UNION ALL
    SELECT y, k, x, least(6, length(y) - k), 'bad' FROM v WHERE k < length(y) AND starts_with('ungood', substr(y, k + 1, 6)))),
o AS (SELECT DISTINCT y, x FROM v WHERE k = length(y)),
c AS (
  SELECT y, x FROM o UNION SELECT y, x || chr(c::INT) FROM o, range(97, 123) l(c) WHERE regexp_matches(x, 'ba?$')
  UNION SELECT y, x || 'a' || chr(c::INT) FROM o, range(97, 123) l(c) WHERE ends_with(x, 'b')),
d AS (SELECT y, x, starts_with(replace(regexp_replace(x, 'ba?$', ''), 'bad', 'ungood'), y) AS settled, starts_with(replace(x, 'bad', 'ungood'), y) AS inside FROM c),
f AS (
  SELECT y, x, CASE WHEN settled THEN 'Q' ELSE 'R' END AS part FROM d
  WHERE inside AND NOT exists(SELECT 1 FROM (SELECT unnest(range(0, length(x))) AS k) WHERE starts_with(replace(regexp_replace(left(x, CAST(k AS INT)), 'ba?$', ''), 'bad', 'ungood'), y)))"""


@query(
    f"""WITH RECURSIVE {_LOWER}, y AS (SELECT DISTINCT left(x, CAST(k AS INT)) AS y FROM (SELECT x, unnest(range(0, length(x) + 1)) AS k FROM l)), {_SOURCES}
SELECT y AS target, count(*) FILTER (part = 'Q') AS n_q, count(*) FILTER (part = 'R') AS n_r, min(x) FILTER (part = 'Q') AS first_q, max(x) FILTER (part = 'Q') AS last_q,
  max(x) FILTER (part = 'R') AS last_r, max(x) FILTER (replace(x, 'bad', 'ungood') = y) AS exact FROM f GROUP BY y"""
)
def q63_decompositions(spark, sf_dir):
    """Q, R and the source of each start of each word, every longer target made from the pairs of the shorter one."""
    made = Precovers(spark, catalog.newspeak()).decompose(lower_words(spark, sf_dir).select("x"), "x")
    whole = made.exact().groupBy("target").agg(F.max("source").alias("exact"))
    q, r = (F.when(F.col("part") == p, F.col("source")) for p in "QR")
    parts = made.parts().groupBy("target").agg(F.count(q).alias("n_q"), F.count(r).alias("n_r"), F.min(q).alias("first_q"), F.max(q).alias("last_q"), F.max(r).alias("last_r"))
    return parts.join(whole, "target", "left").select("target", "n_q", "n_r", "first_q", "last_q", "last_r", "exact")


@query(
    f"""WITH RECURSIVE {_LOWER}, t AS (SELECT DISTINCT left(x, 4) AS t FROM l), y AS (SELECT t || chr(c::INT) AS y FROM t, range(97, 123) l(c)), {_SOURCES}
SELECT left(y, length(y) - 1) AS target, right(y, 1) AS sym, count(*) FILTER (part = 'Q') AS n_q, count(*) FILTER (part = 'R') AS n_r, max(x) FILTER (part = 'Q') AS last_q, max(x) FILTER (part = 'R') AS last_r
FROM f GROUP BY ALL"""
)
def q64_next_symbol_search(spark, sf_dir):
    """Q and R of each word's first four letters with any symbol after them, by one search for all symbols."""
    starts = lower_words(spark, sf_dir).select(F.left("x", F.lit(4)).alias("x")).distinct()
    made = Precovers(spark, catalog.newspeak()).decompose(starts, "x").next_symbols(starts, "x")
    q, r = (F.when(F.col("part") == p, F.col("source")) for p in "QR")
    return made.groupBy("target", "sym").agg(F.count(q).alias("n_q"), F.count(r).alias("n_r"), F.max(q).alias("last_q"), F.max(r).alias("last_r"))


# Machines that are tables of arcs, made from parts


def part(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def letters_of(df: DataFrame, column: str) -> DataFrame:
    """(x, before, c, after): each letter of each string, with the string's start before and after it."""
    at = F.explode(F.sequence(F.lit(1), F.length("x")))
    rows = df.select(F.col(column).alias("x")).where(F.length("x") > 0).distinct().select("x", at.alias("k"))
    return rows.select("x", F.expr("left(x, k - 1)").alias("before"), F.expr("substring(x, k, 1)").alias("c"), F.expr("left(x, k)").alias("after"))


def ends_of(arcs: DataFrame, finals: DataFrame) -> DataFrame:
    """States of arcs that start at the empty string."""
    names = arcs.select(F.col("src").alias("state")).union(arcs.select("dst")).distinct()
    marked = names.join(finals.select(F.col("x").alias("state")).distinct().withColumn("f", F.lit(True)), "state", "left")
    return marked.select("state", (F.col("state") == "").alias("is_start"), F.coalesce("f", F.lit(False)).alias("is_final"))


_NAMES = """t AS (SELECT DISTINCT p_name || ' ' || p_type AS x FROM part), k AS (SELECT x, unnest(range(0, length(x))) AS k FROM t),
c AS (SELECT DISTINCT left(x, CAST(k AS INT)) AS a, substr(x, CAST(k AS INT) + 1, 1) AS c, left(x, CAST(k AS INT) + 1) AS b FROM k),
f AS (SELECT a AS src, c AS i, CASE WHEN c = ' ' THEN '' ELSE c END AS o, b AS dst FROM c),
g AS (
  SELECT replace(a, ' ', '') AS src, c AS i, c AS o, replace(b, ' ', '') AS dst FROM c WHERE c <> ' '
  UNION SELECT replace(a, ' ', ''), '', ' ', replace(a, ' ', '') || ' ' FROM c WHERE c = ' '
  UNION SELECT replace(a, ' ', '') || ' ', c, c, replace(b, ' ', '') FROM c WHERE ends_with(a, ' ') AND c <> ' ')"""


@query(
    f"""WITH RECURSIVE {_NAMES},
s(p, q, turn) AS (
  SELECT '', '', 0 UNION
  SELECT p2, q2, turn2 FROM (
    SELECT f.dst AS p2, g.dst AS q2, 0 AS turn2 FROM s JOIN f ON f.src = s.p JOIN g ON g.src = s.q AND g.i = f.o WHERE f.o <> '' OR turn = 0
    UNION ALL SELECT f.dst, s.q, 1 FROM s JOIN f ON f.src = s.p AND f.o = '' WHERE turn < 2
    UNION ALL SELECT s.p, g.dst, 2 FROM s JOIN g ON g.src = s.q AND g.i = '' WHERE turn <> 1)),
m AS (
  SELECT s.*, f.i, g.o, f.dst AS p2, g.dst AS q2, 0 AS turn2 FROM s JOIN f ON f.src = s.p JOIN g ON g.src = s.q AND g.i = f.o WHERE f.o <> '' OR turn = 0
  UNION SELECT s.*, f.i, '', f.dst, s.q, 1 FROM s JOIN f ON f.src = s.p AND f.o = '' WHERE turn < 2
  UNION SELECT s.*, '', g.o, s.p, g.dst, 2 FROM s JOIN g ON g.src = s.q AND g.i = '' WHERE turn <> 1)
SELECT p || '|' || q || '|' || turn AS src, i AS ilabel, o AS olabel, p2 || '|' || q2 || '|' || turn2 AS dst, p2 IN (SELECT x FROM t) AND q2 IN (SELECT replace(x, ' ', '') FROM t) AS ends FROM m"""
)
def q65_silent_composition(spark, sf_dir):
    """The machine that drops spaces from names with types, and then the one that puts them back where some name has them."""
    steps = letters_of(part(spark, sf_dir).select(F.concat_ws(" ", "p_name", "p_type").alias("x")), "x")
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    f = steps.select(F.col("before").alias("src"), F.col("c").alias("ilabel"), F.when(F.col("c") == " ", "").otherwise(F.col("c")).alias("olabel"), F.col("after").alias("dst")).distinct()
    plain = steps.where("c <> ' '").select(bare("before").alias("src"), F.col("c").alias("ilabel"), F.col("c").alias("olabel"), bare("after").alias("dst"))
    gap = steps.where("c = ' '").select(bare("before").alias("src"), F.lit("").alias("ilabel"), F.lit(" ").alias("olabel"), F.concat(bare("before"), F.lit(" ")).alias("dst"))
    on = steps.where("c <> ' ' AND endswith(before, ' ')").select(F.concat(bare("before"), F.lit(" ")).alias("src"), F.col("c").alias("ilabel"), F.col("c").alias("olabel"), bare("after").alias("dst"))
    f, g = cut(f), cut(plain.unionByName(gap).unionByName(on).distinct())
    arcs, states = graphs.compose_silent(f, ends_of(f, steps), g, ends_of(g, steps.select(bare("x").alias("x"))))
    named = lambda c: F.concat_ws("|", f"{c}.p", f"{c}.q", f"{c}.turn")
    ends = states.select(F.col("state").alias("dst"), F.col("is_final").alias("ends"))
    return arcs.join(ends, "dst").select(named("src").alias("src"), "ilabel", "olabel", named("dst").alias("dst"), "ends")


def pair_machine(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs and states of a relation (x, y): the trie of the inputs, and a silent arc that writes y after each."""
    read = letters_of(pairs, "x").select(F.col("before").alias("src"), F.col("c").alias("ilabel"), F.lit("").alias("olabel"), F.col("after").alias("dst")).distinct()
    end = pairs.select(F.col("x").alias("src"), F.lit("").alias("ilabel"), F.col("y").alias("olabel"), F.concat("x", F.lit(">"), "y").alias("dst")).distinct()
    arcs = cut(read.unionByName(end))
    return arcs, ends_of(arcs, end.select(F.col("dst").alias("x")))


@query(
    """WITH a AS (SELECT 't' AS machine, replace(p_brand, 'Brand#', '') || '/' || p_size AS x, p_type AS y FROM part UNION ALL SELECT 'b', replace(p_brand, 'Brand#', '') || '/' || p_size, p_brand FROM part)
SELECT machine, x, CAST(count(DISTINCT y) AS BIGINT) AS outputs FROM a GROUP BY machine, x HAVING count(DISTINCT y) > 1"""
)
def q66_functionality(spark, sf_dir):
    """Inputs with two outputs, found as conflicting leads: brand and size leave the type open (t), but not the brand (b)."""
    rows, pairs = part(spark, sf_dir), None
    for name, y in (("t", "p_type"), ("b", "p_brand")):
        one = rows.select(F.concat_ws("/", F.lit(name), F.replace("p_brand", F.lit("Brand#"), F.lit("")), "p_size").alias("x"), F.col(y).alias("y"))
        pairs = one if pairs is None else pairs.unionByName(one)
    wrong = graphs.conflicts(*pair_machine(pairs), first=False).where("contains(p, '>') AND contains(q, '>')")
    names = wrong.select(F.substring_index("p", ">", 1).alias("name"), "p").groupBy("name").agg(F.countDistinct("p").alias("outputs"))
    return names.select(F.substring_index("name", "/", 1).alias("machine"), F.expr("substring(name, instr(name, '/') + 1)").alias("x"), "outputs")


@query(
    """WITH RECURSIVE n AS (SELECT p_partkey AS k, p_type AS m, p_brand || '/' || p_size AS v FROM part),
a AS (SELECT DISTINCT x.v AS src, y.v AS dst FROM n x JOIN n y ON y.k BETWEEN x.k + 1 AND x.k + 5 AND x.m = y.m),
r(src, dst) AS (SELECT src, dst FROM a UNION SELECT r.src, a.dst FROM r JOIN a ON r.dst = a.src),
s AS (SELECT DISTINCT v AS state FROM n),
c AS (SELECT r.src AS state, min(r.dst) AS low FROM r JOIN r AS b ON b.src = r.dst AND b.dst = r.src GROUP BY r.src),
y AS (SELECT src AS state FROM r WHERE src = dst)
SELECT s.state, least(s.state, coalesce(c.low, s.state)) AS component, s.state IN (SELECT state FROM y) AS cyclic,
  s.state NOT IN (SELECT state FROM y UNION SELECT src FROM r WHERE dst IN (SELECT state FROM y)) AS finite
FROM s LEFT JOIN c USING (state)"""
)
def q67_components(spark, sf_dir):
    """Brands and sizes that follow one another within five parts of one type: components, cycles, and where every path ends."""
    node = part(spark, sf_dir).select(F.col("p_partkey").alias("k"), F.col("p_type").alias("m"), F.concat_ws("/", "p_brand", "p_size").alias("v"))
    ahead = node.select(F.col("v").alias("src"), "m", F.explode(F.array(*[F.col("k") + i for i in range(1, 6)])).alias("k"))
    arcs = cut(ahead.join(node.withColumnRenamed("v", "dst"), ["k", "m"]).select("src", "dst").distinct())
    return graphs.endless(arcs, node.select(F.col("v").alias("state")).distinct())
