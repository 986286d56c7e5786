"""Machines on columns, tables of arcs, rewriting, streams, and the registered queries."""

import string
import time

import pytest
from pyspark.sql import functions as F

from fsweave.functions.rewrite import detokenize, separators, treebank_text
from fsweave.operators import algebra, fixpoint
from fsweave.operators.apply import accepts_column, aggregate_column, apply, apply_batches, filter_by_output, flag_members, flag_parts, is_letter_map, regex_of, relation_rows
from fsweave.operators.ngram import NgramModel
from fsweave.plans.machine import Machine
from fsweave.plans.precover import strings_below
from fsweave.sources import catalog, corpora


@pytest.mark.parametrize("name", ["delete_b", "parity", "parity_copy", "anbn", "backticks", "count_mod3", "has_mark", "small", "lookahead", "triplets", "sdd1", "two_hubs", "no_hub"])
def test_all_ways_of_applying_agree(spark, name):
    m = catalog.CATALOG[name]()
    rows = [("".join(x),) for x in strings_below(m, 4)] + [("?",), (None,)]
    df = spark.createDataFrame(rows, "x string")
    want = {x: None if x is None else next(("".join(y) for y in algebra.transduce(m, x)), None) for (x,) in rows}
    assert {r.x: r.y for r in apply(df, m, "x", "y").collect()} == want
    assert {r.x: r.y for r in apply_batches(df, m, "x", "y").collect()} == want
    fold = aggregate_column(m, F.col("x"))
    if fold is not None:
        assert {r.x: r.y for r in df.withColumn("y", fold).collect()} == want


def test_letter_maps_become_translate(spark):
    assert is_letter_map(catalog.lowercase()) and not is_letter_map(catalog.newspeak())
    df = spark.createDataFrame([("Ab c",), ("É",), ("",)], "x string")
    out = apply(df, catalog.lowercase(), "x", "y")
    assert [r.y for r in out.collect()] == ["ab c", None, ""]
    assert "translate" in out._jdf.queryExecution().executedPlan().toString()


def test_filters_move_to_the_source(spark):
    df = spark.createDataFrame([(w,) for w in ("bad", "ba", "unbad", "un", "bed", "badly", "")], "x string")
    got = {r.x for r in filter_by_output(df, catalog.newspeak(), "x", "un").collect()}
    assert got == {"bad", "unbad", "un", "badly"}
    assert "RLIKE" in filter_by_output(df, catalog.newspeak(), "x", "un")._jdf.queryExecution().executedPlan().toString()


def test_members_by_pattern_or_automaton(spark):
    ways = set()
    for name in ("triplets", "no_hub", "backticks", "anbn", "small", "has_mark"):
        m = catalog.CATALOG[name]().project(0)
        rows = [("".join(x),) for x in strings_below(m, 6)] + [(None,)]
        df = spark.createDataFrame(rows, "x string")
        pattern = accepts_column(m, F.col("x"))
        ways.add(pattern is None)
        want = {x for (x,) in rows if x is not None and algebra.accepts(m, x)}
        assert {r.x for r in flag_members(df, m, "x", "y").where("y").collect()} == want
        if pattern is not None:
            assert {r.x for r in df.where(pattern).collect()} == want
    assert ways == {True, False} and regex_of(algebra.zero()) is not None


def test_long_strings(spark):
    """Every way of applying a machine is linear in its input and ends well: 100,000 characters."""
    news, n = catalog.newspeak(), 100_000
    x = ("xbadba" * (n // 6 + 1))[:n]
    df = spark.createDataFrame([(x,), (x + "th",), (x + "?",), ("",), (None,)], "x string")
    want = {len(x): x.replace("bad", "ungood"), len(x) + 2: (x + "th").replace("bad", "ungood"), len(x) + 1: None, 0: ""}
    begin = time.time()
    for out in (df.withColumn("y", aggregate_column(news, F.col("x"))), apply_batches(df, news, "x", "y"), apply(df, news, "x", "y")):
        assert {len(r.x): r.y for r in out.collect() if r.x is not None} == {k: v for k, v in want.items()}
    letters = spark.createDataFrame([("Ab" * n,)], "x string")
    assert apply(letters, catalog.lowercase(), "x", "y").first().y == "ab" * n
    anything, th = algebra.universal(string.ascii_lowercase), algebra.from_string("th")
    has = algebra.concat(algebra.concat(anything, th), anything)
    for m, good in ((has, {len(x) + 2}), (algebra.complement(has, string.ascii_lowercase), {0, len(x)}), (algebra.star(algebra.from_strings(["x", "ba", "d"])), {0, len(x)})):
        assert {len(r.x) for r in flag_members(df, m, "x", "y").where("y").collect()} == good
    assert filter_by_output(df.where("not contains(x, '?')"), news, "x", "xungoodbax").count() == 2
    assert {r.p for r in flag_parts(df, catalog.parity(string.ascii_lowercase), "1", "x", "p").collect()} == {"R", ""}
    assert time.time() - begin < 120


def test_relations(spark):
    df = spark.createDataFrame([("ab", 1), ("zz", 2)], "x string, k int")
    assert {(r.k, r.y) for r in relation_rows(df, catalog.split_copy(), "x", "y").collect()} == {(1, "c"), (1, "cx")}


def test_tables_agree_with_the_driver(spark):
    m = catalog.newspeak().with_([(9, "z", "z", 10)])
    arcs, states = m.to_df(spark)
    n = m.renumber()
    assert {r[0] for r in fixpoint.reach(arcs, states).collect()} == algebra.reachable(n)
    assert {r[0] for r in fixpoint.reach(arcs, states, True).collect()} == algebra.coreachable(n)
    assert {tuple(r) for r in fixpoint.trim_arcs(arcs, states).collect()} == algebra.trim(n).arcs
    assert Machine.from_df(arcs, states).arcs == n.arcs
    pairs = {tuple(r) for r in fixpoint.eps_pairs(arcs, states).collect()}
    assert pairs == {(q, s) for q in n.states for s in algebra.eps_closure(n, [q])}
    ring = algebra.minimize(Machine.acceptor([(i, c, (i + 1) % 6) for i in range(6) for c in "ab"], [0], [0, 3]))
    assert len(ring.states) == 3


def test_machines_survive_files(spark, tmp_path):
    m = catalog.delete_b().renumber()
    for kind in ("parquet", "json", "csv"):
        corpora.save_machine(m, spark, f"file://{tmp_path}/{kind}", kind)
        assert corpora.load_machine(spark, f"file://{tmp_path}/{kind}", kind).arcs == m.arcs


def test_vocabulary_sources(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"model": {"vocab": {"ab": 0, "c": 1}}}')
    assert {tuple(r) for r in corpora.json_vocabulary(spark, f"file://{tmp_path}/v.json").collect()} == {("0", "ab"), ("1", "c")}
    (tmp_path / "v.tiktoken").write_text("YWI= 0\nYw== 1\n")
    assert {tuple(r) for r in corpora.tiktoken_vocabulary(spark, f"file://{tmp_path}/v.tiktoken").collect()} == {("0", "6162"), ("1", "63")}
    (tmp_path / "t.txt").write_bytes(b"ab\n")
    assert corpora.file_bytes(spark, f"file://{tmp_path}/t.txt").first().symbols == ["61", "62", "0A"]
    assert [r.text for r in corpora.text_lines(spark, f"file://{tmp_path}/t.txt").collect()] == ["ab"]
    df = spark.createDataFrame([("a",), ("bb",)], "x string")
    assert [r.score for r in corpora.batch_scorer(df, "x", lambda: lambda ts: [float(len(t)) for t in ts]).collect()] == [1.0, 2.0]


TREEBANK = [
    ('He said "hi" to (you).', "He said `` hi '' to ( you ) ."),
    ("I can't; it's $5, 1,000.", "I ca n't ; it 's $ 5 , 1,000 ."),
    ("They'll cannot--gonna 'tis...", "They 'll can not -- gon na 't is ..."),
    ("dogs' bark: yes!", "dogs ' bark : yes !"),
    ("", ""),
]


def test_treebank(spark):
    df = spark.createDataFrame(TREEBANK, "x string, want string")
    for r in df.withColumn("y", treebank_text(F.col("x"))).collect():
        assert r.y == r.want
    assert spark.range(1).select(separators(F.lit("a##b#"), "#", "|")).first()[0] == "a|b|"


def test_detokenize(spark):
    df = spark.createDataFrame([("a @-@ b , c . ( d ) ' e ' = = x 's",)], "x string")
    assert df.select(detokenize(F.col("x"))).first()[0] == "a-b, c. (d) 'e' == x's"


def test_streams_equal_batches(spark, tmp_path):
    from fsweave.streaming.incremental import follow, follow_batch

    rows = [("u", 1, "b"), ("u", 2, "a"), ("v", 1, "a"), ("u", 3, "d"), ("v", 2, "?")]
    df = spark.createDataFrame(rows, "key string, seq long, symbol string")
    model = NgramModel.train(["bad", "ab"], 2, 0.5, string.ascii_lowercase)
    batch = {r.key: r for r in follow_batch(df, catalog.newspeak(), model).collect()}
    assert batch["u"].written == "ungood" and batch["v"].state == -1
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/p{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    q = follow(stream, catalog.newspeak(), model).writeStream.outputMode("update").format("memory").queryName("followed").option("checkpointLocation", f"file://{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    got: dict = {}
    for r in sorted(spark.table("followed").collect(), key=lambda r: r.n):
        text, *_ = got.get(r.key, ("",))
        got[r.key] = (text + r.written, r.n, r.state, r.logprefix)
    for key, r in batch.items():
        text, n, state, lp = got[key]
        assert (text, n, state) == (r.written, r.n, r.state) and abs(lp - r.logprefix) < 1e-9


def test_queries_have_sql_and_columns(spark):
    import duckdb

    from fsweave.plans.queries import QUERIES, SQL

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    for name in ("q01_lowercase_pushforward", "q12_make_total", "q18_trim_arcs", "q27_precover_filter", "q29_next_symbol_counts", "q33_sequence_logprob", "q49_role_sequences"):
        got, want = QUERIES[name](spark, sf).toPandas(), con.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        key = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
        assert key(got) == key(want), name
