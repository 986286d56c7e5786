"""Exact, substring and near deduplication, mixing, archives."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fsweave.llm import op1_warc as warc
from fsweave.llm import op2_mixing as mixing
from fsweave.llm import op3_substring_dedup as sub
from fsweave.llm import op7_exact_dedup as exact
from fsweave.llm import op10_jaccard_join as near
from fsweave.llm.common import pack_ints, pack_sorted, scratch, unpack_ints, unpack_sorted

from .conftest import make_docs, messy

SPACE = r"[\x20\x09-\x0D]"
split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_exact_dedup(spark, docs, none):
    groups = defaultdict(list)
    for i, t, *_ in messy():
        groups[re.sub(SPACE, "", t or "")].append((i, len(t or "")))
    want = []
    for text, rows in groups.items():
        keep = min(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))[0]
        want += [(i, keep, len(rows), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i, _ in rows]
    for batches in (1, 2, 3):
        index = exact.DigestIndex(spark, scratch(spark, "index"), 4)
        assert table(exact.deduplicate_all(docs, index, batches)) == sorted(want, key=str)
        assert index.frame().count() == len(groups)
        index.drop()
    index = exact.DigestIndex(spark, scratch(spark, "index"), 4)
    assert table(exact.deduplicate(docs, index)) == sorted(want, key=str)
    again = exact.deduplicate(docs, exact.DigestIndex(spark, index.path, 4)).collect()  # everything is known by now
    assert not any(r.kept for r in again) and index.frame().count() == index.known().count() == len(groups)
    fresh = make_docs(spark, [(900, "quite new", None, None), (901, "alone here", None, None)])
    assert [(r.doc_id, r.kept) for r in sorted(exact.deduplicate(fresh, index).collect())] == [(900, True), (901, False)]
    assert exact.deduplicate(none, index).count() == 0


def test_exact_dedup_lives_by_its_anti_join(spark):
    """A third of the rows are blank; entries are unique because known digests are not added again, and nothing else makes them so."""
    rows = [(k, [" \n", "", None][k % 9 // 3] if k % 3 == 0 else f"text {k % 50}" + " " * (k % 4), None, None) for k in range(600)]
    index = exact.DigestIndex(spark, scratch(spark, "index"), 4)
    got = exact.deduplicate_all(make_docs(spark, rows), index, 3).collect()
    blank = [r for r in got if r.group_size == 200]
    assert len(got) == 600 and len(blank) == 200 and [r.doc_id for r in blank if r.kept] == [0]
    n = index.frame().count()
    assert n == len({r.text_sha256 for r in got}) == index.known().count() and index.frame(index.updates).count() > 0
    index.append(index.entries, index.frame())
    assert index.known().count() == 2 * n


def test_exact_dedup_is_native(spark, docs):
    index = exact.DigestIndex(spark, scratch(spark, "index"), 4)
    plan = exact.deduplicate(docs, index)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SortMergeJoin" in plan


def brute_substring(rows):
    first = {}
    key = lambda i: (1, 0) if i is None else (0, i)
    for i, t, *_ in rows:
        ws = split(t)
        for a in range(len(ws) - 12):
            w = tuple(ws[a : a + 13])
            first[w] = min(first.get(w, (2, 0)), key(i))
    out = []
    for i, t, *_ in rows:
        ws = split(t)
        gone = {k for a in range(len(ws) - 12) if first[tuple(ws[a : a + 13])] < key(i) for k in range(a, a + 13)}
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup(spark, docs, batches):
    got = sub.remove_repeats(docs, batches=batches, keep_text=True)
    assert table(got.drop("kept_text")) == brute_substring(messy())
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got.collect())


def test_substring_index_grows_and_compacts(spark, none):
    rows = [r for r in messy(5) if r[0] is not None]
    random.Random(1).shuffle(rows)  # later batches may have smaller ids
    index = sub.FingerprintIndex(spark, scratch(spark, "prints"), 64, fan=3)
    seen = []
    for k in range(0, len(rows), 30):
        part = rows[k : k + 30]
        seen += part
        path = index.deduplicate(make_docs(spark, part))
        ids = {r[0] for r in part}
        want = [w for w in brute_substring(seen) if w[0] in ids]
        got = table(spark.read.parquet(path))
        repeated = {i for i in ids if sum(r[0] == i for r in seen) > 1}
        assert [g for g in got if g[0] not in repeated] == [w for w in want if w[0] not in repeated]
    n, levels = -(-len(rows) // 30), []
    while n:
        levels, n = [n % 3, *levels], n // 3
    assert n == 0 and [len(index.runs(k)) for k in range(len(levels))] == levels[::-1]  # three runs of a level make one of the next
    before = index.read().agg({"n": "sum"}).first()[0]
    index.compact()
    assert len(index.runs()) == 1 and sub.FingerprintIndex(spark, index.path, 64).runs() == index.runs() and index.read().agg({"n": "sum"}).first()[0] <= before
    path = index.deduplicate(make_docs(spark, [(9999, rows[1][1] + " " + rows[0][1], None, None)]))
    assert table(spark.read.parquet(path)) == [w for w in brute_substring([*rows, (9999, rows[1][1] + " " + rows[0][1])]) if w[0] == 9999]
    assert sub.remove_repeats(none).count() == 0


def test_colliding_keys_are_told_apart():
    import numpy as np

    h, c, d = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 1], np.uint32), np.array([7, 3, 4, 8], np.int64)
    p = sub.Prints(h, c, d).distinct()
    assert sorted(zip(p.h.tolist(), p.c.tolist(), p.d.tolist())) == [(5, 1, 4), (5, 2, 3), (9, 1, 8)]


def test_packed_arrays():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        a = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        assert (unpack_sorted(pack_sorted(a)) == a).all()
        b = rng.integers(0, 60_000, n).astype(np.uint16)
        assert (unpack_ints(pack_ints(b), np.uint16) == b).all()


def brute_near(rows, k, num, den):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for _, t, *_ in rows:
        ws = split(low(t))
        n = min(k, len(ws))
        sets.append({tuple(ws[a : a + n]) for a in range(len(ws) - n + 1)} if n else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both * den >= num * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)].append(r[0])
    out = [(r[0], len(sets[i]), min(least[root(i)]) if least[root(i)] else None) for i, r in enumerate(rows)]
    return sorted(out, key=str), len({root(i) for i in range(len(rows))}), sets


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (2, 1, 2), (5, 8, 10)])
def test_jaccard_components(spark, docs, none, k, num, den):
    want, groups, sets = brute_near(messy(), k, num, den)
    assert table(near.jaccard_components(docs, k, num, den)) == want
    if k == 5:
        kept = near.keep_one(docs, k, num, den)
        assert kept.columns == docs.columns and kept.count() == groups


def test_keep_one_with_clashing_names_and_repeats(spark, docs):
    names = ("row", "k", "none", "th", "one", "choose", "rows", "rid", "__k", "__th", "__one")
    clashing = docs.selectExpr("*", *(f"doc_id AS `{c}`" for c in {*names} - {*docs.columns}))
    kept = near.keep_one(clashing.unionByName(clashing), 3, 9, 10)
    _, groups, sets = brute_near(messy(), 3, 9, 10)
    assert kept.columns == clashing.columns and kept.where("text RLIKE '[^ \\t\\n]'").count() == groups - sum(not x for x in sets)


def test_jaccard_chains_and_groups(spark, none):
    """A chain whose ends are unlike, and a group of several hundred copies that differ in one word each."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[i : i + 40]), None, None) for i in range(0, 20)]
    rows += [(1000 + i, " ".join([f"v{j}" for j in range(80)][: 80 - 1] + [f"x{i}"]), None, None) for i in range(150)]
    rows += [(5000 + i, " ".join(f"q{j}" if (j * 7 + i) % 11 else f"r{i}x{j}" for j in range(60)), None, None) for i in range(40)]
    df = make_docs(spark, rows)
    for k, num, den in ((3, 9, 10), (1, 8, 10)):
        assert table(near.jaccard_components(df, k, num, den)) == brute_near(rows, k, num, den)[0]
    assert near.jaccard_components(none).count() == 0 and near.keep_one(none).count() == 0


def test_water_filling():
    assert mixing.water_fill([10, 10], [1, 1], 20, 3) == [10, 10]
    assert mixing.water_fill([1, 100], [1, 1], 101, 3) == [3, 98]
    assert mixing.water_fill([0, 5], [1, 1], 5, 3) == [0, 5] and mixing.water_fill([], [], 0, 3) == []


def plain_mix(rows, weights=(1, 2, 3), cap=3.0, seed=7):
    """The same tree in one process: rows of (source, k, none, th, size, h), alike rows repeated."""
    units = Counter(rows)
    names = sorted({r[0] for r in rows}, key=lambda n: (n is None, (n or "").encode("utf-32-be")))
    sizes = [sum(r[4] * m for r, m in units.items() if r[0] == n) for n in names]
    targets = mixing.water_fill(sizes, [weights[i % len(weights)] for i in range(len(names))], sum(sizes), cap)
    taken = Counter()
    for s, name in enumerate(names):
        mine = {r: m for r, m in units.items() if r[0] == name}
        rate = min(cap, targets[s] / sizes[s]) if sizes[s] else 0.0
        whole, leaves = math.floor(rate + mixing.EPS), max(1, -(-len(mine) // mixing.LEAF))
        p, todo = {}, defaultdict(list)
        for r, m in mine.items():
            share = m * max(0.0, rate - whole)
            certain = math.floor(share + mixing.EPS) if r[4] else 0
            p[r] = max(0.0, share - certain) if r[4] else 0.0
            taken[r] = (whole * m + certain) * r[4]
            if p[r] > mixing.EPS:
                todo[r[5] % leaves].append(r)
        level, most = 0, -(-max([1, *(len([r for r in units if r[0] == n]) for n in names)]) // mixing.LEAF)
        while True:
            left = defaultdict(list)
            for b, group in todo.items():
                group.sort(key=lambda r: (r[5], r[1], r[2], r[3], r[4]))
                ps = np.array([p[r] for r in group])
                rest = mixing.pivot(ps, np.array([float(r[4]) for r in group]), np.random.default_rng([seed, level, s, b]))
                p.update(zip(group, ps.tolist()))
                if rest >= 0:
                    left[b // mixing.FAN].append(group[rest])
            if most == 1:
                break
            todo, level, most = left, level + 1, -(-most // mixing.FAN)
        for r in mine:
            taken[r] += p[r] * r[4]
    out = Counter()
    for r, words in taken.items():
        out[r[0]] += words
    return taken, out


def test_mixing_equals_the_tree_in_one_process(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "LEAF", 8)
    monkeypatch.setattr(mixing, "FAN", 2)
    same = make_docs(spark, [(77, "one and the same row", "en", "s1")] * 50 + [(None, f"row {k} without an id", "en", "s1") for k in range(20)])
    docs = docs.unionByName(same.select(*docs.columns) if set(docs.columns) <= set(same.columns) else same, allowMissingColumns=True)
    keyed = docs.select("source", *mixing._keys(), mixing.word_count().alias("size"))
    keyed = keyed.select("source", "k", "none", "th", "size", F.xxhash64(F.lit(7), "k", "none", "th", "size").alias("h"))
    taken, _ = plain_mix([tuple(r) for r in keyed.collect()])
    got = Counter()
    for r in mixing.plan_mix(docs).collect():
        got[r.doc_id, r.size, r.source_size] += r.taken
    want = Counter()
    total = defaultdict(int)
    for r in keyed.collect():
        total[r.source] += r.size
    for (source, k, none, _, size, _), words in taken.items():
        want[None if none else k, size, total[source]] += words
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1 for k in want)
    clashing = docs.selectExpr("*", *(f"doc_id AS `{c}`" for c in {"row", "k", "none", "th", "nowhere", "whole", "m", "extra", "times", "part", "at", "number", "before", "__n", "__k", "__c"} - {*docs.columns}))
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns and mixed.count() == mixing.plan_mix(docs, residual="nearest").agg({"copies": "sum"}).first()[0]
    assert mixing.mix(clashing.limit(0)).count() == 0


def test_mixing(spark, docs, none, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 8)
    monkeypatch.setattr(mixing, "FAN", 2)
    rows = messy()
    plan = mixing.plan_mix(docs).collect()
    assert sorted((r.doc_id, r.size) for r in plan if r.doc_id is not None) == sorted((i, len(split(t))) for i, t, *_ in rows if i is not None)
    names = sorted({r[3] for r in rows if r[3]}, key=lambda s: s.encode("utf-32-be")) + [None]
    sizes = [sum(len(split(t)) for _, t, _, s in rows if s == name) for name in names]
    targets = dict(zip(names, mixing.water_fill(sizes, [1 + k % 3 for k in range(len(names))], sum(sizes), 3)))
    by = defaultdict(lambda: [0, 0.0])
    for r in plan:
        by[r.source_size, round(r.target, 6)][0] += r.taken
        assert r.taken <= 3 * r.size
    assert set(by) == {(size, round(t, 6)) for size, t in zip(sizes, targets.values())}
    assert len(set(sizes)) == len(sizes) and all(abs(taken - target) <= 1 for (_, target), (taken, _) in by.items())
    assert table(mixing.plan_mix(docs.repartition(7))) == table(mixing.plan_mix(docs))
    assert mixing.plan_mix(none).count() == 0
    mixed = mixing.mix(docs)
    whole = mixing.plan_mix(docs, residual="nearest")
    assert mixed.columns == docs.columns and mixed.count() == whole.agg({"copies": "sum"}).first()[0]


def test_pivotal_rounding_is_unbiased():
    import numpy as np

    p0, s = np.array([0.2, 0.5, 0.9, 0.3, 0.6]), np.array([3.0, 10.0, 2.0, 7.0, 5.0])
    total = np.zeros(5)
    for k in range(4000):
        p = p0.copy()
        rest = mixing.pivot(p, s, np.random.default_rng(k))
        assert abs((p * s).sum() - (p0 * s).sum()) < 1e-6 and sum(0 < x < 1 for x in p) <= 1 and (rest >= 0) == any(0 < x < 1 for x in p)
        total += p
    assert np.abs(total / 4000 - p0).max() < 0.04


PAGES = [(5, "http://a/x y", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (9, None, None), (1, "http://c", ""), (None, "u", "lone"), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n"), (7, "u", "twice"), (7, "u", "twice"), (8, "u\r\nv", "x" * 200_000)]


@pytest.mark.parametrize("gz", [True, False])
def test_archives_round_trip(spark, gz):
    pages = spark.createDataFrame([(*p, "z", 1) for p in PAGES], "page_id long, url string, html string, digest string, size int")
    for smallest in (0, 5):
        want = []
        for i, _, html in PAGES:
            data = (html or "").encode()
            same = [j for j, _, h in PAGES if (h or "") == (html or "") and j is not None]
            first = min(same, default=None) if len(data) >= smallest else None
            again = first is not None and first != i
            want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
        assert table(warc.archive_pages(pages, smallest, gz)) == sorted(want, key=str)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def records(n):
    return [warc.page_record(str(i), f"http://x/{i}", f"page {i} ".encode() * 20, None) for i in range(n)]


def pack(record):
    import zlib

    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


@pytest.mark.parametrize("gz", [True, False])
def test_salvage_recovers_all_but_damaged_records(gz):
    rng = random.Random(6)
    parts = [pack(r) if gz else r for r in records(12)]
    edges = [sum(map(len, parts[:k])) for k in range(13)]
    whole = b"".join(parts)
    assert [e.headers["warc-record-id"] for e in warc.salvage(warc.Source(whole))] == [f"<urn:page:{i}>" for i in range(12)]
    for _ in range(60):
        data, hurt = bytearray(whole), set()
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(data))
            data[at] ^= 1 << rng.randrange(8)
            hurt.add(next(k for k in range(12) if edges[k] <= at < edges[k + 1]))
        found = list(warc.salvage(warc.Source(bytes(data))))
        ids = {int(re.search(r"\d+", e.headers["warc-record-id"])[0]) for e in found if e.headers}
        assert set(range(12)) - hurt <= ids
        assert all(e.payload == f"page {i} ".encode() * 20 for e in found if e.headers and (i := int(re.search(r"\d+", e.headers["warc-record-id"])[0])) not in hurt)
        spans = sorted((e.start, e.stop) for e in found)
        assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert all(e.reason for e in found if not e.headers)


def test_salvage_of_cut_and_mixed_files(tmp_path):
    a, b, c = records(3)
    found = list(warc.salvage(warc.Source(a[:-30] + pack(b) + b"junk\r\n" + c)))
    assert [(e.headers or {}).get("warc-record-id") for e in found] == [None, "<urn:page:1>", None, "<urn:page:2>"]
    long = a.replace(b"Content-Length: ", b"Content-Length: 9")  # swallows what follows
    assert [(e.headers or {}).get("warc-record-id") for e in warc.salvage(warc.Source(long + b + c))] == [None, "<urn:page:1>", "<urn:page:2>"]
    path = tmp_path / "x.warc"
    path.write_bytes(a + b"\0" * 3_000_000 + pack(b))
    with open(path, "rb") as f:
        got = list(warc.salvage(warc.Source(file=f, size=path.stat().st_size)))
    assert [bool(e.headers) for e in got] == [True, False, True] and got[1].stop - got[1].start == 3_000_000
    assert list(warc.salvage(warc.Source(b""))) == []


def test_reading_files_reports_gaps(spark, tmp_path, monkeypatch):
    a, b, c = records(3)
    (tmp_path / "a.warc.gz").write_bytes(pack(a) + b"\x1f\x8b\x08broken" + pack(b))
    (tmp_path / "b.warc").write_bytes(c)
    for inline in (warc.INLINE, 0):  # through Spark, and in chunks through the file system
        monkeypatch.setattr(warc, "INLINE", inline)
        rows = warc.read_warc(spark, f"file://{tmp_path}").collect()
        assert sorted(r.record_id for r in rows if r.reason is None) == ["urn:page:0", "urn:page:1", "urn:page:2"]
        assert [(r.stop - r.start, r.reason is not None) for r in rows if r.reason] == [(9, True)]
