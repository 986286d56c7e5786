"""Decontamination, toxicity, language, token counts, and the pipeline."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from fsweave.llm import op2_mixing as mixing
from fsweave.llm import op4_token_file as tok
from fsweave.llm import op5_decontamination as dec
from fsweave.llm import op6_token_counts as cnt
from fsweave.llm import op8_toxicity as tox
from fsweave.llm import op9_language_id as lid

from .conftest import make_docs, messy

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(df.collect(), key=str)


def brute_hits(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, t, *_ in docs:
        ws, hit, found = split(t), set(), set()
        for item, text in items:
            p = split(text)
            k = min(10, len(p))
            windows = {tuple(p[a : a + k]) for a in range(len(p) - k + 1)} if k else set()
            for a in range(len(ws) - k + 1) if k else ():
                if tuple(ws[a : a + k]) in windows:
                    hit.update(range(a, a + k))
                    if item is not None:
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(ws), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def test_decontamination_equals_brute_force(spark, docs, none, monkeypatch):
    rows = messy()
    long = next(t for _, t, *_ in rows if t and len(t.split()) > 40)
    items = [(1, " ".join(long.split()[3:20])), (2, "alone HERE"), (10, "one"), (3, None), (4, " ,"), (None, " ".join(long.split()[10:22])), (2, "alone here"), (5, "never seen words " * 6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(rows, items)
    got = dec.decontamination(docs, bench)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    monkeypatch.setattr(dec, "SHARD_BYTES", 60)  # several machines, one after another
    assert sorted((tuple(r) for r in dec.decontamination(docs, bench).collect()), key=str) == want
    clean = dec.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not w[5] for w in want)
    assert dec.decontamination(none, bench).count() == 0
    assert not any(r.contaminated for r in dec.decontamination(docs, bench.limit(0)).collect())


def test_search_machine_equals_naive():
    rng = random.Random(4)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 40))]
        k = rng.randint(1, 4)
        patterns = {tuple(rng.choice([b"a", b"b", b"c"]) for _ in range(k)): ["x"] for _ in range(rng.randint(1, 4))}
        want = [a for a in range(len(words) - k + 1) if tuple(words[a : a + k]) in patterns]
        assert [a for a, _ in dec.Machine(k, [list(p) for p in patterns], ["x"] * len(patterns)).search(words)] == want


def test_token_counts_equal_the_library(spark, docs, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(((i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 100) for i, t, *_ in messy()), key=str)
    assert sorted((tuple(r) for r in cnt.token_counts(docs, path, limit=100, frequent=50).collect()), key=str) == want
    assert cnt.token_counts(none, path).count() == 0
    lens, rng = cnt.PieceLengths(path), random.Random(2)
    alphabet = "ab Th\n\t  ▁é漢12<s></s>\x00 ,."
    for _ in range(4000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) + rng.choice(["", "  ", "\n", " <unk> ▁▁"])
        assert lens.count(t) == len(sp.encode(t)), repr(t)


def test_token_files_round_trip(spark, docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want, start = [], 0
    rows = sorted(messy(), key=lambda r: (r[0] is not None, r[0] or 0))
    by = Counter()
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        by[i, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    got = sorted(tok.round_trip(docs, path).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == by
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert at == start and [r.doc_id for r in got] == [r[0] for r in rows]
    assert tok.round_trip(none, path).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 20, 31])
def test_bit_packing(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 10_000, dtype=np.uint64).astype(np.uint32)
    starts = np.array([0, 0, 4095, 4096, 9000, 10_000])
    data = tok.shard_bytes((1, 2), bits, [5, None, 7, 8, -9], starts, ids)
    shard = tok.Shard(data)
    assert shard.doc_ids == [5, None, 7, 8, -9] and shard.number == 1 << 20 | 2
    for k in range(5):
        assert (shard.document(k) == ids[starts[k] : starts[k + 1]]).all()
    for a, b in ((0, 0), (63, 65), (4000, 9001), (9999, 10_000)):
        assert (shard.ids(a, b) == ids[a:b]).all()
    assert len(data) < 10_000 * bits / 8 + 4096 * bits / 8 + 200


def test_word_lookup_equals_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, w, rng = Tokenizer.from_file(path), tok.WordIds(path), random.Random(7)
    alphabet = "abAB'sStTmMdDréÉ̸́ßΣσ12,.!?-_ \n\t\x1c\x85İ<|>漢字क़̣ªʰﬁ"
    for k in range(5000):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20))) + rng.choice(["", "<|endoftext|>,", "<|ENDOFTEXT|>."])
        assert list(w.encode(pa.array([x]))[0]) == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_maximal_segments_equal_definition():
    def brute(scores):
        """The best segment, then the same to its left and right."""
        best = None
        for a in range(len(scores)):
            for b in range(a + 1, len(scores) + 1):
                s = sum(scores[a:b])
                if s > 0 and (best is None or s > best[2] or (s == best[2] and b - a < best[1] - best[0])):
                    best = (a, b, s)
        if best is None:
            return []
        a, b, _ = best
        return [*brute(scores[:a]), best, *[(b + x, b + y, s) for x, y, s in brute(scores[b:])]]

    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.uniform(-3, 3) for _ in range(rng.randint(0, 14))]
        got, want = tox.segments(scores), brute(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def test_toxicity_held_out(spark):
    got = tox.score_toxicity(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet"))
    truth = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    rows = got.join(truth, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.93
    assert not [r for r in rows if r.predicted == 1 and r.toxic == 0]
    assert all(r.passages and r.passages[0].stop > r.passages[0].start for r in rows if r.predicted)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.collect())


def test_toxicity_on_odd_tables(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(-20, 100)] + [(None, 1, "x"), (1, None, "x"), (1, 1, "x")], "doc_id long, toxic int, text string")
    got = tox.score_toxicity(docs, labels).collect()
    assert len(got) == len(messy()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert tox.score_toxicity(none, labels).count() == 0
    assert all(r.score == 0 for r in tox.score_toxicity(docs, labels.limit(0)).collect())
    for few in (labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0")):  # nothing to tell apart
        kept = tox.drop_toxic(docs, few)
        assert kept.columns == docs.columns and kept.count() == len(messy())


def test_toxicity_law_line_and_score():
    """The law solves its equations, the line is where its loss is flat, and a score follows from both by hand."""
    rng = random.Random(12)
    model = tox.ToxicModel([("bad", 30, 5), ("vile", 20, 1), ("fine", 2, 90), ("good", 1, 80)], 40, 160)
    tokens = Counter({-0.2: 900, -1.5: 300, 0.9: 40, 2.1: 5})
    best = [(rng.uniform(0, 3), rng.randint(5, 400)) for _ in range(200)] + [(0.0, 12), (0.0, 0)]
    model.fit_law(tokens, best)
    assert abs(sum(k * math.exp(model.scale * s) for s, k in tokens.items()) / sum(tokens.values()) - 1) < 1e-6 and model.scale > 0.01
    values = [model.scale * s - math.log(m) for s, m in best if s > 0]
    assert abs(model.log_k - (sum(values) / len(values) - 0.57721566)) < 1e-6
    x = np.array([rng.expovariate(1) * (1 + 4 * (k % 4 == 0)) for k in range(400)])
    y = np.array([float(k % 4 == 0 and rng.random() < 0.9) for k in range(400)])
    model.fit_line(x, y)
    a, b = model.line
    p = 1 / (1 + np.exp(-(a + b * np.log(1 + x))))
    assert b > 0 and abs((p - y).sum() + 1e-3 * a) < 1e-6 and abs(((p - y) * np.log(1 + x)).sum() + 1e-3 * b) < 1e-6
    for _ in range(200):
        words = [rng.choice(["bad", "vile", "fine", "good", "the", "of"]) for _ in range(rng.randint(0, 30))]
        scores = [model.scores.get(w, tox.DRIFT) for w in words]
        total = 0.0
        for _, _, s in tox.segments(scores):
            chance = -math.expm1(-len(words) * math.exp(model.log_k - model.scale * s))
            total -= math.log(chance) if chance <= tox.LEVEL else 0.0
        want = 1 / (1 + math.exp(-(a + b * math.log(1 + total))))
        assert abs(model.score_of(model.token_scores(" ".join(words))) - want) < 1e-6


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = lid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows if r.held_out]) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)


def test_language_on_odd_tables(spark, docs, none):
    got = lid.identify(docs).collect()
    text = {(r.doc_id, r.lang_pred) for r in got}
    assert {(500, "und"), (501, "und"), (502, "und")} <= text and {r.lang_pred for r in got} <= {"en", "fr", "und"}
    assert lid.identify(none).count() == 0
    unlabelled = make_docs(spark, [(1, "some words", None, None)])
    assert [r.lang_pred for r in lid.identify(unlabelled).collect()] == ["und"]
    model = lid.LanguageModel([("en", "the", 9), ("fr", "les", 9)])
    assert model.of_word("the")[0] > model.of_word("the")[1] and model.of_word("them")[0] > model.of_word("them")[1] and not model.of_word("zq").any()


def test_language_scores_equal_the_definition(spark, none):
    """Word shares, then n-gram shares from 5 characters down, by their definition; numbers are no letters."""
    rng = random.Random(5)
    texts = [(k, " ".join(rng.choice(w) + rng.choice(["", "en", "s"]) for _ in range(30)), lang, None) for k in range(40) for lang, w in (("a", ["the", "house", "ça"]), ("b", ["das", "haus", "über"]))]
    counts = Counter((lang, w) for i, t, lang, _ in texts if zlib.crc32(str(i).encode()) % 4 != 2 for w in re.findall(r"[^\W\d_]+", t.lower()))
    words, langs = sorted({w for _, w in counts}), ["a", "b"]

    def share(weights, key):
        return np.array([math.log((weights[l].get(key, 0) + 0.5) / (sum(weights[l].values()) + 0.5 * len({k for x in weights.values() for k in x}))) for l in langs])

    by_word = {l: {w: counts[l, w] for w in words} for l in langs}
    grams = {}
    for n in range(1, 6):
        grams[n] = {l: Counter() for l in langs}
        for (l, w), c in counts.items():
            x = f"<{w}>" if n > 1 else w
            for i in range(len(x) - n + 1):
                grams[n][l][x[i : i + n]] += c

    def score(w):
        if w in words:
            return share(by_word, w)
        for n in range(5, 0, -1):
            x = f"<{w}>" if n > 1 else w
            known = [g for g in (x[i : i + n] for i in range(len(x) - n + 1)) if any(g in grams[n][l] for l in langs)]
            if known:
                return np.mean([share(grams[n], g) for g in known], axis=0)
        return np.zeros(2)

    asked = [(1000, "the houses", None, None), (1001, "dasselbe uberhaus zzz", None, None), (1002, "½ ² ① Ⅷ 12", None, None), (1003, "ça½ 7", None, None), (1004, "x" * 200_000 + " the", None, None)]
    got = {r.doc_id: r for r in lid.identify(make_docs(spark, texts + asked)).collect()}
    assert got[1002].lang_pred == "und"
    for i, t, *_ in asked[:2] + asked[3:]:
        total = sum(score(w) for w in re.findall(r"[^\W\d_]+", t.lower()))
        p = np.exp(total - total.max())
        assert got[i].lang_pred == langs[int(total.argmax())] and abs(got[i].score - p.max() / p.sum()) < 1e-3


def test_rare_languages_are_kept(spark):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(40)), "big", None) for k in range(60)] + [(1000 + k, "nadir zenit", "rare", None) for k in range(8)]
    model = lid.fit(make_docs(spark, rows), words=20)
    assert model.langs == ["big", "rare"] and "zenit" in model.words


def test_segments_take_linear_time():
    def spent(n):
        scores = [1.0, -1.5] * n  # falling totals, as in clean text
        start = time.process_time()
        assert len(tox.segments(scores)) == n
        return time.process_time() - start

    spent(1000)
    assert spent(200_000) < 40 * max(spent(20_000), 0.005)


def test_toxic_word_scores_equal_the_definition():
    counts, n_toxic, n_clean = [("bad", 30, 2), ("the", 40, 160), ("fine", 1, 90)], 40, 160
    model = tox.ToxicModel(counts, n_toxic, n_clean)
    for word, t, c in counts:
        share = max(0.01, (t + c) / 200)
        a, b = t + tox.PRIOR * share * 0.2, c + tox.PRIOR * share * 0.8
        odds = math.log(a / (40 + tox.PRIOR - t)) - math.log(b / (160 + tox.PRIOR - c))
        sure = abs(odds) - tox.ERRORS * math.sqrt(1 / a + 1 / b)
        assert (word in model.scores) == (sure > 0)
        if sure > 0:
            assert abs(model.scores[word] - (math.copysign(sure, odds) + tox.DRIFT)) < 1e-12
    assert model.scores["bad"] > 0 > model.scores["fine"]


def test_pipeline_stages_equal_brute_force(spark):
    """Each stage on what its predecessor kept of sf0.01, against plain versions of what it does."""
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(P.STAGES)
    assert [*stages] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
    run = lambda name, df: P.staged(stages[name](spark, df, sf), "test")

    clean = run("toxicity", docs)
    predicted = {r.doc_id: r.predicted for r in tox.score_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    kept = sorted(i for i, y in predicted.items() if y == 0)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.select("doc_id").collect()) == kept and len(kept) < docs.count()

    rows = [(r.doc_id, r.text) for r in clean.select("doc_id", "text").collect()]
    sets, up = [], list(range(len(rows)))
    for _, t in rows:
        ws = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        n = min(5, len(ws))
        sets.append({tuple(ws[a : a + n]) for a in range(len(ws) - n + 1)} if n else set())

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    order = sorted((i for i in range(len(rows)) if sets[i]), key=lambda i: len(sets[i]))
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if len(sets[i]) * 10 < len(sets[j]) * 8:
                break
            both = len(sets[i] & sets[j])
            if both * 10 >= 8 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups[root(i)] = min(doc_id, groups.get(root(i), doc_id))
    single = run("near_duplicates", clean)
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.select("doc_id").collect()) == sorted(groups.values()) and len(groups) < len(rows)

    rows = [(r.doc_id, r.text) for r in single.select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {i for i, *_, bad in brute_windows(rows, items) if bad}
    pure = run("decontamination", single)
    assert pure.columns == docs.columns and sorted(r.doc_id for r in pure.select("doc_id").collect()) == sorted(i for i, _ in rows if i not in hit) and hit

    mixed = run("mixing", pure)
    copies = {r.doc_id: r.copies for r in mixing.plan_mix(pure, residual="nearest").collect() if r.copies}
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.select("doc_id").collect()) == copies

    t, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    out = stages["token_files"](spark, mixed, sf).orderBy("start").collect()
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert Counter(r.doc_id for r in out) == copies and [r.doc_id for r in out] == sorted(r.doc_id for r in out)
    for r in out:
        assert r.start == at
        at += r.n_tokens
    for r in out[:60]:
        ids = np.array([*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def brute_windows(rows, items):
    """(doc_id, contaminated) by a set of all benchmark windows."""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for _, t in items:
        ws = find(t)
        n = min(10, len(ws))
        windows |= {tuple(ws[a : a + n]) for a in range(len(ws) - n + 1)} if n else set()
    sizes = sorted({len(w) for w in windows})
    for i, t in rows:
        ws = find(t)
        yield i, any(tuple(ws[a : a + n]) in windows for n in sizes for a in range(len(ws) - n + 1))


def test_pipeline_runs_on_few_documents(spark):
    import corpus_pipeline as P

    assert P.run(spark, SF).count() > 100
