"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_share, staged, table, tidy

#: Labelled documents read for the fit (about); the model has all of their words that tell the kinds apart.
FIT_DOCS = 20_000
#: Mass of the Dirichlet prior, standard errors taken off a log-odds, score of a neutral token, level of a significant segment.
PRIOR, ERRORS, DRIFT, LEVEL = 20.0, 2.0, -0.15, 0.05
EULER = 0.5772156649015329
_WORD = re.compile(r"[^\W\d_]+")


def is_held_out(doc_id="doc_id"):
    """crc32 of the doc_id as text, mod 5, is 0; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences (start, stop, score), in one pass of linear time.

    Candidates are kept with the cumulative score before and after them.  A new one
    joins the nearest earlier candidate that starts lower, if that ends lower too.  Each
    candidate knows the nearest earlier one that starts lower than itself, so the search
    passes over what lies between: that starts no lower.
    """
    found: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left, j = i, before, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((start, i + 1, left, total, j))
                break
            start, _, left, _, before_it = found[j]
            del found[j:]
            j = before_it
    return [(a, b, right - left) for a, b, left, right, _ in found]


class ToxicModel:
    """Token scores, the extreme-value law of clean text, and the map from evidence to a score."""

    def __init__(self, counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int):
        self.scores: dict[str, float] = {}
        self.rate = n_toxic / (n_toxic + n_clean) if n_toxic + n_clean else 0.0
        self.able = bool(n_toxic and n_clean)
        self.scale, self.log_k, self.line = 1.0, 0.0, (-4.0, 1.0)
        for word, t, c in counts if self.able else []:
            prior_t, prior_c = (PRIOR * max(0.01, (t + c) / (n_toxic + n_clean)) * n for n in (self.rate, 1 - self.rate))
            a, b = t + prior_t, c + prior_c
            odds = math.log(a / (n_toxic + PRIOR - t)) - math.log(b / (n_clean + PRIOR - c))
            sure = abs(odds) - ERRORS * math.sqrt(1 / a + 1 / b)
            if sure > 0:
                self.scores[word] = math.copysign(sure, odds) + DRIFT

    def token_scores(self, text: str | None) -> list[float]:
        get = self.scores.get
        return [get(w, DRIFT) for w in _WORD.findall(text.lower())] if text else []

    def fit_law(self, tokens: Counter, best: list[tuple[float, int]]) -> None:
        """Scale from the token scores of clean documents, location from their best segments."""
        n = sum(tokens.values())
        if any(s > 0 for s in tokens) and sum(s * k for s, k in tokens.items()) < 0:
            low, high = 1e-6, 64.0
            moment = lambda x: sum(k * math.exp(min(700.0, x * s)) for s, k in tokens.items()) / n
            for _ in range(100):
                mid = (low + high) / 2
                low, high = (mid, high) if moment(mid) < 1 else (low, mid)
            self.scale = low
        values = [self.scale * s - math.log(m) for s, m in best if m and s > 0]
        self.log_k = float(np.mean(values)) - EULER if values else 0.0

    def evidence(self, scores: list[float]) -> tuple[float, list[tuple[int, int, float]]]:
        """Sum of -ln p over significant segments, and these (start, stop, p)."""
        out, total = [], 0.0
        if scores and max(scores) > 0:
            size = math.log(len(scores)) + self.log_k
            for a, b, s in segments(scores):
                expected = math.exp(min(50.0, size - self.scale * s))
                p = -math.expm1(-expected)
                if p <= LEVEL:
                    out.append((a, b, p))
                    total -= math.log(max(p, 1e-300))
        return total, out

    def fit_line(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression on the evidence, by Newton steps with a small ridge."""
        if not len(x):
            return
        z = np.stack([np.ones(len(x)), np.log1p(x)], 1)
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ w))
            g = z.T @ (p - y) + 1e-3 * w
            h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
            step = np.linalg.solve(h, g)
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        self.line = (float(w[0]), max(0.0, float(w[1])))

    def score_of(self, scores: list[float]) -> float:
        if not self.able:
            return self.rate
        total, _ = self.evidence(scores)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.line[0] + self.line[1] * math.log1p(total)))))


def fit(docs: DataFrame, labels: DataFrame, bound: int = FIT_DOCS) -> ToxicModel:
    """Learn from about ``bound`` labelled documents, chosen by hash of the id, none held out.

    A document with several labels counts as toxic if one of them says so; null labels
    are none.  Words count once for each document that has them, so that one long text
    cannot make a word toxic.  Counts are summed within tasks first.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = hashed_share(marks.count(), bound)
    chosen = marks.where(F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1 << 20)) < share)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    sample = staged(rows.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxic-fit")

    def count(batches):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                seen[y > 0].update(set(_WORD.findall(text.as_py().lower())))
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict({"word": pa.array(names, pa.string()), "t": pa.array([seen[1][w] for w in names], pa.int64()), "c": pa.array([seen[0][w] for w in names], pa.int64())})

    n: dict[bool, int] = {}
    for r in sample.groupBy((F.col("toxic") > 0).alias("y")).count().collect():
        n[r["y"]] = r["count"]
    summed = sample.mapInArrow(count, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    rows = summed.where("t + c >= 3").collect()
    model = ToxicModel([(r["word"], r["t"], r["c"]) for r in rows], n.get(True, 0), n.get(False, 0))
    if not model.able:
        return model
    shared = spark.sparkContext.broadcast(model)

    def measure(batches):
        """Per task: how often clean documents have each token score (rounded); per document: best segment, words."""
        own = shared.value
        for batch in batches:
            out = []
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                s = own.token_scores(text.as_py())
                hot = max(s, default=0) > 0
                out.append((int(y > 0), max((x[2] for x in segments(s)), default=0.0) if hot else 0.0, len(s), [round(x, 1) for x in s if x != DRIFT]))
            yield pa.RecordBatch.from_pydict({"y": pa.array([o[0] for o in out], pa.int32()), "best": pa.array([o[1] for o in out], pa.float64()), "n": pa.array([o[2] for o in out], pa.int64()), "s": pa.array([o[3] for o in out], pa.list_(pa.float64()))})

    got = staged(sample.mapInArrow(measure, "y int, best double, n long, s array<double>"), "toxic-law")
    clean = got.where("y = 0")
    tokens = Counter({r[0]: r[1] for r in clean.select(F.explode("s").alias("s")).groupBy("s").count().collect()})
    tokens[DRIFT] += max(0, (clean.agg(F.sum("n")).first()[0] or 0) - sum(tokens.values()))
    model.fit_law(tokens, [(r[0], r[1]) for r in clean.select("best", "n").collect()])
    shared = spark.sparkContext.broadcast(model)

    def weigh(batches):
        own = shared.value
        for batch in batches:
            x = [own.evidence(own.token_scores(t.as_py()))[0] for t in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.float64()), "y": batch.column(1)})

    pairs = sample.mapInArrow(weigh, "x double, y int").collect()
    model.fit_line(np.array([p[0] for p in pairs], float), np.array([float(p[1] > 0) for p in pairs]))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, bound: int = FIT_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted, and passages (first and last word, p) of every whole text.

    Null and empty texts have no evidence and get the lowest score.  Without labels of
    both kinds nothing can be learned: every score is the share of toxic labels (0 if
    there are none).  Null ids are not held out; repeated rows are scored alike.  A text
    may have any length.  No documents give no rows.
    The model's size is bounded by its parameters, so it is broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, bound))

    @tidy
    def run(batches):
        own = model.value
        for batch in batches:
            score, spans = [], []
            for text in batch.column(2):
                s = own.token_scores(text.as_py())
                score.append(own.score_of(s))
                spans.append([{"start": a, "stop": b, "p": p} for a, b, p in own.evidence(s)[1]] if score[-1] >= 0.5 else [])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "held_out": batch.column(1),
                    "score": pa.array(score, pa.float64()),
                    "predicted": pa.array([int(x >= 0.5) for x in score], pa.int32()),
                    "passages": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))),
                }
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, passages array<struct<start:int,stop:int,p:double>>")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not reject, with all their columns.

    Null and empty texts have no evidence and stay, as does everything where nothing
    could be learned, also where all labels are of one kind.  Repeated rows are judged alike.  Whole texts are scored, in time
    linear in their length.  No documents give no rows; other columns may have any names.
    """
    fitted = fit(docs, labels)
    if not fitted.able:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    @tidy
    def keep(batches):
        own = model.value
        for batch in batches:
            yield batch.filter(pa.array([own.score_of(own.token_scores(t.as_py())) < 0.5 for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("passages")
