"""Vector compression by product codes, whose codebooks a filtering Lloyd iteration finds."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, pack_ints, staged, table, tidy, unpack_ints

#: Parts of a vector, entries of a codebook, rounds, steps to a unit.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors in a block, which has a tree for each part position; points in a leaf (about); bound of a component in steps.
BLOCK, LEAF, LIMIT = 16_384, 16, 1 << 24


class Tree:
    """A balanced kd-tree over integer points, with each node's bounding box, sum and count.

    Level ``l`` has 2**l nodes; node ``k`` of it holds the points from ``n * k >> l`` to
    ``n * (k + 1) >> l`` in tree order.  Nodes of all levels lie one after the other.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.points, self.order, self.low, self.high, self.sums = points, order, low, high, sums
        self.depth = (len(low) + 1).bit_length() - 2

    @staticmethod
    def depth_of(n: int) -> int:
        return max(0, (n // LEAF).bit_length() - 1)

    @staticmethod
    def bounds(n: int, level: int) -> np.ndarray:
        return n * np.arange((1 << level) + 1, dtype=np.int64) >> level

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        n, depth = len(points), cls.depth_of(len(points))
        order = np.arange(n)
        for level in range(depth):
            bounds = cls.bounds(n, level)
            inner = points[order]
            wide = (np.maximum.reduceat(inner, bounds[:-1]) - np.minimum.reduceat(inner, bounds[:-1])).argmax(1)
            node = np.repeat(np.arange(1 << level), np.diff(bounds))
            order = order[np.lexsort((inner[np.arange(n), wide[node]], node))]
        inner, leaves = points[order], cls.bounds(n, depth)[:-1]
        low, high, sums = ([f.reduceat(inner, leaves)] for f in (np.minimum, np.maximum, np.add))
        for _ in range(depth):
            low.append(np.minimum(low[-1][0::2], low[-1][1::2]))
            high.append(np.maximum(high[-1][0::2], high[-1][1::2]))
            sums.append(sums[-1][0::2] + sums[-1][1::2])
        return cls(inner, order, *(np.concatenate(x[::-1]) for x in (low, high, sums)))

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each point's nearest entry in tree order (the lower index of equals), and each entry's sum and count.

        Nodes are handled level by level, each with the entries that can be nearest to
        a point of its box.  Of these, one is nearest to the box's middle; another goes
        if the corner of the box that lies furthest on its side is no nearer to it.  A
        node with one entry left is given to it whole; of a leaf, the points are compared
        with the entries left.
        """
        n, k = len(self.points), len(entries)
        codes = np.zeros(n, np.int64)
        total, count = np.zeros_like(entries), np.zeros(k, np.int64)
        nodes, able, index = np.zeros(1, np.int64), np.ones((1, k), bool), np.arange(k)
        for level in range(self.depth + 1):
            at = (1 << level) - 1 + nodes
            low, high, bounds = self.low[at], self.high[at], self.bounds(n, level)
            twice = ((2 * entries - (low + high)[:, None]) ** 2).sum(2)
            star = np.where(able, twice, np.iinfo(np.int64).max).argmin(1)
            best = entries[star][:, None]
            corner = np.where(entries > best, high[:, None], low[:, None])
            worse = ((entries - corner) ** 2).sum(2) - ((best - corner) ** 2).sum(2)
            able &= (worse < 0) | ((worse == 0) & (index <= star[:, None]))
            done = able.sum(1) == 1
            for node, entry in zip(nodes[done].tolist(), star[done].tolist()):
                codes[bounds[node] : bounds[node + 1]] = entry
            np.add.at(total, star[done], self.sums[at[done]])
            np.add.at(count, star[done], (bounds[nodes + 1] - bounds[nodes])[done])
            nodes, able = nodes[~done], able[~done]
            if level < self.depth:
                nodes, able = np.stack([2 * nodes, 2 * nodes + 1], 1).reshape(-1), np.repeat(able, 2, 0)
        if len(nodes):
            size = bounds[nodes + 1] - bounds[nodes]
            stop = np.cumsum(size)
            place = np.repeat(bounds[nodes] - stop + size, size) + np.arange(stop[-1])
            which, entry = np.nonzero(able[np.repeat(np.arange(len(nodes)), size)])
            distance = ((self.points[place[which]] - entries[entry]) ** 2).sum(1)
            first = np.flatnonzero(np.diff(which, prepend=-1))
            least = np.flatnonzero(distance == np.minimum.reduceat(distance, first)[which])
            codes[place] = entry[least[np.flatnonzero(np.diff(which[least], prepend=-1))]]
            np.add.at(total, codes[place], self.points[place])
            count += np.bincount(codes[place], minlength=k)
        return codes, total, count


def quantized(values: np.ndarray) -> np.ndarray:
    """Components in whole steps, rounded down."""
    steps = np.floor(values.astype(np.float64) * SCALE)
    if len(steps) and np.abs(steps).max() > LIMIT:
        raise ValueError(f"a component lies beyond {LIMIT // SCALE}, where sums of squares are not safe")
    return steps.astype(np.int64)


def split(steps: np.ndarray, parts: int) -> np.ndarray:
    """Vectors (rows) as parts x vectors x components of a part."""
    return np.ascontiguousarray(steps.reshape(len(steps), parts, steps.shape[1] // parts).transpose(1, 0, 2))


TREES = "order binary, points binary, low binary, high binary, sums binary"
_TYPES = {"order": np.int32, "points": np.int32, "low": np.int32, "high": np.int32, "sums": np.int64}


def packed(points: np.ndarray) -> dict[str, bytes]:
    """The trees of all part positions of a block."""
    trees = [Tree.build(p) for p in points]
    return {name: pack_ints(np.concatenate([getattr(t, name).reshape(-1) for t in trees]).astype(kind)) for name, kind in _TYPES.items()}


def forest(row: dict, parts: int, width: int):
    """The trees that :func:`packed` wrote, one after the other."""
    arrays = {name: unpack_ints(row[name], kind).reshape(parts, -1) for name, kind in _TYPES.items()}
    for p in range(parts):
        wide = {name: arrays[name][p].astype(np.int64).reshape(-1, width) for name in ("points", "low", "high", "sums")}
        yield Tree(wide["points"], arrays["order"][p], wide["low"], wide["high"], wide["sums"])


def trees_of(vectors: DataFrame, label: str, parts: int, size: int) -> DataFrame:
    """Blocks of vectors (columns id, label, vector) with their trees; each task cuts what it reads."""

    @tidy
    def run(batches):
        held: list[pa.RecordBatch] = []

        def made(rows: pa.Table):
            lists = rows.column("vector").combine_chunks()
            if len(lists) and set(np.unique(np.diff(lists.offsets.to_numpy()))) != {size}:
                raise ValueError(f"all vectors must have {size} components")
            values = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), size)
            out = packed(split(quantized(values), parts))
            one = pa.array([0, len(lists)], pa.int32())
            whole = {name: pa.ListArray.from_arrays(one, rows.column(name).combine_chunks()) for name in ("id", "label")}
            return pa.RecordBatch.from_pydict({"ids": whole["id"], "labels": whole["label"]} | {name: pa.array([out[name]], pa.binary()) for name in _TYPES})

        n = 0
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(a, BLOCK))
                n += held[-1].num_rows
                if n >= BLOCK:
                    rows = pa.Table.from_batches(held)
                    yield made(rows.slice(0, BLOCK))
                    held = rows.slice(BLOCK).to_batches()
                    n -= BLOCK
        if n:
            yield made(pa.Table.from_batches(held))

    return vectors.mapInArrow(run, f"ids array<bigint>, labels array<{label}>, {TREES}")


def moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: entries at the floor of their parts' mean; unused ones stay."""
    parts, entries, width = books.shape

    @tidy
    def run(batches):
        total, count = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                for p, tree in enumerate(forest(batch.slice(k, 1).to_pylist()[0], parts, width)):
                    _, s, c = tree.nearest(books[p])
                    total[p] += s
                    count[p] += c
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(count[part, entry])} | {f"s{j}": pa.array(total[part, entry, j]) for j in range(width)}
        )

    names = [f"s{j}" for j in range(width)]
    got = blocks.select(*_TYPES).mapInArrow(run, "part int, entry int, n long, " + ", ".join(f"{s} long" for s in names))
    out = books.copy()
    for r in got.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect():  # a row for each entry
        out[r["part"], r["entry"]] = [r[s] // r["n"] for s in names]
    return out


def codes_of(blocks: DataFrame, label: str, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    parts, _, width = books.shape

    @tidy
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                trees = row.select(list(_TYPES)).to_pylist()[0]
                ids, labels = (row.column(name).flatten() for name in ("ids", "labels"))
                code, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p, tree in enumerate(forest(trees, parts, width)):
                    near = tree.nearest(books[p])[0]
                    code[tree.order, p] = near
                    error[tree.order] += ((tree.points - books[p][near]) ** 2).sum(1)
                digits = code.tobytes().hex()
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([digits[a : a + 2 * parts] for a in range(0, len(digits), 2 * parts)], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of every usable row of (vec_id, embedding, label), and the codebooks.

    Rows whose vector is null or has null or non-finite components are dropped.  The
    codebooks start from the ``entries`` smallest vec_ids; equal ids are taken in the
    vectors' order, null ids last; with fewer vectors there are fewer entries, of which
    equal ones stay unused but for the first.  Repeated rows each count and each get
    their code; other columns are ignored.  No usable row gives no rows and no entries.
    Vectors of another length than the first, of a length that ``parts`` does not divide,
    or with components beyond ``LIMIT / SCALE`` raise an error.

    Vectors do not move: each task builds its blocks' trees once, writes them to the shared
    folder, and each round reads them there.  A task sends one row for each entry in use;
    the driver holds ``parts * entries`` entries.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits")
    label = rows.schema["label"].dataType.simpleString()
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    vectors = rows.select(F.col("vec_id").cast("long").alias("id"), "label", F.col("embedding").alias("vector")).where(F.col("vector").isNotNull() & fine)
    seeds = [r[0] for r in vectors.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").collect()]
    size = len(seeds[0]) if seeds else parts
    if size % parts or not size or any(len(s) != size for s in seeds):
        raise ValueError(f"all vectors must have one length that {parts} divides")
    books = split(quantized(np.array(seeds, np.float64).reshape(-1, size)), parts)
    if not seeds:
        return rows.sparkSession.createDataFrame([], f"vec_id long, label {label}, code string, error long"), books
    with Work(rows.sparkSession, "vector-codes") as work:
        blocks = work.staged(trees_of(vectors, label, parts, size), "trees")
        for _ in range(rounds):
            books = moved(blocks, books)
        return staged(codes_of(blocks, label, books), "vector-codes"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"])).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """SQL of one round: assign the parts ``p`` to the entries ``b{k}``, then move these to ``b{k + 1}``."""
    return f"""
n{k} AS (SELECT p.vec_id, p.part, min((list_sum(list_transform(list_zip(p.x, b.x), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) * 64 + b.entry)::BIGINT) AS best FROM p JOIN b{k} b USING (part) GROUP BY ALL),
m{k} AS (
  SELECT part, best % 64 AS entry, count(*) AS c, sum(p.x[1])::BIGINT AS s1, sum(p.x[2])::BIGINT AS s2, sum(p.x[3])::BIGINT AS s3, sum(p.x[4])::BIGINT AS s4 FROM n{k} JOIN p USING (vec_id, part) GROUP BY ALL),
b{k + 1} AS (
  SELECT b.part, b.entry, CASE WHEN c IS NULL THEN b.x ELSE list_transform([s1, s2, s3, s4], lambda s: (s - ((s % c) + c) % c) // c) END AS x FROM b{k} b LEFT JOIN m{k} USING (part, entry))"""


OP11_SQL = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, part, x[part * 4 + 1:part * 4 + 4] AS x FROM v, range(16) r(part)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v),
b0 AS (SELECT part, entry, x FROM p JOIN s USING (vec_id) WHERE entry < 64),{_round(0)},{_round(1)},{_round(2)},
e AS (
  SELECT vec_id, string_agg(format('{{:02x}}', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM n2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM e JOIN v USING (vec_id)
"""
