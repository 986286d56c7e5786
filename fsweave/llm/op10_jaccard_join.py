"""Exact n-gram Jaccard join and its components, by a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, WordHashes, mix64, pack_ints, runs, staged, table, tidy, unpack_ints, window_hashes

#: Bytes of text and documents in a block, members of a group and bytes of their sets (about), queries that meet a group in one task, tokens for which a bucket is meant.
BLOCK_BYTES, BLOCK_DOCS, GROUP, GROUP_BYTES, QUERIES, BUCKET_TOKENS = 2 << 20, 4096, 256, 4 << 20, 512, 1 << 19
#: Share of a set's size by which members of a group may differ, in size and in tokens that no other set has.
BAND = 0.03
#: Fixed odd multipliers of the shingle hash and of the min-hashes.
BASE, SEEDS = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
#: Bits kept of a shingle's hash for comparing sets; sizes are counted with all 64.
BITS = 48
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def shingles(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Ascending distinct hashes of a text's shingles; a shorter text is one shingle, one without words none."""
    ws = text.encode().translate(_LOWER).split() if text else []
    if not ws:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(hashes.of(ws), min(words, len(ws)), BASE))


class SetBlock:
    """The sets of some documents, one after the other."""

    def __init__(self, sizes: np.ndarray, flat: np.ndarray):
        self.sizes, self.flat = sizes, flat
        self.ends = np.cumsum(sizes)

    def pack(self) -> tuple[bytes, bytes]:
        return pack_ints(self.sizes.astype(np.uint32)), pack_ints(np.diff(self.flat, prepend=np.uint64(0)))

    @staticmethod
    def unpack(sizes: bytes, flat: bytes) -> SetBlock:
        return SetBlock(unpack_ints(sizes, np.uint32).astype(np.int64), np.cumsum(unpack_ints(flat, np.uint64), dtype=np.uint64))

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.ends[i] - self.sizes[i] : self.ends[i]]


_SETS = "blk long, rid long, doc_id long, th long, n long, k1 long, k2 long, m0 long, m1 long, m2 long, sizes binary, flat binary"


def _batch(names: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a record batch with the columns of a DDL schema."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split(" ") for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[f for f, _ in fields])


def _build(words: int):
    @tidy
    def build(batches):
        """A row for each document (its size, the set's digest, min-hashes), and one with all sets for each block."""
        from pyspark import TaskContext

        hashes, part, turn = WordHashes(), TaskContext.get().partitionId(), 0
        rows, sets, size = [], [], 0

        def flush():
            blk = part << 16 | turn
            out = [(blk, blk << 13 | i, *r, None, None) for i, r in enumerate(rows)]
            block = SetBlock(np.array([len(s) for s in sets], np.int64), np.concatenate(sets))
            return _batch(_SETS, [*out, (blk, -1, *[None] * 8, *block.pack())])

        for batch in batches:
            for doc_id, text, th in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py()
                s = shingles(text, words, hashes)
                mixed = [mix64(s * np.uint64(k)) for k in SEEDS]
                ms = [int(x.min().view(np.int64)) if len(s) else None for x in mixed]
                rows.append((doc_id, th, len(s), int(mixed[0].sum(dtype=np.uint64).view(np.int64)), int(mixed[1].sum(dtype=np.uint64).view(np.int64)), *ms))
                sets.append(np.unique(s >> np.uint64(64 - BITS)))
                size += len(text or "")
                if size >= BLOCK_BYTES or len(rows) >= BLOCK_DOCS:
                    yield flush()
                    rows, sets, size, turn = [], [], 0, turn + 1
        if rows:
            yield flush()

    return build


class Sets:
    """The sets of all documents, written once in blocks and bucketed by block; they are never shuffled."""

    def __init__(self, docs: DataFrame, words: int, work: Work):
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th"))
        buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.all = work.bucketed(rows.mapInArrow(_build(words), _SETS), "sets", buckets, "blk")
        self.docs = self.all.where("rid >= 0").drop("blk", "sizes", "flat")
        self.blocks = self.all.where("rid = -1").select("blk", "sizes", "flat")

    def with_rows(self, rows: DataFrame, more: DataFrame | None = None) -> DataFrame:
        """Each block with the rows (rid first, longs) that lie in it, as column ``rows``, and ``more`` by blk."""
        blk = F.shiftright("rid", 13)
        told = rows.select(blk.alias("blk"), F.array(*[F.col(c).cast("long") for c in rows.columns]).alias("r")).groupBy("blk").agg(F.collect_list("r").alias("rows"))
        out = self.blocks.join(told.hint("merge"), "blk")
        return out.join(more.hint("merge"), "blk", "left") if more is not None else out

    def fetch(self, rows: DataFrame) -> DataFrame:
        """The sets of rows (rid, n, tag, role): the same columns and the set as ``s``."""

        @tidy
        def fetch(batches):
            for batch in batches:
                for sizes, flat, told in zip(batch.column("sizes"), batch.column("flat"), batch.column("rows")):
                    block = SetBlock.unpack(sizes.as_py(), flat.as_py())
                    told = told.as_py()
                    for a, b in runs((block.sizes[r[0] & 8191] * 8 + 64 for r in told), 2 << 20):
                        yield _batch("rid long, n long, tag long, role long, s binary", [(*r, block[r[0] & 8191].tobytes()) for r in told[a:b]])

        return self.with_rows(rows.select("rid", "n", "tag", "role")).mapInArrow(fetch, "rid long, n long, tag long, role long, s binary")


class Group:
    """The members of a group: the union of their tokens, and which members have each."""

    def __init__(self, members: list[tuple[int, int, np.ndarray]]):
        self.rids = [m[0] for m in members]
        self.n = np.array([m[1] for m in members], np.int64)
        flat = np.concatenate([m[2] for m in members])
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(members), dtype=np.int32), [len(m[2]) for m in members])[order]
        self.union, starts = np.unique(flat[order], return_index=True)
        self.starts = np.append(starts, len(flat))

    def hits(self, s: np.ndarray) -> np.ndarray:
        """Where the union has the tokens of ``s``; their number bounds the overlap with any member."""
        at = np.searchsorted(self.union, s)
        at[at == len(self.union)] = 0
        return at[self.union[at] == s]

    def overlaps(self, hits: np.ndarray) -> np.ndarray:
        """The overlap with each member, from all members' tokens at ``hits``."""
        a, b = self.starts[hits], self.starts[hits + 1]
        step = np.ones(int((b - a).sum()), np.int64)
        if not len(step):
            return np.zeros(len(self.n), np.int64)
        step[0] = a[0]
        ends = np.cumsum(b - a)[:-1]
        step[ends] = a[1:] - b[:-1] + 1
        return np.bincount(self.owner[np.cumsum(step)], minlength=len(self.n))

    def similar(self, n: int, s: np.ndarray, num: int, den: int) -> np.ndarray:
        """Members at the threshold; the group is opened only if the union's bound allows one."""
        hits = self.hits(s)
        if len(hits) * (num + den) < num * (n + int(self.n.min())):
            return np.empty(0, np.int64)
        k = self.overlaps(hits)
        return np.flatnonzero(k * den >= num * (n + self.n - k))


def _tagged(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) within each tag's rows (rid, n, tag, role, set).

    A tag's members (role 0) fit into memory.  If there are queries (role 1), these
    pass one by one and meet the members; else the members meet each other, and pairs
    that are already joined through others are left out.
    """

    def among(members: list) -> list[tuple[int, int]]:
        if len(members) < 2:
            return []
        group, forest, links = Group(members), Forest(len(members)), []
        for i, (rid, n, s) in enumerate(members):
            for j in group.similar(n, s, num, den):
                if j < i and forest.root(i) != forest.root(int(j)):
                    forest.join(i, int(j))
                    links.append((rid, group.rids[j]))
        return links

    @tidy
    def run(batches) -> Iterator[pa.RecordBatch]:
        tag, members, group, links = None, [], None, []
        for batch in batches:
            for rid, n, t, role, s in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                if t != tag:
                    if group is None:
                        links += among(members)
                    tag, members, group = t, [], None
                s = np.frombuffer(s.as_buffer(), np.uint64)
                if role == 0:
                    members.append((rid, n, s.copy()))
                    continue
                if group is None and members:
                    group, members = Group(members), []
                links += [(rid, group.rids[j]) for j in group.similar(n, s, num, den)] if group else []
            if len(links) >= 10_000:
                yield _batch("a long, b long", links)
                links = []
        links += among(members) if group is None else []
        if links:
            yield _batch("a long, b long", links)

    return rows.repartition("tag").sortWithinPartitions("tag", "role").mapInArrow(run, "a long, b long")


class Forest:
    """Union-find over a few items."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.root(i)] = self.root(j)


def components(links: DataFrame, work: Work) -> DataFrame:
    """(rid, comp): the smallest rid reachable, for every rid in ``links`` (a, b).

    Each round takes the least label among neighbours, then the label's label, and is
    written out; rounds end when no label changes.
    """
    both = work.staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = work.staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")), "labels")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "l").hint("merge"), "b").groupBy("a").agg(F.min("l").alias("m"))
        step = labels.join(near.hint("merge"), "a").select("a", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jump = labels.select(F.col("a").alias("l"), F.col("l").alias("j"))
        new = work.staged(step.join(jump.hint("merge"), "l").select("a", "old", F.least("l", "j").alias("l")), "labels")
        labels = new.select("a", "l")
        if new.where("l <> old").limit(1).count() == 0:
            return labels.select(F.col("a").alias("rid"), F.col("l").alias("comp"))


def _counts(shift: int):
    @tidy
    def counts(batches):
        """Distinct tokens of each block's chosen sets with their number there, parted by high bits."""
        for batch in batches:
            for blk, sizes, flat, told in zip(*(batch.column(k) for k in ("blk", "sizes", "flat", "rows"))):
                block = SetBlock.unpack(sizes.as_py(), flat.as_py())
                chosen = np.zeros(len(block.sizes), bool)
                chosen[[r[0] & 8191 for r in told.as_py()]] = True
                tokens, n = np.unique(block.flat[np.repeat(chosen, block.sizes)], return_counts=True)
                bucket = (tokens >> np.uint64(shift)).astype(np.int64)
                edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else [0]
                rows = [(int(bucket[a]), blk.as_py(), pack_ints(np.diff(tokens[a:b], prepend=np.uint64(0))), pack_ints(n[a:b].astype(np.uint32))) for a, b in zip(edges[:-1], edges[1:])]
                if rows:
                    yield _batch("bucket long, blk long, t binary, n binary", rows)

    return counts


def _shared(pdf):
    """For each block the tokens that other sets have too, and in how many sets they are."""
    import pandas as pd

    parts = [np.cumsum(unpack_ints(t, np.uint64), dtype=np.uint64) for t in pdf["t"]]
    tokens, at = np.unique(np.concatenate(parts), return_inverse=True)
    n = np.bincount(at, np.concatenate([unpack_ints(x, np.uint32) for x in pdf["n"]]), len(tokens)).astype(np.uint32)[at]
    rows, start = [], 0
    for blk, part in zip(pdf["blk"], parts):
        mine = n[start : start + len(part)]
        start += len(part)
        if (mine > 1).any():
            rows.append((blk, pack_ints(np.diff(part[mine > 1], prepend=np.uint64(0))), pack_ints(mine[mine > 1])))
    return pd.DataFrame(rows, columns=["blk", "t", "n"])


_PREFIX = "tok long, rid long, n long, r long, top long"


def _prefixes(num: int, den: int):
    @tidy
    def prefixes(batches):
        """Prefix tokens, rarest first, that other sets have too: token, rid, n, tokens of the set from there on, and from the first such one on."""
        for batch in batches:
            for sizes, flat, told, more in zip(*(batch.column(k) for k in ("sizes", "flat", "rows", "more"))):
                block = SetBlock.unpack(sizes.as_py(), flat.as_py())
                shared = [(np.cumsum(unpack_ints(x["t"].as_py(), np.uint64), dtype=np.uint64), unpack_ints(x["n"].as_py(), np.uint32)) for x in more.values or []] if more.is_valid else []
                if not shared:
                    continue
                tokens, n = (np.concatenate(x) for x in zip(*shared))
                order = np.argsort(tokens)
                tokens, n = tokens[order], n[order]
                rows: list[tuple] = []
                held = 0

                def flush():
                    columns = [np.concatenate(c) for c in zip(*rows)]
                    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["tok", "rid", "n", "r", "top"])

                for rid, size in told.as_py():
                    s = block[rid & 8191]
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    many = np.where(tokens[at] == s, n[at], 1)
                    keep = max(1, size - -(-num * size // den) + 1 + (len(s) - size))
                    alone = int((many == 1).sum())
                    if alone >= keep:  # so many tokens that no other set has that none can be similar
                        continue
                    k = np.lexsort((s, many))[alone:keep]
                    same = np.ones(len(k), np.int64)
                    rows.append((s[k], same * rid, same * size, len(s) - np.arange(alone, keep), same * (len(s) - alone)))
                    held += len(k)
                    if held >= 50_000:
                        yield flush()
                        rows, held = [], 0
                if rows:
                    yield flush()

    return prefixes


def link(docs: DataFrame, work: Work, words: int = 3, num: int = 9, den: int = 10) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, th, rid, n, k1, k2) and the components of sets (k1, k2, n, comp, first_id).

    1. Equal sets become one node.  2. Nodes with a common min-hash are compared in
    groups, for three min-hashes; this joins most of what is alike.  3. Nodes are
    partitioned into groups: parts of a component, or nodes with a common min-hash,
    of like size and with as many tokens in common with others.  The token-group matrix
    has a row for each token of a member's prefix and group.  Members of a group meet
    each other.  A node meets the groups that share a token of its prefix, except
    those of its own component, if the tokens from there on can suffice on both sides;
    the union of a group's tokens bounds the overlap; only groups that can qualify are
    opened.  4. Components of all links.

    No link between components is lost.  All sets order their tokens alike, those in
    the fewest sets first.  Two sets of n and m tokens at the threshold have at least
    a = num * (n + m) / (num + den) in common.  From the first of these on, each of the
    two has at least a tokens, so the first is in the prefix of both and passes.
    """
    sets = Sets(docs, words, work)
    nodes = sets.docs.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("first_id"), *[F.min(m).alias(m) for m in ("m0", "m1", "m2")])
    nodes = work.staged(nodes, "nodes")

    def grouped(rows: DataFrame, by: str) -> DataFrame:
        """rows with ``by``'s count as ``many`` and the number of groups it needs as ``parts``."""
        parts = F.ceil(F.greatest(F.count(F.lit(1)) / GROUP, F.sum("n") * 8 / GROUP_BYTES))
        many = work.staged(rows.groupBy(by).agg(F.count(F.lit(1)).alias("many"), parts.alias("parts")), "many")
        return rows.join(many.hint("merge"), by)

    part = F.pmod(F.xxhash64("rid"), "parts")
    found = []
    for k in range(3):
        rows = grouped(nodes.select("rid", "n", F.col(f"m{k}").alias("m")), "m").where("many > 1")
        rows = rows.select("rid", "n", F.xxhash64(F.lit(k), "m", part).alias("tag"), F.lit(0).alias("role"))
        found.append(work.staged(_tagged(sets.fetch(rows), num, den), "links"))
    links = found[0].unionByName(found[1]).unionByName(found[2])
    comps = components(links, work)

    total = nodes.agg(F.sum("n")).first()[0] or 0
    shift = BITS - max(6, int(total // BUCKET_TOKENS).bit_length())
    counts = sets.with_rows(nodes.select("rid")).mapInArrow(_counts(shift), "bucket long, blk long, t binary, n binary")
    told = work.staged(counts.groupBy("bucket").applyInPandas(_shared, "blk long, t binary, n binary"), "shared-tokens")
    told = told.groupBy("blk").agg(F.collect_list(F.struct("t", "n")).alias("more"))
    matrix = work.staged(sets.with_rows(nodes.select("rid", "n"), told).mapInArrow(_prefixes(num, den), _PREFIX), "prefix-tokens")

    def enough(r: str, n: str, m: str):
        """Whether ``r`` common tokens can suffice for sets of ``n`` and ``m``."""
        return F.col(r) * (num + den) >= (F.col(n) + F.col(m)) * num

    # groups of what can still have a link: of one component, or of one min-hash, of like size and rest
    live = matrix.groupBy("rid").agg(F.first("n").alias("n"), F.first("top").alias("top"))
    live = live.join(comps.hint("merge"), "rid", "left").join(nodes.select("rid", "m0").hint("merge"), "rid")
    bands = [F.floor(F.log("n") / float(np.log1p(BAND))), F.floor((F.col("n") - F.col("top")) / (F.col("n") * BAND))]
    label = F.when(F.col("comp").isNull(), F.xxhash64(F.lit(1), "m0", *bands)).otherwise(F.xxhash64(F.lit(2), "comp"))
    live = work.staged(live.select("rid", "n", F.xxhash64(label, *bands).alias("like"), label.alias("label"), F.col("comp").isNull().alias("alone")), "live")
    groups = grouped(live, "like").select("rid", "n", F.xxhash64("like", part).alias("gid"), "label", "alone")
    groups = work.staged(groups.withColumn("label", F.when(F.col("alone"), F.col("gid")).otherwise(F.col("label"))), "groups")
    # members of one group that are of no component yet meet each other
    alone = grouped(groups.where("alone").select("rid", "n", F.col("gid").alias("tag")), "tag").where("many > 1")
    inner = work.staged(_tagged(sets.fetch(alone.select("rid", "n", "tag", F.lit(0).alias("role"))), num, den), "links")
    # tokens that sets of several labels have, where the smallest of these leaves room for enough common tokens
    matrix = work.staged(matrix.drop("top").join(groups.select("rid", "gid", "label").hint("merge"), "rid"), "token-groups")
    useful = matrix.groupBy("tok").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("n").alias("low")).where("x <> y").select("tok", "low")
    matrix = work.staged(matrix.join(work.staged(useful, "useful-tokens").hint("merge"), "tok").where(enough("r", "n", "low")).drop("low"), "token-groups")
    sides = work.staged(matrix.groupBy("tok", "gid", "label").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("r").alias("best")), "group-tokens")
    q = matrix.select("tok", "rid", "n", "r", F.col("gid").alias("own"), F.col("label").alias("mine"))
    fits = (F.col("n") * den >= F.col("low") * num) & (F.col("high") * den >= F.col("n") * num) & enough("r", "n", "low") & enough("best", "n", "low")
    pairs = q.join(sides.hint("merge"), "tok").where((F.col("own") < F.col("gid")) & (F.col("mine") != F.col("label")) & fits)
    pairs = work.staged(pairs.groupBy("rid", "gid").agg(F.first("n").alias("n")), "candidates")
    load = work.staged(pairs.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("parts")), "group-loads")
    queries = pairs.join(load.hint("merge"), "gid").select("rid", "n", F.xxhash64("gid", part).alias("tag"), F.lit(1).alias("role"))
    members = groups.join(load.hint("merge"), "gid").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    members = members.select("rid", "n", F.xxhash64("gid", "part").alias("tag"), F.lit(0).alias("role"))
    more = work.staged(_tagged(sets.fetch(queries.unionByName(members)), num, den).unionByName(inner), "links")
    if more.limit(1).count():
        comps = components(links.unionByName(more), work)
    whole = nodes.join(comps.hint("merge"), "rid", "left").select("k1", "k2", "n", F.coalesce("comp", "rid").alias("comp"), "first_id")
    return sets.docs.select("doc_id", "th", "rid", "n", "k1", "k2"), work.staged(whole, "components")


def jaccard_components(docs: DataFrame, words: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id: documents whose shingle sets reach Jaccard num/den, and what follows.

    component_id is the smallest doc_id reachable by links, itself included.  Null and
    empty texts, and texts without words, have no shingles, link with nothing, and are
    their own component.  A null doc_id is linked like others but is no smallest id; it
    is null where its component has no other.  Equal rows are linked.  An empty table
    gives no rows; columns other than doc_id and text are ignored.  A text may have any
    length; its set must fit into memory.

    Sets are compared by 48 bits of each shingle's hash; the sizes count all 64.  A
    token of n sets is taken for another with probability 2**-48 for each pair.
    """
    with Work(docs.sparkSession, "jaccard-join") as work:
        rows, comps = link(docs, work, words, num, den)
        least = work.staged(comps.groupBy("comp").agg(F.min("first_id").alias("component_id")), "least")
        ids = work.staged(comps.join(least.hint("merge"), "comp").select("k1", "k2", "n", "component_id"), "component-ids")
        joined = rows.where("n > 0").join(ids.hint("merge"), ["k1", "k2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        none = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return staged(joined.unionByName(none), "jaccard-components")


def keep_one(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; all its columns.

    Texts without words, null and empty ones among them, are no copies and stay.  Rows
    with one doc_id and one text count as copies, of which one stays (which of them, if
    they differ in other columns, is settled by a hash of the whole row).  Null doc_ids
    come last.  An empty table gives no rows; other columns may have any names.  Whole
    texts are compared, however long.  Ids and digests are judged; then the texts move
    once, in a join by doc_id and the text's hash.
    """
    with Work(docs.sparkSession, "keep-one") as work:
        rows, comps = link(docs, work, words, num, den)
        joined = rows.where("n > 0").join(comps.hint("merge"), ["k1", "k2", "n"])
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
        best = joined.groupBy("comp").agg(F.min(order).alias("best")).select("best.doc_id", "best.th", F.lit(True).alias("one"))
        best = best.unionByName(rows.where("n = 0").select("doc_id", "th", F.lit(False).alias("one")).distinct())
        repeats = rows.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("rows"))
        same = [F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("none"), "th"]
        best = best.select(*same, "one").join(repeats.select(*same, "rows").hint("merge"), ["k", "none", "th"])
        best = staged(best.withColumn("choose", F.col("one") & (F.col("rows") > 1)).drop("one", "rows"), "kept")
    named = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*named).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("none"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    keys = ["k", "none", "th"]
    kept = packed.join(best.where("NOT choose").drop("choose").hint("merge"), keys).select("row")
    chosen = best.where("choose").drop("choose")
    if chosen.limit(1).count():
        hashed = F.xxhash64(*[F.col(f"row.`{f.name}`") for f in packed.schema["row"].dataType if "map<" not in f.dataType.simpleString()])
        several = packed.join(chosen.hint("merge"), keys).groupBy(*keys).agg(F.min_by("row", hashed).alias("row"))
        kept = kept.unionByName(several.select("row"))
    return kept.select("row.*")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(ws[i : i + least(3, len(ws)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 2) + 1)) AS i FROM d WHERE len(ws) > 0)),
c AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
e AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY ALL)
  JOIN c ca ON ca.r = a JOIN c cb ON cb.r = b WHERE 100 * k >= 90 * (ca.n + cb.n - k)),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles,
       coalesce(least(d.doc_id, (SELECT min(o.doc_id) FROM reach JOIN d o ON o.r = reach.b WHERE reach.a = d.r)), d.doc_id) AS component_id
FROM d LEFT JOIN c ON c.r = d.r
"""
