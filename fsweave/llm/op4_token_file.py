"""Token ids in a fixed-width bit-packed file with block offsets and random access."""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, open_folder, publish, runs, scratch, table, tidy, trim_memory

#: Ids in a block; a block fills whole 64-bit words for any width.
BLOCK = 4096
#: Ids after which a task begins another file, and words in a worker's cache.
ROLL, CACHE = 32 << 20, 600_000
MAGIC = b"FWBITS01"
_HEAD = struct.Struct("<8sIIQQQ")


def pack_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    """Pack ids, each in ``bits`` bits: 64 ids fill ``bits`` little-endian 64-bit words."""
    groups = -(-len(ids) // 64)
    padded = np.zeros(groups * 64, np.uint64)
    padded[: len(ids)] = ids
    rows = padded.reshape(groups, 64)
    out = np.zeros((groups, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return out.reshape(-1)


def unpack_bits(words: np.ndarray, bits: int) -> np.ndarray:
    """Undo :func:`pack_bits`; the length is a multiple of 64."""
    rows = words.reshape(-1, bits)
    out = np.empty((len(rows), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        v = rows[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            v = v | (rows[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = v & mask
    return out.reshape(-1)


def shard_bytes(shard: tuple[int, int], bits: int, doc_ids: list, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: header, doc_ids and their null flags, starts of documents, block offsets, blocks."""
    blocks = -(-len(ids) // BLOCK)
    offsets = np.arange(blocks + 1, dtype="<u8") * (BLOCK // 64 * bits * 8)
    body = pack_bits(ids, bits)
    body = np.concatenate([body, np.zeros(int(offsets[-1]) // 8 - len(body), np.uint64)])
    return b"".join(
        [
            _HEAD.pack(MAGIC, bits, BLOCK, shard[0] << 20 | shard[1], len(doc_ids), len(ids)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            starts.astype("<u8").tobytes(),
            offsets.tobytes(),
            body.astype("<u8", copy=False).tobytes(),
        ]
    )


class Shard:
    """Random access to a file's documents and ids; only the blocks asked for are unpacked."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, self.number, self.n_docs, self.n_ids = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size
        flags = np.frombuffer(data, np.uint8, self.n_docs, at + 8 * self.n_docs)
        self.doc_ids = [None if f else int(d) for d, f in zip(np.frombuffer(data, "<i8", self.n_docs, at), flags)]
        at += 9 * self.n_docs
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        self.data, self.body = data, at + 8 * (blocks + 1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block, -(-stop // self.block)
        a, b = self.offsets[first], self.offsets[last]
        got = unpack_bits(np.frombuffer(self.data, "<u8", int(b - a) // 8, self.body + int(a)), self.bits)
        return got[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


#: ASCII upper case to lower case; signs that end a word without joining what is before them.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_SIGNS = b",.;:!?$%&*#|"
#: Letters that normalizing leaves alone, if in lower case.
_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u017e]+")
#: Words that are encoded in one call, and bytes of a word beyond which it is not remembered.
TOGETHER, LONG = 256, 64


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level models write bytes: printable ones as they are, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordIds:
    """Ids of the words between white space, in one array, with a bounded memory of words.

    The tokenizer writes white space as one space, drops it, and joins nothing over
    it, so a text's ids are those of its words in turn.  It also lower-cases, so words
    are looked up in ASCII lower case, unless a special token may be inside, whose
    spelling counts.  Signs at the end of a word that ends in a letter are tokens of
    their own, so a new word and its signs are encoded apart.  New words of Latin
    letters alone are single units to the tokenizer and are encoded many at once.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(file)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        plain = Tokenizer(self.tokenizer.model)  # the same without normalizing and special tokens
        plain.pre_tokenizer = self.tokenizer.pre_tokenizer
        self.plain = getattr(plain, "encode_batch_fast", plain.encode_batch)
        self.spaced = Tokenizer(self.tokenizer.model)  # units parted by spaces, written in byte letters
        self.spaced.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = byte_letters()
        self.at: dict[bytes, int] = {b"": 0}  # word -> its place in starts
        self.starts, self.pool = np.zeros(2, np.int64), np.empty(0, np.uint32)

    @staticmethod
    def is_normal(text: str) -> bool:
        """Whether normalizing leaves a word as it is and no special token can be in it."""
        return "<|" not in text and text.lower() == text and (text.isascii() or (unicodedata.is_normalized("NFC", text) and not any(c.isspace() for c in text)))

    @staticmethod
    def parts(word: bytes) -> tuple[bytes, bytes]:
        """The word and the signs after it, if they can be looked up apart."""
        if word[-1] not in _SIGNS or b"<|" in word:
            return word, b""
        stem = word.rstrip(_SIGNS)
        if not stem:
            return word, b""
        if not 0x61 <= stem[-1] <= 0x7A:
            last = unicodedata.normalize("NFC", stem.decode()[-1].lower())  # some letters become a letter and a mark
            if not last.isalpha():
                return word, b""
        return stem, word[len(stem) :]

    def fresh(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words in another order, their ids one after the other, and how many each has."""
        units: dict[bytes, str] = {}
        kinds: tuple[list[str], list[str]] = ([], [])
        for w in words:
            if w.isalpha() and w.islower():  # ASCII letters
                units[w] = w.decode()
            elif _LATIN.fullmatch(text := w.decode()) and text.lower() == text:
                units[w] = w.decode("latin-1").translate(self.letters)
            else:
                kinds[self.is_normal(text)].append(text)
        ids, sizes, spelt = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], list(units.values())
        for k in range(0, len(spelt), TOGETHER):
            e = self.spaced.encode(" ".join(spelt[k : k + TOGETHER]), add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            sizes.append(np.bincount(np.array(e.word_ids)))
        for batch, texts in zip((self.batch, self.plain), kinds):
            for k in range(0, len(texts), 4096):
                some = [e.ids for e in batch(texts[k : k + 4096], add_special_tokens=False)]
                ids.append(np.array(list(chain.from_iterable(some)), np.uint32))
                sizes.append(np.array([len(x) for x in some], np.int64))
        return [*units, *(t.encode() for texts in kinds for t in texts)], np.concatenate(ids), np.concatenate(sizes)

    @staticmethod
    def taken(starts: np.ndarray, pool: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at ``at``, and how many each has."""
        begin = starts[at]
        size = starts[at + 1] - begin
        stop = np.cumsum(size)
        return pool[np.repeat(begin - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)], size

    def forget(self) -> None:
        """Of a full memory, keep the half that came first; what comes early is what is frequent."""
        half = CACHE // 2
        self.at = {w: k for w, k in self.at.items() if k < half}
        self.starts = self.starts[: half + 1].copy()
        self.pool = self.pool[: self.starts[-1]].copy()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and their number for each text; nulls are empty."""
        texts = texts.cast(pa.string()).fill_null("")
        if len(self.at) > CACHE:
            self.forget()
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]
        folded = bytearray(bytes(data).translate(_FOLD))
        offsets = offsets - offsets[0]
        for i in np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)):
            folded[offsets[i] : offsets[i + 1]] = data[offsets[i] : offsets[i + 1]]
        split = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(folded)))
        words = split.values.dictionary_encode()
        names = words.dictionary.cast(pa.binary()).to_pylist()
        at = np.fromiter(map(self.at.get, names, repeat(-1)), np.int64, len(names))
        starts, pool = self.starts, self.pool
        if len(new := np.flatnonzero(at < 0)):
            named = [names[k] for k in new.tolist()]
            if max(map(len, named)) > LONG:  # long words last: these are not remembered
                new = new[np.argsort([len(w) > LONG for w in named], kind="stable")]
                named = [names[k] for k in new.tolist()]
            apart = [p for w in named for p in self.parts(w)]
            order, ids, sizes = self.fresh([p for p in dict.fromkeys(apart) if p not in self.at])
            local = dict(zip(order, range(len(starts) - 1, len(starts) - 1 + len(order))))
            code = np.array([self.at[p] if p in self.at else local[p] for p in apart])
            ids, sizes = self.taken(np.append(starts, starts[-1] + np.cumsum(sizes)), np.append(pool, ids), code)
            at[new] = np.arange(len(starts) - 1, len(starts) - 1 + len(new))
            starts = np.append(starts, starts[-1] + np.cumsum(sizes[0::2] + sizes[1::2]))
            pool = np.append(pool, ids)
            named = named[: sum(len(w) <= LONG for w in named)]
            self.at.update(zip(named, range(len(self.starts) - 1, len(self.starts) - 1 + len(named))))
            n = len(self.starts) + len(named)
            self.starts, self.pool = starts[:n], pool[: starts[n - 1]]
        ids, size = self.taken(starts, pool, at[words.indices.to_numpy()])
        bounds = np.append(0, np.cumsum(size))[split.offsets.to_numpy()]
        return ids, np.diff(bounds)


def word_ids(file: str) -> WordIds:
    """The tokenizer and its memory, kept by a worker from task to task until another stage begins."""
    return kept(file, lambda: WordIds(file))


def write_token_files(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 1) -> DataFrame:
    """Encode every whole text, add ``end_id``, and write the ids in ascending doc_id order.

    Returns one row for each file: its name, shard (ascending as the ids go), n_docs,
    n_ids.  Files that are not among these come from lost attempts.
    Null texts count as empty, so such a document has its end id alone.  Null doc_ids
    come first; rows with equal ids are ordered by their texts' hashes.  No rows give
    no files.  Columns other than doc_id and text are ignored.  Texts move once, to be
    sorted by range; a task holds one file's ids (32 M at most) in memory.
    """
    from tokenizers import Tokenizer

    bits = max(1, (max(Tokenizer.from_file(tokenizer_file).get_vocab_size() - 1, end_id)).bit_length())

    def write(batches):
        from pyspark import TaskContext

        fs, path = open_folder(folder)
        cache, part = word_ids(tokenizer_file), TaskContext.get().partitionId()
        ids, pieces, counts, n, rolled = [], [], [], 0, 0

        def flush():
            starts = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            name = publish(fs, path, f"shard-{part:06d}-{rolled:04d}", ".bits", shard_bytes((part, rolled), bits, ids, starts, np.concatenate(pieces)))
            return pa.RecordBatch.from_pydict({"file": pa.array([name]), "shard": pa.array([part << 20 | rolled], pa.int64()), "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([n], pa.int64())})

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in runs(sizes, 4 << 20):
                ids += batch.column(0).slice(a, b - a).to_pylist()
                got, count = cache.encode(batch.column(1).slice(a, b - a))
                count = count + 1
                x = np.full(int(count.sum()), end_id, np.uint16 if bits <= 16 else np.uint32)
                inner = np.ones(len(x), bool)
                inner[np.cumsum(count) - 1] = False
                x[inner] = got
                pieces.append(x)
                counts.append(count)
                n += len(x)
                if n >= ROLL:
                    yield flush()
                    ids, pieces, counts, n, rolled = [], [], [], 0, rolled + 1
        if ids:
            yield flush()
            ids, pieces, counts = [], [], []
        trim_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("__h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "__h").sortWithinPartitions("doc_id", "__h").select("doc_id", "text")
    return ordered.mapInArrow(write, "file string, shard long, n_docs long, n_ids long")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of all files: file, shard, doc_id, local_start, n_tokens, ids_crc32."""

    @tidy
    def read(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(data.as_buffer().to_pybytes())
                crc, lens = [], np.diff(shard.starts)
                for a, b in runs(lens, 1 << 20):
                    lo = int(shard.starts[a])
                    ids = shard.ids(lo, int(shard.starts[b])).astype("<u4", copy=False)
                    crc += [zlib.crc32(ids[int(shard.starts[k]) - lo : int(shard.starts[k + 1]) - lo].tobytes()) for k in range(a, b)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "file": pa.array([path.rpartition("/")[2]] * shard.n_docs),
                        "shard": pa.array([shard.number] * shard.n_docs, pa.int64()),
                        "doc_id": pa.array(shard.doc_ids, pa.int64()),
                        "local_start": pa.array(shard.starts[:-1], pa.int64()),
                        "n_tokens": pa.array(lens, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    schema = "file string, shard long, doc_id long, local_start long, n_tokens long, ids_crc32 long"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bits").load(folder)
    return files.select("path", "content").mapInArrow(read, schema)


def round_trip(docs: DataFrame, tokenizer_file: str, end_id: int = 1) -> DataFrame:
    """Write the files, then return what they hold: doc_id, start, n_tokens, ids_crc32.

    Only the list of files (one for each 32 M ids or task) comes to the driver, where
    the ids before each file are summed.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "token-files")
    files = sorted((r["shard"], r["n_ids"], r["file"]) for r in write_token_files(docs, folder, tokenizer_file, end_id).collect())
    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    before = np.concatenate([[0], np.cumsum([n for _, n, _ in files])])
    offsets = spark.createDataFrame([(f, int(o)) for (_, _, f), o in zip(files, before)], "file string, before long")
    got = read_token_files(spark, folder).join(F.broadcast(offsets), "file")
    return got.select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
