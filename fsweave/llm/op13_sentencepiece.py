"""SentencePiece encoding by backtracking over longest matches, and decoding."""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, runs, table, tidy
from .op6_token_counts import pre_tokens

#: The mark that stands for a space.
MARK = "▁"
#: Units and pairs that a worker remembers; characters of a unit beyond which it is not remembered.
CACHE, PAIRS, LONG = 600_000, 400_000, 64
#: Bytes of text that are encoded together.
TOGETHER = 2 << 20
#: Fixed values of the model file: kinds of piece, and BPE as the kind of model.
NORMAL, CONTROL, BYTE, BPE = 1, 3, 6, 2
NEVER = float("-inf")


class PieceBpe:
    """The merges of a piece model, without the library's encoder.

    The encoding of a text is what is left when the two neighbours whose union has the
    best score, the leftmost of equals, are merged until no union is a piece.  A row of
    pieces is that encoding if and only if each piece is the encoding of itself and no
    two neighbours, merged anew from their characters, come out differently: before the
    first merge over a border, both sides would have merged as they do alone.
    """

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        model = proto.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        plain = model.normalizer_spec
        kinds = {p.type for p in model.pieces} - {2}
        if model.trainer_spec.model_type != BPE or not model.trainer_spec.byte_fallback or kinds - {NORMAL, CONTROL, BYTE}:
            raise ValueError("only merge models with byte fallback and without pieces of the user's are encoded here")
        if plain.precompiled_charsmap or plain.remove_extra_whitespaces or not plain.add_dummy_prefix or not plain.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave characters as they are and put one mark in front are encoded here")
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.score):
            raise ValueError("a piece joins what units part")
        #: Neighbours within pieces; between any others, nothing merges.
        self.joined = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.id = {p.piece: k for k, p in enumerate(model.pieces) if p.type == NORMAL}
        byte_ids = [k for k, p in enumerate(model.pieces) if p.type == BYTE]
        self.byte_ids, self.end_id = byte_ids, self.library.eos_id()
        whole = [p for p in self.score if len(p) > 1 and self.merged(p)[0] == [p]]
        self.automaton = ahocorasick.Automaton()
        for k, p in enumerate(whole):
            self.automaton.add_word(p[::-1], k)
        self.automaton.make_automaton()
        known = set(whole)
        #: For each piece, the longest shorter one that it starts with; a character has none.
        self.shorter = {p: next(k for k in range(len(p) - 1, 0, -1) if k == 1 or p[:k] in known) for p in whole}
        #: Pieces are also named by numbers: those above from 0 on, then characters by their code points.
        self.whole, number, self.chars = whole, {p: k for k, p in enumerate(whole)}, len(whole)
        self.sizes = np.array([len(p) for p in whole], np.int64)
        self.next = np.array([number.get(p[: self.shorter[p]], self.chars + ord(p[0])) for p in whole], np.int64)
        self.whole_ids = np.array([self.id[p] for p in whole], np.int32)
        self.char_ids = np.full(0x110000, -1, np.int32)
        for p, k in self.id.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = k
        self.fits: dict[int, bool] = {}
        self.known_steps: dict[str, tuple] = {}

    def merged(self, text: str) -> tuple[list[str], list[float], list[str], list[str]]:
        """Merge from single characters on, best score first, leftmost of equals.

        Returns the pieces that are left; and before each merge and at the end the score
        of the next merge (``NEVER`` at the end), the first piece and the last one.
        """
        parts, score = list(text), self.score
        unions = [score.get(text[k : k + 2], NEVER) for k in range(len(text) - 1)]
        scores, firsts, lasts = [], [parts[0]], [parts[-1]]
        while True:
            scores.append(max(unions, default=NEVER))
            if scores[-1] == NEVER:
                return parts, scores, firsts, lasts
            k = unions.index(scores[-1])
            parts[k] += parts.pop(k + 1)
            del unions[k]
            if k:
                unions[k - 1] = score.get(parts[k - 1] + parts[k], NEVER)
            if k < len(unions):
                unions[k] = score.get(parts[k] + parts[k + 1], NEVER)
            firsts.append(parts[0])
            lasts.append(parts[-1])

    def steps(self, piece: str) -> tuple[list[float], list[str], list[str]]:
        """How a piece merges: scores, first and last parts, as :meth:`merged` gives them."""
        got = self.known_steps.get(piece)
        if got is None:
            got = self.merged(piece)[1:]
            if piece in self.shorter or len(self.known_steps) < CACHE:
                self.known_steps[piece] = got
        return got

    def named(self, code: int) -> str:
        return self.whole[code] if code < self.chars else chr(code - self.chars)

    def compatible(self, pair: int) -> bool:
        """Whether two pieces (numbers ``pair >> 21`` and the rest) stay as they are when merged anew as one text.

        Both sides merge as they do alone, the better next merge first, the left one of
        equals, until the union over the border would come before both, or neither has
        a merge left.
        """
        got = self.fits.get(pair)
        if got is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            a, b = self.named(pair >> 21), self.named(pair & 0x1FFFFF)
            got = self.fits[pair] = a[-1] + b[0] not in self.joined or self.merge_apart(a, b)
        return got

    def merge_apart(self, a: str, b: str) -> bool:
        left, _, lasts = self.steps(a)
        right, firsts, _ = self.steps(b)
        i = j = 0
        while True:
            over = self.score.get(lasts[i] + firsts[j], NEVER)
            if over > left[i] and over >= right[j]:
                return False
            if left[i] == right[j] == NEVER:
                return True
            if left[i] >= right[j]:
                i += 1
            else:
                j += 1

    def longest(self, text: str) -> np.ndarray:
        """The number of the longest piece that starts at each place, or of the character there.

        The automaton holds the pieces backwards and reads the text backwards, so that
        what ends at a place there starts at it here; longer ones are reported first.
        """
        out = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + self.chars
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text[::-1])), np.int64).reshape(-1, 2)
        first = found[np.diff(found[:, 0], prepend=-1) != 0]
        out[len(text) - 1 - first[:, 0]] = first[:, 1]
        return out

    def pieces(self, text: str) -> list[int]:
        """The encoding of one text without white space handling, from left to right, as numbers.

        At each place the longest piece is tried first, then the shorter ones that it
        starts with.  Where none fits, the place is marked as failed and its piece gives
        way.  The encoding of a text's start is unique, so a place that failed once
        fails always, and each is left at most once.
        """
        n, out, at, fits = len(text), [], 0, self.fits.get
        longest, failed, chars = self.longest(text).tolist() + [-1], bytearray((n >> 3) + 1), self.chars
        piece = longest[0]
        while at < n:
            while piece >= 0:
                end = at + (int(self.sizes[piece]) if piece < chars else 1)
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or fits(pair := out[-1] << 21 | piece) or self.compatible(pair)):
                    out.append(piece)
                    at, piece = end, longest[end]
                    break
                piece = int(self.next[piece]) if piece < chars else -1
            else:
                if not out:
                    raise ValueError("no row of pieces is the encoding of this text")
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= int(self.sizes[piece]) if piece < chars else 1
                piece = int(self.next[piece]) if piece < chars else -1
        return out

    def pieces_of_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for many short texts in step: numbers one after the other, and how many each text has."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        stops = np.cumsum(sizes + 1) - 1  # a line feed after each text: no piece holds one, so none reaches over it
        longest = self.longest("\n".join(texts) + "\n")
        chars, into, there, failed = self.chars, np.full(len(longest), -1, np.int64), np.zeros(len(longest), bool), np.zeros(len(longest), bool)
        start, live = stops - sizes, np.flatnonzero(sizes)
        start, stop = start[live], stops[live]
        at, piece = start.copy(), longest[start]

        def size_of(code):
            return np.where(code < chars, self.sizes[np.minimum(code, chars - 1)], 1)

        def shorter(code):
            return np.where((code >= 0) & (code < chars), self.next[np.minimum(code, chars - 1)], -1)

        while len(at):
            end = at + size_of(piece)
            fine = piece >= 0
            fine[fine] = ~failed[end[fine]]
            asks = np.flatnonzero(fine & (at > start))
            pairs = (into[at[asks]] << 21 | piece[asks]).tolist()
            fits = list(map(self.fits.get, pairs))
            fine[asks] = [self.compatible(p) if f is None else f for f, p in zip(fits, pairs)]
            into[end[fine]] = piece[fine]
            there[end[fine]] = True
            at[fine] = end[fine]
            done = at == stop
            piece[fine] = longest[at[fine]]
            missed = np.flatnonzero(~fine)
            piece[missed] = shorter(piece[missed])
            back = missed[piece[missed] < 0]
            if len(back):
                if (at[back] == start[back]).any():
                    raise ValueError("no row of pieces is the encoding of this text")
                failed[at[back]] = True
                there[at[back]] = False
                last = into[at[back]]
                at[back] -= size_of(last)
                piece[back] = shorter(last)
            if done.any():
                on = ~done
                at, piece, start, stop = at[on], piece[on], start[on], stop[on]
        ends = np.flatnonzero(there)
        return into[ends], np.diff(np.searchsorted(ends, stops, "right"), prepend=0)

    def ids_of(self, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each text has; characters without an id are written in bytes."""
        single = codes >= self.chars
        ids = np.where(single, self.char_ids[np.where(single, codes - self.chars, 0)], self.whole_ids[np.where(single, 0, codes)])
        rare = np.flatnonzero(ids < 0)
        if not len(rare):
            return ids, counts
        spelt = [chr(c).encode() for c in (codes[rare] - self.chars).tolist()]
        width = np.ones(len(ids), np.int64)
        width[rare] = [len(b) for b in spelt]
        at = np.append(0, np.cumsum(width))
        out = np.repeat(ids, width)
        out[out < 0] = np.array(self.byte_ids, np.int32)[np.frombuffer(b"".join(spelt), np.uint8)]
        return out, np.diff(at[np.append(0, np.cumsum(counts))])

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in which marks stand for spaces: those of up to ``LONG`` characters in step, longer ones one by one."""
        alone = [k for k, t in enumerate(texts) if len(t) > LONG]
        codes, counts = self.pieces_of_many([t if len(t) <= LONG else "" for t in texts])
        if alone:
            at = np.cumsum(counts)[alone]
            made = [np.array(self.pieces(texts[k]), np.int64) for k in alone]
            sizes = [len(m) for m in made]
            codes = np.insert(codes, np.repeat(at, sizes), np.concatenate(made))
            counts[alone] = sizes
        return self.ids_of(codes, counts)


def spelt(unit: str) -> str:
    """A unit of :func:`pre_tokens` with marks for its spaces."""
    return (unit if unit[:1] == "\n" else MARK + unit).replace(" ", MARK)


class UnitIds:
    """Ids of units in one array, with a bounded memory of units."""

    def __init__(self, model_file: str):
        self.model = PieceBpe(model_file)
        self.at: dict[str, int] = {}  # unit -> its place in starts
        self.starts, self.pool = np.zeros(1, np.int64), np.empty(0, np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts with their end ids, one after the other, and how many each text has."""
        if len(self.at) > CACHE:  # keep the half that came first; what comes early is what is frequent
            half = CACHE // 2
            self.at = {u: k for u, k in self.at.items() if k < half}
            self.starts = self.starts[: half + 1].copy()
            self.pool = self.pool[: self.starts[-1]].copy()
        split = [pre_tokens(t) if t else [] for t in texts]
        units = list(chain.from_iterable(split))
        code = np.fromiter(map(self.at.get, units, repeat(-1)), np.int64, len(units))
        starts, pool, known = self.starts, self.pool, len(self.starts) - 1
        missing = np.flatnonzero(code < 0).tolist()
        if missing:
            new = sorted(dict.fromkeys(units[k] for k in missing), key=lambda u: len(u) > LONG)  # long ones last: not remembered
            ids, sizes = self.model.encode_texts(list(map(spelt, new)))
            starts = np.append(starts, starts[-1] + np.cumsum(sizes))
            pool = np.append(pool, ids)
            place = dict(zip(new, range(known, known + len(new))))
            code[missing] = [place[units[k]] for k in missing]
            short = [u for u in new if len(u) <= LONG]
            self.at.update(zip(short, range(known, known + len(short))))
            self.starts = starts[: known + len(short) + 1]
            self.pool = pool[: self.starts[-1]]
        begin = starts[code]
        size = starts[code + 1] - begin
        stop = np.cumsum(size)
        ids = pool[np.repeat(begin - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]
        bounds = np.append(0, stop)[np.append(0, np.cumsum([len(u) for u in split], dtype=np.int64))]
        counts = np.diff(bounds)
        return np.insert(ids, bounds[1:], self.model.end_id).astype(np.int32, copy=False), counts + 1


def _in_parts(batch: pa.RecordBatch, sizes: list[int]):
    for a, b in runs(sizes, TOGETHER):
        yield batch.slice(a, b - a)


def encode_pieces(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id and ids (the end id last) of every whole text, as the library gives them.

    Null and empty texts have the end id alone.  Null doc_ids and repeated rows pass
    through; other columns are ignored; no documents give no rows.  A text of any length
    is encoded in time linear in it.  Texts part into units between which no piece
    reaches; a worker remembers a bounded number of them.  Nothing is shuffled.
    """

    @tidy
    def run(batches):
        memory = kept(model_file, lambda: UnitIds(model_file))
        for batch in batches:
            for part in _in_parts(batch, pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
                ids, counts = memory.encode(part.column(1).to_pylist())
                offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, ids)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids and the text that the library decodes ids to (column ``decoded``); null ids decode to the empty text."""

    @tidy
    def run(batches):
        import sentencepiece

        library = kept(model_file, lambda: sentencepiece.SentencePieceProcessor(model_file=model_file))
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_pylist()
            for a, b in runs(sizes, TOGETHER >> 2):
                part = batch.slice(a, b - a)
                lists = part.column(1)
                flat, bounds = lists.flatten().to_numpy(zero_copy_only=False).tolist(), np.append(0, np.cumsum(sizes[a:b])).tolist()
                texts = [library.decode(flat[i:j]) if i < j else "" for i, j in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    both = decode_pieces(encode_pieces(table(spark, sf_dir, "documents"), model), model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
