"""WARC archives: a writer, and a reader that salvages what follows damage."""

from __future__ import annotations

import base64
import hashlib
import re
import tempfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_folder, publish, scratch, staged, table, tidy

#: Bytes after which a writer begins another file, up to which Spark hands a file to its reader, and up to which an unpacked gzip member stays in memory.
ROLL, INLINE, SPOOL = 32 << 20, 64 << 20, 64 << 20
#: Bytes searched, and unpacked, at once.
_CHUNK, _PIECE = 1 << 20, 1 << 16
_CUT = "gzip member is cut short"
_GZIP, _VERSION, _END = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record: version line, header fields, Content-Length, block."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + _END


def page_record(page: str, url: str | None, payload: bytes, refers_to: str | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A page as response, or as revisit of the page ``refers_to``, which leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page}>"),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)),
        ("WARC-Block-Digest", "sha1:" + sha1_base32(block)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", _PROFILE)]
    return record_bytes(fields, block)


@dataclass
class Entry:
    """A record that passed all checks, or a quarantined gap (``headers`` is None and ``reason`` says why)."""

    start: int
    stop: int
    headers: dict[str, str] | None = None
    block: bytes = b""
    reason: str = ""
    http: dict[str, str] = field(default_factory=dict)

    @property
    def payload(self) -> bytes:
        """The block without the HTTP header, for HTTP records."""
        return self.block.split(_END, 1)[1] if self.http else self.block


class Damage(Exception):
    """A failed check: its reason and, for a member with valid records, where the last one ended."""


class Source:
    """Random reads and searches over bytes or a seekable file, in chunks."""

    def __init__(self, data: bytes | None = None, file=None, size: int = 0):
        self.data, self.file, self.size = data, file, len(data) if data is not None else size
        self.last: dict[bytes, tuple[int, int]] = {}

    def read(self, at: int, n: int) -> bytes:
        if self.data is not None:
            return self.data[at : at + n]
        self.file.seek(at)
        return self.file.read(max(0, min(n, self.size - at)))

    def find(self, what: bytes, at: int) -> int:
        """The first place from ``at`` on; a stretch known from the last search is not read again."""
        since, found = self.last.get(what, (0, 0))
        if not since <= at <= (found if found >= 0 else self.size):
            self.last[what] = since, found = at, self._find(what, at)
        return found

    def _find(self, what: bytes, at: int) -> int:
        while at < self.size:
            chunk = self.read(at, _CHUNK + len(what) - 1)
            k = chunk.find(what)
            if k >= 0:
                return at + k
            at += _CHUNK
        return -1


def parse_record(source: Source, at: int) -> Entry:
    """The record at ``at``, all checks passed; else raises Damage.

    A header may have any length.  It is given up at its first line that is no field, so
    that a damaged one is not followed through the file.
    """
    head = source.read(at, 4096)
    if not re.match(rb"WARC/1\.\d\r\n", head):
        raise Damage("no version line")
    while (k := head.find(_END)) < 0:
        if any(b":" not in x and x[:1] not in (b" ", b"\t") for x in head.split(b"\r\n")[1:-1]):
            raise Damage("header field without colon")
        if at + len(head) >= source.size:
            raise Damage("header without end")
        head = source.read(at, 4 * len(head))
    lines = head[:k].split(b"\r\n")
    headers: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        text = line.decode("utf-8", "replace")
        if line[:1] in (b" ", b"\t") and name:
            headers[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise Damage("header field without colon")
        if name in headers and name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
            raise Damage("header runs into another")
        headers[name] = value.strip()
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit() or len(length) > 18:
        raise Damage("bad Content-Length")
    if "warc-type" not in headers or "warc-record-id" not in headers:
        raise Damage("mandatory field missing")
    n = int(length)
    if source.read(at + k + 4 + n, 4) != _END:  # before the block is read, since the length may be wrong
        raise Damage("record does not end where its length says")
    entry = Entry(at, at + k + 8 + n, headers, source.read(at + k + 4, n))
    _check_digest(headers.get("warc-block-digest"), entry.block, "block")
    if headers.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        top, found, _ = entry.block.partition(_END)
        if not found:
            raise Damage("HTTP header without end")
        entry.http = {a.strip().lower(): b.strip() for a, _, b in (x.decode("latin-1").partition(":") for x in top.split(b"\r\n")[1:])} | {"": top.split(b"\r\n")[0].decode("latin-1")}
    if headers["warc-type"] != "revisit":
        _check_digest(headers.get("warc-payload-digest"), entry.payload, "payload")
    return entry


def _check_digest(said: str | None, data: bytes, what: str) -> None:
    kind, _, value = (said or "").partition(":")
    if kind.lower() == "sha1" and value.upper() not in (sha1_base32(data), hashlib.sha1(data).hexdigest().upper()):
        raise Damage(f"{what} digest differs")


def _unpack(source: Source, at: int, enough: int | None = None) -> tuple[Source, int, str]:
    """What can be unpacked of the gzip member at ``at``, where reading it ended, and what is wrong with it.

    A large member is unpacked to disk.  With ``enough`` it ends at the first byte after
    which so many bytes are out.  Where a piece fails or has enough, it is taken again
    byte by byte.
    """
    engine, out, fault = zlib.decompressobj(31), tempfile.SpooledTemporaryFile(SPOOL), ""
    step = _PIECE
    while not engine.eof and not fault and (enough is None or out.tell() < enough):
        chunk = source.read(at, step)
        if not chunk:
            fault = _CUT
            break
        before = engine.copy() if step > 1 else None
        try:
            piece = engine.decompress(chunk)
        except zlib.error as e:
            piece, fault = b"", f"gzip: {e}"
        if before is not None and (fault or (enough is not None and out.tell() + len(piece) >= enough)):
            engine, step, fault = before, 1, ""
            continue
        out.write(piece)
        at += len(chunk) - len(engine.unused_data)
    return Source(file=out, size=out.tell()), at, fault


def _member(source: Source, at: int) -> Iterator[Entry]:
    """Records of the gzip member at ``at`` and the gaps beside them, which name the unpacked bytes.

    A valid member without content gives nothing.  Raises Damage, with the place up to
    which the member was used, if it has no valid record or is itself damaged; what
    comes after its last valid record is left to the caller then.  Members inside a damaged
    one are read too, since a block cut short swallows what follows it in the file.  The
    only record of a member that fails gzip's checks is not used: nothing else covers its header.
    """
    data, stop, fault = _unpack(source, at)
    with data.file:
        if fault:
            used, alone = 0, False
            for e in salvage(data):
                if e.headers:
                    used, alone = e.stop, e.start == 0
            alone = alone and _next(data, used) == data.size
            if not used or (alone and fault != _CUT):
                raise Damage(fault, at)
            inner, stop, _ = _unpack(source, at, used)
            inner.file.close()
            data.size = used
        for e in salvage(data, not fault):
            if e.headers is None:
                if e.start == 0 and e.stop == data.size:
                    raise Damage(e.reason, at)
                e.reason += f", unpacked bytes {e.start} to {e.stop}"
            e.start, e.stop = at, stop
            yield e
    if fault:
        raise Damage(fault, stop)


def _next(source: Source, at: int) -> int:
    """Where the next gzip member or version line may begin, from ``at`` on; the end if nowhere."""
    gz, plain = source.find(_GZIP, at), source.find(_VERSION, at)
    while plain > 0 and source.read(plain - 1, 1) != b"\n":
        plain = source.find(_VERSION, plain + 1)
    return min([k for k in (gz, plain) if k >= 0], default=source.size)


def salvage(source: Source, unpacked: bool = False) -> Iterator[Entry]:
    """All valid records in order, and between them the gaps that failed.

    After a failed check the search goes on right behind the place where the damaged
    record began, since its length cannot be trusted.  A member or version line found
    there counts only if its record passes all checks; the bytes up to it are one
    gap with the first failure's reason.  Plain and gzip members may be mixed.  The bytes
    of a member, so far as they can be ``unpacked``, are searched in the same way; a damaged
    member's gap begins where its last valid record ends, be it of no length.
    """
    at, gap, reason = 0, -1, ""
    while at < source.size:
        stop = -1
        try:
            if unpacked or source.read(at, 3) != _GZIP:
                entries = iter([parse_record(source, at)])
            else:
                entries = _member(source, at)
            for e in entries:
                if gap >= 0:
                    yield Entry(gap, at, reason=reason)
                    gap = -1
                stop = e.stop
                yield e
        except Damage as e:
            why, end = e.args if len(e.args) == 2 else (str(e), at)
            if gap < 0:
                gap, reason = end, why
            at = _next(source, max(at + 1, end))
            continue
        if stop < 0:  # a member without content
            stop = _unpack(source, at)[1] if gap < 0 else _next(source, at + 1)
        at = stop
    if gap >= 0:
        yield Entry(gap, source.size, reason=reason)


def write_warc(pages: DataFrame, folder: str, smallest: int = 0, gzip: bool = True) -> DataFrame:
    """Write a record for each page and return the list of files: file, records, bytes.

    Of pages with equal payloads of at least ``smallest`` bytes the one with the smallest
    page_id is the response and the others revisit it.  A null html is an empty payload.
    Null page_ids come after all others and have no id in their record.  Rows with the
    same id and payload tie, and all are responses.  An empty table gives no file.

    Only digests are grouped; the join back splits a payload that many pages have.  Names
    are never used twice; files of lost attempts are not in the list.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size"))
    first = staged(rows.where(F.col("size") >= smallest).groupBy("digest", "size").agg(F.min("page_id").alias("first_id")), "payloads")
    rows = rows.join(first.hint("merge"), ["digest", "size"], "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))

    @tidy
    def write(batches):
        from pyspark import TaskContext

        fs, path = open_folder(folder)
        part, rolled, out, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            name = publish(fs, path, f"part-{part:06d}-{rolled:04d}", ".warc" + ".gz" * gzip, b"".join(out))
            return pa.RecordBatch.from_pydict({"file": pa.array([name]), "records": pa.array([len(out)], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(k) for k in range(4))):
                record = page_record("" if page_id.as_py() is None else str(page_id), url.as_py(), html.as_py().encode(), None if refers.as_py() is None else str(refers))
                if gzip:
                    engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                    record = engine.compress(record) + engine.flush()
                out.append(record)
                size += len(record)
                if size >= ROLL:
                    yield flush()
                    out, size, rolled = [], 0, rolled + 1
        if out:
            yield flush()

    return rows.mapInArrow(write, "file string, records long, bytes long")


_READ = "file string, start long, stop long, reason string, warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload binary, payload_bytes long"


def _rows(file: str, source: Source, written: dict[str, int] | None = None) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in _READ.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split(" ")[1]] for f in _READ.split(", ")]
    held, size, found = [], 0, 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held), kinds)], names=names)

    for e in salvage(source):
        h = e.headers
        if h is None:
            held.append((file, e.start, e.stop, e.reason, *[None] * 7))
        else:
            digest = h.get("warc-payload-digest", "").rpartition(":")[2] or sha1_base32(e.payload)
            full = e.http.get("content-length", "")
            n = int(full) if h["warc-type"] == "revisit" and full.isdigit() else len(e.payload)
            held.append((file, e.start, e.stop, None, h["warc-type"], h["warc-record-id"].strip("<>"), h.get("warc-target-uri"), h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None, digest, e.payload, n))
            size += len(e.payload)
            found += 1
        if size >= 8 << 20 or len(held) >= 5000:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()
    if written is not None and found != written[_name(file)]:
        raise ValueError(f"{file}: {found} records read, {written[_name(file)]} written")


def _name(path: str) -> str:
    return path.rpartition("/")[2]


def read_warc(spark: SparkSession, folder: str, written: dict[str, int] | None = None) -> DataFrame:
    """Records and quarantined gaps of all WARC files in ``folder``.

    A gap has file, start, stop and reason, and nulls elsewhere.  Files up to 64 MB come
    through Spark and may lie in any store that it reads; larger ones are read in
    chunks through their own file system.  A revisit's payload is empty; its digest and
    payload_bytes are those of the full payload.

    With ``written``, the number of records of each file by its name, only these files
    are read, and it is an error if one is missing or has more or fewer.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(folder)
    if written is not None and (lost := written.keys() - {_name(f) for f in files.inputFiles()}):
        raise ValueError(f"{folder} lacks files that were written: {sorted(lost)[:5]}")

    @tidy
    def inline(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if written is not None and _name(path) not in written:  # of a lost attempt
                    continue
                yield from _rows(path, Source(content.as_buffer().to_pybytes()), written)

    @tidy
    def streamed(batches):
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if written is not None and _name(path) not in written:
                    continue
                fs, name = open_folder(path)
                with fs.open_input_file(name) as f:
                    yield from _rows(path, Source(file=f, size=size), written)

    small = files.where(F.col("length") <= INLINE).select("path", "content").mapInArrow(inline, _READ)
    large = files.where(F.col("length") > INLINE).select("path", "length").mapInArrow(streamed, _READ)
    return small.unionByName(large)


def archive_pages(pages: DataFrame, smallest: int = 0, gzip: bool = True) -> DataFrame:
    """Write the pages' archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    It is an error if the records read are not as many as were written.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    written = {r.file: r.records for r in write_warc(pages, folder, smallest, gzip).collect()}  # a row for each 32 MB
    if not written:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:page:(-?[0-9]+)', 1) AS BIGINT)")
    return read_warc(spark, folder, written).where(F.col("reason").isNull()).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (
  SELECT page_id, strlen(payload) AS payload_bytes, hex, min(page_id) OVER (PARTITION BY hex) AS first_id,
         array_to_string(list_transform(string_split(hex, ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', c)]), '') AS bits
  FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(list_sum(list_transform(range(5), lambda k: CAST(substr(bits, i * 5 + k + 1, 1) AS INT) * (16 >> k))) AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b
"""
