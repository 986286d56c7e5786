"""Archives whose records are large, damaged or packed together."""

import pytest

from fsweave.llm import op1_warc as warc

from .test_dedup import pack, records


def ids(data):
    return [(e.headers or {}).get("warc-record-id", "")[10:-1] or None for e in warc.salvage(warc.Source(data))]


@pytest.mark.parametrize("gz", [True, False])
def test_pages_with_long_urls_come_back(spark, gz):
    pages = spark.createDataFrame([(1, "u" + " " * 400_000, "a"), (2, "v", "b")], "page_id long, url string, html string")
    got = warc.archive_pages(pages, gzip=gz).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(1, 1), (2, 1)]


def test_lost_records_are_an_error(spark, tmp_path):
    a, b, _ = records(3)
    (tmp_path / "a.warc").write_bytes(a + b)
    folder = f"file://{tmp_path}"
    (tmp_path / "of-a-lost-attempt.warc").write_bytes(a)
    assert warc.read_warc(spark, folder, {"a.warc": 2}).count() == 2
    for wrong in ({"a.warc": 3}, {"a.warc": 2, "b.warc": 1}):
        with pytest.raises(Exception, match="written"):
            warc.read_warc(spark, folder, wrong).collect()


def test_members_over_the_spool_and_wrong_lengths(monkeypatch):
    monkeypatch.setattr(warc, "SPOOL", 1000)
    parts = records(30)
    assert ids(pack(b"".join(parts))) == [str(i) for i in range(30)]
    long = parts[0].replace(b"Content-Length: ", b"Content-Length: 99999999999")
    assert ids(long + parts[1]) == [None, "1"]


def test_a_header_without_end_is_given_up():
    a, b, _ = records(3)
    cut = a[: a.index(b"Content-Type: application/http;")]
    assert ids(cut + b) == [None, "1"]
    assert ids(b"WARC/1.1\r\nA: " + b"x" * 3_000_000) == [None]


def stored(data):
    import zlib

    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def test_an_empty_member_only_advances():
    a, b, _ = map(pack, records(3))
    assert ids(pack(b"") + a + pack(b"") + pack(b"") + b + pack(b"")) == ["0", "1"]
    assert ids(b"junk" + pack(b"") + a) == [None, "0"]


@pytest.mark.parametrize("squeeze", [pack, stored])
def test_members_of_several_records_are_salvaged(squeeze):
    parts = records(6)
    after = pack(records(7)[6])
    bad = [p.replace(b"page 2", b"page X") if k == 2 else p for k, p in enumerate(parts)]
    assert ids(squeeze(b"".join(bad)) + after) == ["0", "1", None, "3", "4", "5", "6"]
    bad = [p.replace(b"WARC/1.1", b"W") if k == 0 else p for k, p in enumerate(parts)]
    assert ids(squeeze(b"".join(bad)) + after) == [None, "1", "2", "3", "4", "5", "6"]
    whole = bytearray(squeeze(b"".join(parts)))
    whole[-7] ^= 1  # the checksum
    assert ids(bytes(whole) + after) == ["0", "1", "2", "3", "4", "5", None, "6"]


@pytest.mark.parametrize("squeeze", [pack, stored])
def test_the_readable_part_of_a_cut_member_is_salvaged(squeeze):
    import random

    rng = random.Random(3)
    parts = [warc.page_record(str(i), "u", rng.randbytes(300), None) for i in range(400)]
    whole = squeeze(b"".join(parts))
    cut = whole[: len(whole) // 2]
    found = list(warc.salvage(warc.Source(cut)))
    got = [e.headers["warc-record-id"] for e in found if e.headers]
    assert 190 < len(got) < 210 and got == [f"<urn:page:{i}>" for i in range(len(got))]
    assert found[-1].headers is None and found[-1].stop == len(cut) and found[-1].start == found[-2].stop
    again = ids(cut + pack(parts[399]) + parts[0])
    assert [i for i in again if i] == [*map(str, range(len(got))), "399", "0"] and None in again


def test_a_header_cut_in_a_value_takes_no_other_record():
    a, b, _ = records(3)
    assert ids(a[: a.index(b"1970") + 2] + b"\n" + b) == [None, "1"]
