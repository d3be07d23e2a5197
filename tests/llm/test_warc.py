import gzip
import io
import zlib

import pytest

from quarry.llm import warc

PAGES = [(1, "http://a", "x" * 200), (2, "http://b\r\n%", "x" * 200), (3, None, None), (4, "u", ""),
         (5, "u", "tiny"), (6, "u", "tiny"), (None, "n", "x" * 200), (1, "http://a", "x" * 200),
         (9, "big", "ü€" * 300_000), (8, "big", "ü€" * 300_000)]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*p, "v", "v") for p in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, "
                                       "key string")


def test_round_trip(spark, pages):
    got = warc.archive_pages(spark, pages).collect()
    rows = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0, r["payload_bytes"],
                   r["url"]) for r in got)
    assert rows == sorted([
        (1, "response", 0, 200, "http://a"), (1, "response", 0, 200, "http://a"),
        (2, "revisit", 1, 200, "http://b\r\n%"), (3, "response", 0, 0, None),
        (4, "response", 0, 0, "u"), (5, "response", 0, 4, "u"), (6, "response", 0, 4, "u"),
        (0, "revisit", 1, 200, "n"), (8, "response", 0, 1_500_000, "big"),
        (9, "revisit", 8, 1_500_000, "big")])
    for r in got:
        html = next(p[2] or "" for p in PAGES if p[0] == r["page_id"])
        assert r["payload_digest"] == warc.sha256(html.encode())
    assert warc.archive_pages(spark, pages.limit(0)).count() == 0


def test_heavy_and_light_copies_agree(pages):
    def found(share):
        return sorted((r["page_id"] or 0, r["refers_to"] or 0) for r in
                      warc.with_first_copy(pages, heavy_share=share).collect())
    assert found(1e-9) == found(0.5) == found(2.0)


def members():
    return [warc.page_record(1, "u", "y" * 100_000), warc.page_record(2, "u", "z"),
            warc.page_record(3, "v", "y" * 100_000, 1)]


def test_members_stand_alone_and_stream():
    every = b"".join(members())
    got = list(warc.read_records(io.BytesIO(every)))
    assert [r.kind for r in got] == ["response", "response", "revisit"]
    assert warc.page_of(got[0])[6] == b"y" * 100_000 and warc.page_of(got[2])[2] == 100_000
    assert gzip.decompress(members()[1]).startswith(b"WARC/1.1\r\n")
    assert every == b"".join(members())  # reruns write equal bytes


@pytest.mark.parametrize("spoil", [
    lambda b: b[:-9], lambda b: b[:30],
    lambda b: zlib_member(gzip.decompress(b).replace(b"yyy", b"yyq", 1)),
    lambda b: zlib_member(gzip.decompress(b)[:-4]),
    lambda b: zlib_member(gzip.decompress(b) + b"more"),
    lambda b: zlib_member(gzip.decompress(b).replace(b"Content-Length", b"Content-Lenght")),
    lambda b: zlib_member(b"HTTP/1.1 200 OK\r\n\r\n"),
    lambda b: b[:40] + bytes([b[40] ^ 255]) + b[41:]])
def test_damage_raises(spoil):
    bad = spoil(members()[0])
    with pytest.raises(warc.WarcError):
        for r in warc.read_records(io.BytesIO(bad)):
            warc.page_of(r)


def zlib_member(data):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()
