"""WARC archives of pages: writer, sequential reader, revisit records.

`write_pages` writes archives into a folder of the shared store, one gzip
member for each record; `read_archives` streams them: members are inflated in
steps, each record's block is framed by its Content-Length, and its block
digest and the payload digest are verified.  A record that is cut short, badly
framed or of another digest raises `WarcError`; data loss is never silent.

Pages of equal payloads (at least `min_bytes`) share one response record, that
of the smallest page_id; the others are `revisit` records, which carry the
HTTP header, the digest of the whole payload and the id of the response.

Copies are found on digests alone (no html): pages are counted by digest, and
the digests with `heavy_share` of all pages or more, at most 1 / heavy_share
of them, are broadcast; the rest are joined by digest.  So a payload that a
third of all pages share is not sent to one task.

Rows: a NULL html is an empty payload; payloads below `min_bytes` are always
responses; a NULL page_id or url is written as an empty field and read back
NULL, and a NULL page_id is never referred to; repeated rows each get a
record, and all rows of the smallest page_id are responses; an empty table
writes no archive and reads no rows.  A payload of any length is one record,
held by one task at a time.  Other input columns are ignored.
"""
from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_fs, text_bytes
from quarry.session import scratch_uri, stage

MIN_BYTES = 100
#: An archive is closed after the record that takes it to this many bytes.
ARCHIVE_BYTES = 64 << 20
STEP = 1 << 16
#: Tasks that read archives; each takes as many files as that asks for.
MAX_READERS = 100_000
#: Fixed value: no clock enters an archive, so reruns write equal bytes.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"


class WarcError(ValueError):
    """A record that can't be read as it was written."""


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# --- writing ----------------------------------------------------------------

def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own, without a time stamp."""
    head = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in headers)
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + pack.flush()


def _one_line(v: str) -> str:
    """A header value can't hold line ends or outer blanks: they are quoted."""
    return "".join(f"%{ord(c):02X}" if c in "\r\n%" or c < " " else c for c in v).strip()


def _unquoted(v: str) -> str:
    parts = v.split("%")
    return parts[0] + "".join(chr(int(p[:2], 16)) + p[2:] for p in parts[1:])


def page_record(page_id: int | None, url: str | None, html: str | None,
                refers_to: int | None = None) -> bytes:
    """The member of one page: a response, or a revisit of page `refers_to`."""
    payload = text_bytes(html)
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{ID}{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE), ("WARC-Target-URI", "" if url is None else url),
        ("WARC-Payload-Digest", f"sha256:{sha256(payload)}"),
        ("WARC-Block-Digest", f"sha256:{sha256(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block)))]
    if revisit:
        headers[4:4] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{ID}{refers_to}>")]
    return _member(headers, block)


# --- reading ----------------------------------------------------------------

def _members(f: io.RawIOBase) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as an iterator of inflated steps."""
    rest = f.read(STEP)
    while rest:
        state = {"rest": rest}

        def steps() -> Iterator[bytes]:
            z = zlib.decompressobj(31)
            data = state["rest"]
            while True:
                out = z.decompress(data, STEP)
                if out:
                    yield out
                if z.eof:
                    state["rest"] = z.unused_data or f.read(STEP)
                    return
                data = z.unconsumed_tail or f.read(STEP)
                if not data and not out:
                    raise WarcError("an archive ends inside a record")

        yield steps()
        rest = state["rest"]


def _record(steps: Iterator[bytes]) -> Record:
    """One record of a member: header lines, a block of Content-Length bytes
    and the two line ends after it, nothing else."""
    held = bytearray()
    try:
        while b"\r\n\r\n" not in held:
            part = next(steps, None)
            if part is None:
                raise WarcError("a record without the end of its header")
            held += part
        head, _, body = bytes(held).partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/1."):
            raise WarcError(f"not a WARC record: {first[:40]!r}")
        headers = {}
        for x in lines:
            k, colon, v = x.partition(":")
            if not colon:
                raise WarcError(f"not a header line: {x[:40]!r}")
            headers[k.strip().lower()] = v.strip()
        if not headers.get("content-length", "").isdigit():
            raise WarcError("a record without Content-Length")
        size = int(headers["content-length"])
        block = bytearray(body)
        for part in steps:
            block += part
            if len(block) > size + 4:
                raise WarcError("a record is longer than its Content-Length")
    except zlib.error as e:
        raise WarcError(f"bad compression: {e}") from e
    if len(block) != size + 4 or block[size:] != b"\r\n\r\n":
        raise WarcError("a record's length is not its Content-Length")
    return Record(headers, bytes(block[:size]))


def read_records(f: io.RawIOBase) -> Iterator[Record]:
    """Records of one archive in order, block digests verified."""
    for steps in _members(f):
        r = _record(steps)
        want = r.headers.get("warc-block-digest")
        if want is not None and want != f"sha256:{sha256(r.block)}":
            raise WarcError("a block has another digest than its header says")
        yield r


def page_of(r: Record) -> tuple:
    """(page_id, url, payload bytes, payload digest, kind, refers_to, payload);
    a response's payload is held against its length and digest."""
    head, gap, payload = r.block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    digest = r.headers["warc-payload-digest"].removeprefix("sha256:")
    if not gap or (r.kind == "response" and (len(payload) != size or sha256(payload) != digest)):
        raise WarcError("a payload has another length or digest than its header says")

    def page(name: str) -> int | None:
        x = r.headers.get(name, "").removeprefix(f"<{ID}").removesuffix(">")
        return int(x) if x else None

    return (page("warc-record-id"), _unquoted(r.headers["warc-target-uri"]) or None, size, digest,
            r.kind, page("warc-refers-to"), payload if r.kind == "response" else None)


# --- the jobs ---------------------------------------------------------------

def with_first_copy(pages: DataFrame, min_bytes: int = MIN_BYTES,
                    heavy_share: float = 0.001) -> DataFrame:
    """page_id, url, html and `refers_to`: the smallest page_id of an equal
    payload where that is another page's."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"],
                        pages["html"]).withColumn(
        "bytes", F.octet_length(F.coalesce("html", F.lit("")))).withColumn(
        "digest", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    copies = rows.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(
        F.count("*").alias("n"), F.min("page_id").alias("first_id")).where("n > 1")
    copies = stage(copies, "copies")
    total = copies.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") >= max(2, total * heavy_share)
    few = copies.where(heavy).select(F.col("digest").alias("h_digest"),
                                     F.col("first_id").alias("h_first"))
    rest = copies.where(~heavy).select(F.col("digest").alias("r_digest"),
                                       F.col("first_id").alias("r_first"))
    # at most 1 / heavy_share digests reach the share
    near = rows.join(F.broadcast(few), F.col("digest") == F.col("h_digest"), "left")
    # settled rows keep a key of their own, so no key of the shuffle is heavy
    key = F.when(F.col("h_digest").isNull() & (F.col("bytes") >= min_bytes), F.col("digest")) \
        .otherwise(F.concat(F.lit("-"), F.hex(F.xxhash64("page_id", "url"))))
    found = near.withColumn("key", key).join(rest, F.col("key") == F.col("r_digest"), "left")
    first = F.coalesce("h_first", "r_first")
    return found.select("page_id", "url", "html", F.when(
        ~first.eqNullSafe(F.col("page_id")), first).alias("refers_to"))


def write_pages(pages: DataFrame, out: str, archive_bytes: int = ARCHIVE_BYTES,
                **options) -> DataFrame:
    """Write archives under `out`; the frozen list of their names and record
    counts.  A task that is run again writes new names, and only those of the
    attempt that ended are listed."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = arrow_fs(out)
        f, name, n = None, "", 0
        for pdf in batches:
            for page_id, url, html, ref in pdf.itertuples(index=False):
                if f is None:
                    name, n = f"{uuid.uuid4().hex}.warc.gz", 0
                    f = store.open_output_stream(f"{folder}/{name}", compression=None)
                f.write(page_record(None if pd.isna(page_id) else int(page_id), url, html,
                                    None if pd.isna(ref) else int(ref)))
                n += 1
                if f.tell() >= archive_bytes:
                    f.close()
                    yield pd.DataFrame({"name": [name], "records": [n]})
                    f = None
        if f is not None:
            f.close()
            yield pd.DataFrame({"name": [name], "records": [n]})

    store, folder = arrow_fs(out)
    store.create_dir(folder, recursive=True)
    rows = with_first_copy(pages, **options)
    # ids as text: a float could not hold every long
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return stage(rows.mapInPandas(write, "name string, records long"), "archives")


def read_archives(archives: DataFrame, folder_uri: str, payloads: bool = False) -> DataFrame:
    """One row for each record of the listed archives, in the columns of
    `page_of`; an archive with more or fewer records than listed raises."""
    schema = ("page_id long, url string, payload_bytes long, payload_digest string, "
              "record_type string, refers_to long, payload binary")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = arrow_fs(folder_uri)
        names = schema.replace(",", "").split()[::2]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names).astype(
                {"page_id": "Int64", "refers_to": "Int64"})

        for pdf in batches:
            for name, records in pdf[["name", "records"]].itertuples(index=False):
                rows, seen = [], 0
                with store.open_input_stream(f"{folder}/{name}", compression=None) as f:
                    for r in read_records(f):
                        seen += 1
                        page = page_of(r)
                        rows.append(page if payloads else (*page[:-1], None))
                        if len(rows) >= 1000:
                            yield frame(rows)
                            rows = []
                if seen != records:
                    raise WarcError(f"{name}: {seen} records of {records}")
                if rows:
                    yield frame(rows)

    # a task for each archive or so: their list is small, their contents aren't
    return archives.repartition(max(1, min(archives.count(), MAX_READERS))).mapInPandas(
        read, schema)


def archive_pages(spark: SparkSession, pages: DataFrame, out: str | None = None,
                  **options) -> DataFrame:
    """Write the archives under `out` (default: the shared folder) and return
    the pages that are read back from them."""
    out = out or scratch_uri(spark, "warc")
    return read_archives(write_pages(pages, out, **options), out)
