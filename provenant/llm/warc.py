"""WARC archives: a writer with revisit records, and a splittable reader.

An archive file is a chain of gzip members, one for each record, parted by empty members, which decompress to nothing.
Spark's text sink writes it: its line separator is the empty member, so files appear in any store, by the committers that
survive lost executors. Archives of other writers, whose members follow one another and whose names may end in .gz, are
read in the same way.

To read, Spark's text source scans byte ranges of the files for the gzip magic, which is its line separator there; each
task owns the records that start in its range and reads its last one beyond the range's end. What stands between two
magics is a candidate: its gzip and WARC headers are decoded, and if that fails the magic was chance within another
member's compressed bytes, so the candidate is joined to what came before. Candidates that a range begins with and can't
decode belong to the last member of an earlier range; these few are put together by file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm.common import bounded_batches, column, cut, map_batches, scratch_path, utf8

MAGIC = b"\x1f\x8b\x08"
#: A gzip member of no bytes.
EMPTY = MAGIC + b"\x00\x00\x00\x00\x00\x00\x03\x03\x00" + b"\x00" * 8
#: Payloads of at least so many bytes are written once.
LEAST = 100
#: Most digests that several pages share that are broadcast, at about 60 bytes each; more are joined by a shuffle.
MOST_BROADCAST = 200_000
LEVEL = 4
#: A fixed date, as the tables have none, so archives of equal tables are equal.
DATE = "1970-01-01T00:00:00Z"


def _headers(pairs: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode("utf-8", "replace") for k, v in pairs if v is not None) + b"\r\n"


def _uri(url: str | None) -> str | None:
    """A target as it can stand in a header line: None stays away, control characters and spaces are percent-encoded."""
    return None if url is None else "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """A record as a gzip member. A revisit has the payload's digest and length, but no block."""
    block = b"" if is_revisit else payload
    head = [
        ("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if is_revisit else None), ("WARC-Refers-To", f"<urn:page:{refers_to}>" if is_revisit else None),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload)), ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(block)),
    ]
    data = _headers(head) + block + b"\r\n\r\n"
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    return MAGIC + b"\x00\x00\x00\x00\x00\x00\x03" + pack.compress(data) + pack.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def member(data: bytes) -> tuple[bytes, bool] | None:
    """What a gzip member at data's start holds and whether it is complete; None if there is none."""
    stream = zlib.decompressobj(31)
    try:
        got = stream.decompress(data)
    except zlib.error:
        return None
    return got, stream.eof


def parse(data: bytes) -> dict[str, object] | None:
    """Headers, by lower-case name, and block of a whole record; None if it isn't one."""
    head, end, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not end or not first.startswith(b"WARC/1."):
        return None
    got: dict[str, object] = {}
    for line in lines:
        name, _, value = line.partition(b":")
        got[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not str(got.get("content-length", "")).isdigit():
        return None
    got["block"] = rest[: int(str(got["content-length"]))]
    return got


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record of each row of pages to files in path.

    Of rows with equal payloads of LEAST bytes or more, one of the smallest id is the response and the others revisit it.
    A null html is an empty payload; a null id is greatest; a null url leaves its header away. An empty table writes no record.
    """
    bounded_batches(pages.sparkSession)
    plain = pages.select(column(pages, id_col).alias("page_id"), column(pages, url_col).alias("url"), F.coalesce(column(pages, html_col), F.lit("")).alias("html"))
    plain = plain.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    long_ = F.octet_length("html") >= LEAST
    alike = plain.filter(long_).groupBy(F.unhex("digest").alias("same")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("many")).filter("many > 1 and first is not null")
    alike = cut(alike.select("same", "first"), "alike")
    # Short payloads are alike without it: a key of their own, by the page's id, spreads them should the join shuffle.
    key = F.when(long_, F.unhex("digest")).otherwise(F.concat(F.lit("short ").cast("binary"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")))
    few = alike.count() <= MOST_BROADCAST
    roles = plain.withColumn("same", key).join(F.broadcast(alike) if few else alike, "same", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))

    def rows(x):
        return {"data": [record(i, u, utf8(h), d, f, r) for i, u, h, d, f, r in zip(x["page_id"], x["url"], x["html"], x["digest"], x["first"], x["revisit"], strict=True)]}

    made = map_batches(roles.select("page_id", "url", "html", "digest", "first", "revisit"), rows, "data binary")
    made.select(F.col("data").cast("string").alias("value")).write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


_RECORD = pa.schema([("kind", pa.string()), ("path", pa.string()), ("at", pa.int64()), ("nth", pa.int64()), ("data", pa.binary())])


class _Joiner:
    """Turns the candidates of a byte range, in order, into members; what it can't finish is left over."""

    def __init__(self) -> None:
        self.open: list[bytes] = []  # candidates of a member that hasn't ended
        self.got: list[bytes] = []  # what they hold; each is decompressed once
        self.stream = None  # the member's, None once it has failed

    def add(self, piece: bytes) -> Iterator[tuple[str, bytes]]:
        """Yields ('record', data) of members that are complete, ('loose', bytes) of what belongs to an earlier range."""
        candidate = MAGIC + piece
        starts = member(candidate)
        # A member's first bytes decide: flags that gzip defines, then a WARC version or, if empty, nothing.
        real = starts is not None and not piece[:1] > b"\x1f" and (starts[0][:5] == b"WARC/"[: len(starts[0])] and (len(starts[0]) >= 5 or starts[1]))
        if real:
            yield from self.close()
            if starts[1]:
                if starts[0]:
                    yield "record", starts[0]
            else:
                self.stream = zlib.decompressobj(31)
                self.open, self.got = [candidate], [self.stream.decompress(candidate)]
        elif self.open:
            self.open.append(candidate)
            try:
                if self.stream is not None:
                    self.got.append(self.stream.decompress(candidate))
            except zlib.error:
                self.stream = None
            if self.stream is not None and self.stream.eof:
                self.open = []
                yield "record", b"".join(self.got)
        else:
            yield "loose", candidate

    def close(self) -> Iterator[tuple[str, bytes]]:
        if self.open:
            yield "loose", b"".join(self.open)
            self.open = []


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """Column data: the decompressed records of all archive files in path, whatever their names."""
    bounded_batches(spark)
    # A codec for an ending that no file has, but that sorts behind .gz in Hadoop's table, hides the one that would read
    # files of that ending in one piece.
    codec = spark._jvm.org.apache.hadoop.io.compress.PassthroughCodec
    raw = {"io.compression.codecs": codec.CLASSNAME, codec.OPT_EXTENSION: ".!.gz"}
    lines = spark.read.options(**raw).option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, joiner, nth = None, _Joiner(), 0

        def out(found, key):
            nonlocal nth
            made = []
            for kind, data in found:
                made.append((kind, *key, nth, data))
                nth += 1
            return made

        for batch in batches:
            made = []
            paths, ats, pieces = (batch.column(i).to_pylist() for i in range(3))
            for key, piece in zip(zip(paths, ats, strict=True), pieces, strict=True):
                if key != now:
                    if now:
                        made += out(joiner.close(), now)
                    now, nth = key, 0
                    if key[1] == 0 and not piece:  # before a file's first magic
                        continue
                made += out(joiner.add(piece), key)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _RECORD, strict=True)] if made else [pa.array([], f.type) for f in _RECORD], schema=_RECORD)
        if now and (rest := out(joiner.close(), now)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rest, strict=True), _RECORD, strict=True)], schema=_RECORD)

    found = cut(lines.mapInArrow(run, "kind string, path string, at long, nth long, data binary"), "members")

    def together(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["at"], r["nth"]))
        made, open_ = [], b""
        for r in rows:  # a left-over start and the pieces after it, up to a whole member
            open_ = r["data"] if member(r["data"]) else open_ + r["data"]
            whole = member(open_)
            if whole and whole[1]:
                made.append(whole[0])
                open_ = b""
        return pa.table({"data": pa.array(made, pa.binary())})

    loose = found.filter("kind = 'loose'").groupBy("path").applyInArrow(together, "data binary")
    return found.filter("kind = 'record'").select("data").unionByName(loose.filter("octet_length(data) > 0"))


def read_archive(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """page_id, url, payload (binary; null for a revisit), payload_bytes, payload_digest, record_type, refers_to, record_id.

    Length and digest are those of the full payload; a response's are taken from its block, and a record whose header
    says otherwise fails the read. Records of other writers have the digest and length of their block, without an HTTP
    header it may begin with; where a revisit's header doesn't name a SHA-256 or a length they are null, as is page_id.
    """

    def id_of(text) -> int | None:
        body = str(text or "").strip("<>").rpartition(":")[2]
        return int(body) if body.lstrip("-").isdigit() else None

    def rows(x):
        out = {k: [] for k in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")}
        for data in x["data"]:
            r = parse(data)
            if r is None:
                raise ValueError(f"not a WARC record: {data[:60]!r}")
            revisit, block = r.get("warc-type") == "revisit", r["block"]
            if str(r.get("content-type", "")).startswith("application/http"):
                block = block.partition(b"\r\n\r\n")[2]
            named, told = str(r.get("warc-payload-digest", "")), str(r.get("x-payload-length", ""))
            digest = named.removeprefix("sha256:") if named.startswith("sha256:") else None if revisit else hashlib.sha256(block).hexdigest()
            size = int(told) if told.isdigit() else None if revisit else len(block)
            if not revisit and (hashlib.sha256(block).hexdigest() != digest or len(block) != size):
                raise ValueError(f"a payload differs from its header: {r.get('warc-record-id')}")
            values = (id_of(r.get("warc-record-id")), r.get("warc-target-uri"), None if revisit else block, size, digest, r.get("warc-type"), id_of(r.get("warc-refers-to")) if revisit else None, r.get("warc-record-id"))
            for k, v in zip(out, values, strict=True):
                out[k].append(v)
        return out

    return map_batches(read_members(spark, path), rows, f"page_id {id_type}, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}, record_id string")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes pages to an archive in the shared folder and reads it back: read_archive's rows, one for each row of pages.

    A null html is an empty payload; a null id is greatest; a null url is null again. Repeated rows give repeated records,
    of which one is the response; an empty table gives an empty one; other columns are ignored.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path, id_col, url_col, html_col)
    return read_archive(spark, path, dict(pages.dtypes)[id_col])
