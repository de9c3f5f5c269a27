"""WARC archives: writing with deduplication and segments, reading with reassembly.

Each record is a gzip member of its own. Members go through Spark's text writer,
whose line separator is the zero byte that ends every one of them, so the archives
can lie in any store that Spark writes; they come back as binary files.
A block longer than `segment` bytes is continued in further records that name
its first record as their origin. The reader groups continuations by that
identifier, orders them by segment number, holds them against the total length
and decodes the chunked transfer framing of the HTTP message inside.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import checkpoint, map_arrow

SEGMENT = 32 << 10
CHUNK = 8 << 10
#: Records of one archive file, at most; with the segment size this bounds a file to 64 MB.
FILE_RECORDS = 2_000
#: Bytes of an archive that are decompressed at a time.
PIECE = 16 << 10
#: Digests of repeated payloads, or responses revisited, that are broadcast, at most; more are joined by a shuffle.
BROADCAST_DIGESTS = 100_000
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The chunked transfer coding of a payload."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if at + size + 2 > len(body) or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        parts.append(body[at : at + size])
        at += size + 2


def member(data: bytes) -> bytes:
    """A gzip member that ends in a zero byte, the highest of the length of what it
    holds; from 16 MiB on, where that need not be zero, an empty member follows."""
    z = zlib.compressobj(wbits=31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + member(b"")


def _plain(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record without the separator that follows it."""
    head = "".join(f"{k}: {_plain(v)}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"Content-Length: %d\r\n\r\n" % len(block) + block


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{row}')}>"


def records_of(page_id: int | None, row: int, url: str | None, payload: bytes, refers_to: tuple[int, int, str | None] | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page: a response, with continuations if it is long, or a
    revisit of the response with that page id, row and URL."""
    name = record_id(page_id, row)
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}")]
    head += [("WARC-Target-URI", url)] * (url is not None) + [("X-Page-Id", str(page_id))] * (page_id is not None)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(*refers_to[:2])), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-Id", str(refers_to[0]))]
        head += [("WARC-Refers-To-Target-URI", refers_to[2])] * (refers_to[2] is not None)
        yield record(head, http + b"\r\n")
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield record(head, block)
        return
    yield record([*head, ("WARC-Segment-Number", "1")], block[:segment])
    for k, at in enumerate(range(segment, len(block), segment), 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{row}/{k}')}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k))]
        if at + segment >= len(block):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record(more, block[at : at + segment])


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, segment: int = SEGMENT, compressed: bool = True) -> None:
    """Write a record per row, in gzip members or plain. Of rows with equal payloads of at least min_bytes
    bytes, those with the largest id are responses and the others revisit it.

    Null html is an empty payload. A row with a null id revisits an equal payload
    that has an id; where none has, it is a response. Repeated rows are each
    written. Only digests that occur twice come back to the rows, one row each: up to
    BROADCAST_DIGESTS of them by broadcast, more by a shuffle in which a payload
    that fills a third of the table may be split.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.monotonically_increasing_id().alias("row"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    twice = src.groupBy("digest").agg(F.max(F.struct("page_id", "row", "url")).alias("keep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    largest = checkpoint(twice)  # an exchange of its own then
    if largest.count() <= BROADCAST_DIGESTS:
        largest = F.broadcast(largest)  # the payloads stay where they are
    again = F.when((F.octet_length("payload") >= min_bytes) & ~F.col("keep.page_id").eqNullSafe(F.col("page_id")) & F.col("keep.page_id").isNotNull(), F.col("keep"))
    marked = src.join(largest, "digest", "left").withColumn("to", again).select("page_id", "row", "url", "payload", "to.page_id", "to.row", "to.url").toDF("page_id", "row", "url", "payload", "to_page", "to_row", "to_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            for page_id, row, url, payload, *to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out += records_of(page_id, row, url, payload, tuple(to) if to[0] is not None else None, segment)
            if compressed:
                out = [member(r + END)[:-1] for r in out]  # the separator is the last byte
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    made = map_arrow(marked, run, "value binary")
    separator = "\0" if compressed else END.decode()
    made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", separator).option("compression", "none").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record; gzip members are
    undone on the way, so that only one record is held besides the file itself.
    ValueError where a file ends inside a record."""
    held = bytearray()

    def feed() -> Iterator[bytes]:
        if content[:2] != b"\x1f\x8b":
            yield content
            return
        view, at = memoryview(content), 0
        while at < len(view):
            z, rest = zlib.decompressobj(31), b""
            while not z.eof:
                if not rest:
                    rest = view[at : at + PIECE]
                    at += len(rest)
                got = z.decompress(rest, 1 << 20)
                rest = z.unconsumed_tail
                if got:
                    yield got
                elif not rest and at >= len(view) and not z.eof:
                    raise ValueError("archive is cut short")
            at -= len(z.unused_data)

    def ready() -> Iterator[tuple[dict[str, str], bytes]]:
        at = 0
        while True:
            end = held.find(END, at)
            if end < 0:
                break
            lines = bytes(held[at:end]).decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no record begins here: {lines[0][:40]!r}")
            heads = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            start = end + len(END)
            stop = start + int(heads["content-length"])
            if stop + len(END) > len(held):
                break
            yield heads, bytes(held[start:stop])
            at = stop + len(END)
        del held[:at]

    for part in feed():
        held += part
        yield from ready()
    if held:
        raise ValueError("archive is cut short")


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(END)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_OUT = "record_id string, record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, problem string, target string"


def _finish(heads: dict[str, str], block: bytes, problem: str | None, with_payload: bool) -> list:
    digest = heads.get("warc-payload-digest", "").removeprefix("sha1:") or None
    page, refers = heads.get("x-page-id"), heads.get("x-refers-to-page-id")
    payload, n = None, None
    target = heads.get("warc-refers-to") if heads.get("warc-type") == "revisit" else None
    if heads.get("warc-type") != "revisit":
        try:
            payload = http_payload(block)
        except ValueError as e:
            problem = problem or str(e)
        if payload is not None:
            n, found = len(payload), payload_digest(payload)
            if digest not in (None, found):
                problem = problem or "payload digest differs"
            digest = found
    row = [heads.get("warc-record-id"), heads.get("warc-type"), int(page) if page else None, heads.get("warc-target-uri"), int(refers) if refers else None, n, digest, problem, target]
    return [*row, payload] if with_payload else row


def _batch(rows: list[list], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])


_KINDS = [("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("problem", pa.string()), ("target", pa.string())]


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per response and revisit of the archives below path.

    problem is null, or says what is wrong with the record: a segment missing,
    a total length or digest that differs, broken framing, a response that is not
    there. A revisit has no payload of its own: the response it names must be in
    the archives with the digest that it states, and gives its length. Whole
    records are decoded where they are parsed; only segments are shuffled, and
    the names of responses that are revisited. Repeated rows were written as
    records of their own; an archive of an empty table gives no rows.
    """
    kinds = [*_KINDS, *([("payload", pa.binary())] if with_payload else [])]
    more = [("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("heads", pa.map_(pa.string(), pa.string())), ("block", pa.binary())]
    fields = _OUT + (", payload binary" if with_payload else "")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [None] * len(kinds)
        for b in batches:
            for content in b.column(0):
                rows: list[list] = []
                size = 0
                for heads, block in parse(content.as_py()):
                    number = heads.get("warc-segment-number")
                    if number:
                        origin = heads.get("warc-segment-origin-id") or heads.get("warc-record-id")
                        total = heads.get("warc-segment-total-length")
                        rows.append([*none, origin, int(number), int(total) if total else None, list(heads.items()), block])
                    else:
                        rows.append([*_finish(heads, block, None, with_payload), None, None, None, None, None])
                    size += len(block)
                    if size > 8 << 20 or len(rows) >= 5000:
                        yield _batch(rows, kinds + more)
                        rows, size = [], 0
                yield _batch(rows, kinds + more)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    found = checkpoint(map_arrow(files, scan, f"{fields}, origin string, segment int, total long, heads map<string,string>, block binary"))
    names = [n for n, _ in kinds]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin, held = None, []

        def whole() -> list:
            heads = dict(held[0][3])
            problem = None
            if [h[1] for h in held] != list(range(1, len(held) + 1)):
                problem = "segment missing or repeated"
            block = b"".join(h[4] for h in held)
            if held[-1][2] != len(block):
                problem = problem or "total length differs"
            return _finish(heads, block, problem, with_payload)

        for b in batches:
            rows = []
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and x[0] != origin:
                    rows.append(whole())
                    held.clear()
                origin = x[0]
                held.append(x)
            yield _batch(rows, kinds)
        if held:
            yield _batch([whole()], kinds)

    parts = found.filter("segment is not null").select("origin", "segment", "total", "heads", "block").repartition("origin").sortWithinPartitions("origin", "segment")
    joined = checkpoint(map_arrow(parts, join, fields))  # three parts of the plan take them
    every = found.filter("segment is null").select(*names).unionByName(joined)
    own = every.filter("target is null").drop("target")
    revisits = every.filter("target is not null").drop("payload_bytes")
    sure = every.filter("target is null and problem is null").select(F.col("record_id").alias("target"), F.col("payload_bytes"), F.col("payload_digest").alias("there"))
    known = checkpoint(sure.join(revisits.select("target").distinct(), "target"))
    if known.count() <= BROADCAST_DIGESTS:
        known = F.broadcast(known)
    wrong = F.when(F.col("there").isNull(), "response missing").when(F.col("there") != F.col("payload_digest"), "payload digest differs")
    resolved = revisits.join(known, "target", "left").withColumn("problem", F.coalesce("problem", wrong)).drop("target", "there")
    return own.unionByName(resolved)
