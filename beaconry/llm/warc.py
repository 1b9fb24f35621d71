"""WARC archives as Zstandard files: written by Spark's text sink, read by Spark's binary file source.

An archive begins with a skippable frame that holds a dictionary.  Each record is one frame compressed with it, with its
content size and checksum.  The text sink puts an empty skippable frame between records, where it would put line ends;
readers skip such frames.  So archives can be written to any store Spark reaches, and no executor writes files itself.

The dictionary is trained on a bounded sample of payloads (``dictionary_samples`` of the smallest ids' hashes, of at
most 64 KB each).  Pages are dealt to archives by a hash of their id, about ``archive_bytes`` of payload each.

Records: of equal payloads (by SHA-1) of at least ``min_revisit_bytes`` the one with the smallest page id is a response,
the others are revisits that refer to it and carry HTTP headers only.  Reading validates the version line, the required
headers, block and payload lengths and digests, and raises ValueError on any damage.

Edge cases: a null html is an empty payload, a null url becomes ``about:blank``; line ends in urls are percent-encoded.
A row without a page id has no record id and gets no record.  Repeated page ids keep a record per row.  An empty table writes
no archive, and reading it gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.llm.common import shared_folder

DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: An empty skippable frame; it is plain ASCII, so the text sink takes it as a line end.
BETWEEN = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
ARCHIVE_BYTES, DICTIONARY_BYTES, DICTIONARY_SAMPLES, LEVEL = 48 << 20, 64 << 10, 1000, 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE),
               ("WARC-Target-URI", target), ("X-Page-Id", str(page_id)), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
               ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        headers += [("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to)), ("WARC-Profile", PROFILE)]
    headers.append(("Content-Length", str(len(block))))
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in headers), "\r\n"]).encode() + block + b"\r\n\r\n"


def _headers(raw: bytes, what: str) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode("utf-8").split("\r\n")
    out = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"{what}: a header without a colon")
        out[name.strip().lower()] = value.strip()
    return first, out


def parse_record(raw: bytes) -> dict:
    """A record's fields, after all its lengths and digests have been checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, headers = _headers(head, "record")
    if not gap or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"record without {name}")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record block has {len(rest) - 4} bytes, its header says {size}")
    block = rest[:size]
    if headers.get("warc-block-digest", f"sha1:{payload_digest(block)}") != f"sha1:{payload_digest(block)}":
        raise ValueError("block digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    status, inner = _headers(http, "block")
    if not gap or not status.startswith("HTTP/"):
        raise ValueError("block without HTTP headers")
    length, digest = int(inner["content-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
    kind = headers["warc-type"]
    if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError("payload length or digest differs")
    if kind == "revisit" and (payload or "warc-refers-to" not in headers):
        raise ValueError("revisit with a payload or without the record it refers to")
    refers = headers.get("x-refers-to-page")
    if refers is not None and record_id(int(refers)) != headers["warc-refers-to"]:
        raise ValueError("revisit refers to another record than it names")
    return {"page_id": int(headers["x-page-id"]), "url": headers.get("warc-target-uri"), "record_type": kind, "payload": payload if kind == "response" else None,
            "payload_bytes": length, "payload_digest": digest, "refers_to": None if refers is None else int(refers)}


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends, found from its block headers without decoding it."""
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    content = (1 if single else 0, 2, 4, 8)[flags >> 6]
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + content
    while True:
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        header = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if header >> 1 & 3 == 1 else header >> 3)
        if header & 1:
            break
    at += 4 * checksum
    if at > len(data):
        raise ValueError("a frame is cut off")
    return at


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame decoded at a time."""
    data, at, decoder = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("bytes after the last frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(data):
                raise ValueError("a skippable frame is cut off")
            if magic == DICTIONARY_MAGIC and at == 0 and size:
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[8 : 8 + size])))
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = frame_end(data, at)
            try:
                yield decoder.decompress(bytes(data[at:end]))
            except zstandard.ZstdError as error:
                raise ValueError(f"a frame does not decode: {error}") from error
            at = end
        else:
            raise ValueError(f"no Zstandard frame at byte {at}")


def prepare(pages: DataFrame, min_revisit_bytes: int = 0, parts: int | None = None) -> DataFrame:
    """``page_id, url, payload, refers_to``; only ids and digests move to find equal payloads, not the payloads.

    With ``parts``, payloads are dealt by ``page_id`` into that many parts, once: the marks of a page come to its part, so
    the join needs no further exchange of payloads.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = (pages.filter("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
            .withColumn("sha", F.sha1("payload")))
    marks = rows.select("page_id", "sha", F.length("payload").alias("size")).filter(F.col("size") >= min_revisit_bytes)
    firsts = marks.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").select("sha", "refers_to")
    later = marks.join(firsts, "sha").filter("page_id <> refers_to").select("page_id", "sha", "refers_to").distinct()
    of_page = later.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("sha", "refers_to"))).alias("first_of"))
    dealt = rows if parts is None else rows.repartition(parts, "page_id")
    return (dealt.join(of_page, "page_id", "left").withColumn("refers_to", F.try_element_at("first_of", F.col("sha")))
            .drop("sha", "first_of"))


def train_dictionary(pages: DataFrame, samples: int = DICTIONARY_SAMPLES, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from a bounded sample of payloads; empty if there are too few to train on."""
    rows = (pages.select("page_id", "html").filter("page_id is not null and length(html) between 1 and 65536")
            .orderBy(F.xxhash64("page_id"), "page_id").limit(samples).collect())
    try:
        return zstandard.train_dictionary(size, [record(r.page_id, None, r.html.encode(), None) for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write ``pages(page_id, url, html)`` as archives below ``folder``, and return it."""
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    archives = max(1, -(-total // archive_bytes))
    dictionary = train_dictionary(pages)

    def run(batches):
        settings = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        coder = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True, **settings)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        for batch in batches:
            out = [lead] if lead else []
            lead = b""
            for page_id, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                out.append(coder.compress(record(page_id, url, payload, refers_to)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    # A join may deal more parts than asked for; they are merged in place.
    (prepare(pages, min_revisit_bytes, archives).coalesce(archives).mapInArrow(run, "frame binary")
     .select(F.col("frame").cast("string").alias("frame"))
     .write.option("lineSep", BETWEEN).option("maxRecordsPerFile", 0).option("compression", "none").text(folder))
    return folder


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Validated records: ``page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to``."""
    fields = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64()}

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for raw in read_archive(content.as_buffer().to_pybytes()):
                    held.append(parse_record(raw))
                    size += len(raw)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, pa.schema(list(fields.items())))
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, pa.schema(list(fields.items())))

    return (spark.read.format("binaryFile").load(folder).select("content")
            .mapInArrow(run, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"))


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    folder = write_archives(pages, shared_folder(pages.sparkSession, "warc"), min_revisit_bytes)
    return read_archives(pages.sparkSession, folder)
