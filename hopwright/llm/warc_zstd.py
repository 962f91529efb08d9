"""WARC archives under Zstandard with a shared dictionary: writer and reader.

An archive is a leading skippable frame (magic 0x184D2A5D) that holds the dictionary, then one Zstandard frame per
record. The reader takes the dictionary from the skippable frame, decodes the frames one by one, and checks each record:
version line, required headers, block length against Content-Length, payload digest of responses, the blank lines that
end it. A file that ends inside a frame or a record that fails a check raises an error.

Records with equal payloads: the row with the smallest key is a response, the others are revisits that name it. A null
payload is empty; a null key comes after all others and has no key header; keys are escaped in headers; among rows with the same key and payload one is the response (they
are alike). URLs may be null. A payload of any length is one record. Other columns may have any names. An empty table writes no archive and reads back as no rows. Archives go to the shared folder
through the file system its URI names; a task writes to names of its own and moves each file into place when it is whole, so
a repeated task leaves no half file: the list of whole files comes from the tasks that were counted.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopwright.llm.common import SHARE_ROWS, fresh_path, shared_join, split_keys, table, written

SKIPPABLE_DICTIONARY = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
ARCHIVE_BYTES = 32 << 20
#: The dictionary is trained on the first payloads of an archive, up to this many bytes.
DICTIONARY_SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10


class WarcError(ValueError):
    """An archive that breaks the format."""


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _names(header: str, key: str | None) -> list[str]:
    """A header line for a key, escaped so that no blank or line break is lost; none for a null key."""
    return [] if key is None else [f"{header}: {quote(key, safe='')}"]


def _key(headers: dict[str, str], header: str) -> str | None:
    return unquote(headers[header]) if header in headers else None


def make_record(key: str | None, url: str | None, payload: bytes, kind: str, digest: str, refers_to: str | None, date: str = "2020-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; the block of a revisit ends with the HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    target = "".join(c if " " < c else "%20" for c in url or f"urn:hopwright:{key}")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id('' if key is None else f'key {key}')}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}", *_names("X-Page-Key", key), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines[6:6] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(f'key {refers_to}')}", *_names("X-Refers-To-Key", refers_to)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(out: io.IOBase, records: list[bytes], dictionary: bytes) -> None:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if dictionary:
        out.write(struct.pack("<II", SKIPPABLE_DICTIONARY, len(dictionary)) + dictionary)
    packer = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True, write_checksum=True)
    for record in records:
        out.write(packer.compress(record))


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from the given samples; none where there are too few of them to train on."""
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveReader:
    """Records of one archive, a frame at a time."""

    def __init__(self, stream, chunk: int = 1 << 20):
        self.stream, self.chunk, self.rest = stream, chunk, b""
        self.dictionary = None
        head = self._take(8)
        if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE_DICTIONARY:
            size = struct.unpack("<I", head[4:])[0]
            raw = self._take(size)
            if len(raw) != size:
                raise WarcError("the dictionary frame is cut short")
            if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary itself may be compressed
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            self.dictionary = zstandard.ZstdCompressionDict(raw)
        else:
            self.rest = head + self.rest

    def _take(self, n: int) -> bytes:
        while len(self.rest) < n and (more := self.stream.read(max(self.chunk, n - len(self.rest)))):
            self.rest += more
        out, self.rest = self.rest[:n], self.rest[n:]
        return out

    def frames(self) -> Iterator[bytes]:
        while True:
            if not self.rest:
                self.rest = self.stream.read(self.chunk)
            if not self.rest:
                return
            if len(self.rest) < 4:
                self.rest += self.stream.read(self.chunk)
            magic = struct.unpack("<I", self.rest[:4].ljust(4, b"\0"))[0]
            if magic & 0xFFFFFFF0 == 0x184D2A50:  # another skippable frame
                size = struct.unpack("<I", self._take(8)[4:])[0]
                if len(self._take(size)) != size:
                    raise WarcError("a skippable frame is cut short")
                continue
            if magic != FRAME_MAGIC:
                raise WarcError("no frame starts here")
            job = zstandard.ZstdDecompressor(dict_data=self.dictionary).decompressobj()
            parts, data = [], self.rest
            while not job.eof:
                if not data and not (data := self.stream.read(self.chunk)):
                    raise WarcError("the archive ends inside a frame")
                try:
                    parts.append(job.decompress(data))
                except zstandard.ZstdError as e:
                    raise WarcError(f"a frame can't be decoded: {e}") from e
                data = b""
            self.rest = job.unused_data
            yield b"".join(parts)

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for frame in self.frames():
            yield parse_record(frame)


def parse_headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"not a header: {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a frame that holds exactly one record."""
    head, gap, body = raw.partition(b"\r\n\r\n")
    version, _, rest = head.partition(b"\r\n")
    if not gap or not version.startswith(b"WARC/1."):
        raise WarcError("not a WARC record")
    headers = parse_headers(rest)
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if needed not in headers:
            raise WarcError(f"{needed} is missing")
    length = headers["content-length"]
    if not length.isdigit() or len(body) != int(length) + 4 or body[-4:] != b"\r\n\r\n":
        raise WarcError("Content-Length doesn't fit the block")
    return headers, body[:-4]


def page_of(headers: dict[str, str], block: bytes) -> tuple[str | None, int, str, str, str | None]:
    """key, payload bytes, digest, type and the key of the response it refers to; checks the payload."""
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/1."):
        raise WarcError("the block has no HTTP headers")
    length = int(parse_headers(http.partition(b"\r\n")[2])["content-length"])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response":
        if len(payload) != length or sha1_base32(payload) != digest:
            raise WarcError("the payload doesn't fit its length or digest")
        return _key(headers, "x-page-key"), length, digest, "response", None
    if headers["warc-type"] != "revisit" or payload:
        raise WarcError("neither response nor revisit")
    return _key(headers, "x-page-key"), length, digest, "revisit", _key(headers, "x-refers-to-key")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path in the shared folder; names that only the JVM's connectors use stand for the same store here."""
    scheme, _, rest = path.partition("://")
    path = {"s3a": f"s3://{rest}", "s3n": f"s3://{rest}"}.get(scheme, path)
    try:
        return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    except pa.ArrowInvalid as e:
        raise WarcError(f"archives can't be kept under {scheme}://: name a folder that Arrow can open in spark.checkpoint.dir") from e


def _archives(folder: str):
    """Task body: rows (key, url, html, digest's first key) to archives; gives back the file names and their record counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            samples, seen = [], 0
            for record in held:
                if seen >= DICTIONARY_SAMPLE_BYTES:
                    break
                samples.append(record[: 64 << 10])
                seen += len(samples[-1])
            with system.open_output_stream(f"{root}/{name}.part", compression=None) as out:
                write_archive(out, held, train_dictionary(samples))
            system.move(f"{root}/{name}.part", f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(held)], pa.int64())], names=["path", "records"])

        for batch in batches:
            for key, url, html, kind, first in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (html or "").encode()
                held.append(make_record(None if key is None else str(key), url, payload, kind, sha1_base32(payload), None if first is None else str(first)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _read_archives(paths: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for batch in paths:
        for path in batch.column(0).to_pylist():
            system, at = _open(path)
            with system.open_input_stream(at, compression=None) as stream:
                rows = [page_of(*record) for record in ArchiveReader(stream).records()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def write_pages(pages: DataFrame, folder: str, key: str = "page_id", min_revisit_bytes: int = 0, share_rows: int = SHARE_ROWS) -> DataFrame:
    """Archives under ``folder``; a table (path, records) of the whole ones."""
    body = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(F.col(key).alias("k"), F.col("url"), F.col("html"), F.sha1(body.cast("binary")).alias("d"), F.octet_length(body).alias("n"))
    # Which rows revisit which is settled on digests alone; pages themselves move once.
    first = base.filter(F.col("n") >= min_revisit_bytes).groupBy(F.col("d").alias("key")).agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = written(first, "first-copies")
    split = split_keys(first, first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], share_rows)
    joined = shared_join(base, F.col("d"), F.col("k"), first.select("key", "first"), split)
    typed = joined.withColumn("__again", F.coalesce(~F.col("k").eqNullSafe(F.col("first")), F.lit(False)) & F.col("first").isNotNull())
    rows = typed.select("k", "url", "html", F.when(F.col("__again"), "revisit").otherwise("response").alias("kind"), F.when(F.col("__again"), F.col("first")).alias("first"))
    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    return written(rows.mapInArrow(_archives(folder), "path string, records bigint"), "warc-index")


def read_pages(index: DataFrame) -> DataFrame:
    """key, payload_bytes, payload_digest, record_type and refers_to (keys as text) of each record of the archives in ``index``."""
    n = max(1, min(4 * index.sparkSession.sparkContext.defaultParallelism, index.count()))
    return index.select("path").repartition(n).mapInArrow(_read_archives, "key string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    back = read_pages(write_pages(pages, fresh_path(spark, "warc")))
    kind = pages.schema["page_id"].dataType
    as_key = lambda c: F.col(c).cast(kind)
    return back.select(as_key("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_key("refers_to").alias("refers_to"))


def op10_sql() -> str:
    """SHA-1 in base32: eight groups of 5 bits for every 5 bytes of the digest."""
    groups = []
    for g in range(4):
        word = f"('0x' || substr(h, {10 * g + 1}, 10))::BIGINT"
        groups += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({word} >> {35 - 5 * i}) & 31)::INTEGER + 1, 1)" for i in range(8)]
    return f"""
    WITH b AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM b)
    SELECT page_id, n::BIGINT AS payload_bytes, {' || '.join(groups)} AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM f
    """
