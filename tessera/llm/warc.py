"""WARC records in Zstandard archives.

An archive is a skippable frame with the dictionary, then one Zstandard frame for
each record, as in the public ``.warc.zst`` convention. Archives are read as rows
``(path, content)`` of Spark's ``binaryFile`` source, so from any store that Spark
reads. The writer makes such rows, and :func:`save_archives` one object of each.

The reader takes the dictionary from the leading skippable frame (trained, raw
content, or itself compressed), finds each frame's end from its blocks' headers,
decodes one frame for each record, and checks the version line, the required headers,
Content-Length, the block's and the payload's digest. A record, frame, dictionary or
archive that fails a check becomes a row with ``error`` set; nothing is dropped and
nothing crashes. What can't be told apart any more (after a frame that is cut short, or
all of an archive whose dictionary is broken) is one such row. An archive without
records, or without a dictionary, is valid; skippable frames between records are passed over.

Edge cases: a null payload counts as empty; equal payloads shorter than
``min_payload`` all stay responses; the smallest id of equal payloads is the
response, and rows that repeat that id are responses too; an empty table gives no
archive. Extra columns of the input are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, cut, work_path

#: Fixed values of the formats: magic numbers of skippable frames with dictionaries and data frames.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: A skippable frame of no bytes, which stands between records or at an object's end without a meaning.
EMPTY_FRAME = "P*M\x18\0\0\0\0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-record-id", "warc-date", "warc-type", "content-length")

ARCHIVE_SCHEMA = "path string, content binary, n_records long"
RECORD_SCHEMA = "path string, position long, record_id string, record_type string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, error string"


def record_urn(page_id: int | None) -> str:
    """A record's id: a version-8 UUID that holds the page's 64 bits; a null id has one of its own."""
    v = (page_id or 0) & 0xFFFFFFFFFFFFFFFF
    head = 0xA0000000 | (page_id is None) << 24
    return f"<urn:uuid:{head:08x}-{v >> 48:04x}-8000-8000-{v & 0xFFFFFFFFFFFF:012x}>"


def page_of(urn: Column) -> Column:
    """The page id in a record's id."""
    v = F.regexp_replace(F.regexp_extract(urn, r"^<urn:uuid:a0000000-([0-9a-f]{4})-8000-8000-[0-9a-f]{12}>$", 1), "^$", "x")
    low = F.regexp_extract(urn, r"-8000-8000-([0-9a-f]{12})>$", 1)
    return F.when(v != "x", F.conv(F.concat(v, low), 16, -10).cast("long"))


def build_record(kind: str, record_id: str, uri: str | None, payload: bytes, digest: str, date: str, refers_to: str | None = None) -> bytes:
    """One response or revisit. A revisit has the HTTP headers of its response only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if uri:
        head.append(f"WARC-Target-URI: {' '.join(uri.split())}")
    if refers_to:
        head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or where there is too little to train on the samples themselves as raw content."""
    try:
        return zstd.train_dictionary(size, samples, level=3).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def parse_record(raw: bytes) -> dict:
    """Fields of a record; raises ValueError on what breaks the format."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/1."):
        raise ValueError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        fields.setdefault(name.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip())
    if missing := [x for x in REQUIRED if not fields.get(x)]:
        raise ValueError(f"missing header {missing[0]}")
    if not fields["content-length"].isdigit():
        raise ValueError("Content-Length isn't a number")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {n}, the block has {len(rest) - 4} bytes")
    block = rest[:n]
    if (d := fields.get("warc-block-digest")) and not digest_matches(d, block):
        raise ValueError("block digest differs")
    out = {"record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to")}
    if fields["warc-type"] not in ("response", "revisit"):
        return out | {"payload": block, "payload_bytes": len(block), "payload_digest": hashlib.sha256(block).hexdigest()}
    http, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP header block")
    length = next((v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length"), None)
    if length is not None and not length.isdigit():
        raise ValueError("the HTTP Content-Length isn't a number")
    stated = fields.get("warc-payload-digest")
    if fields["warc-type"] == "response":
        if length is not None and int(length) != len(payload):
            raise ValueError("the HTTP Content-Length differs from the payload")
        if stated and not digest_matches(stated, payload):
            raise ValueError("payload digest differs")
        return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
    if not stated or not out["refers_to"] or length is None:
        raise ValueError("a revisit without digest, length or reference")
    return out | {"payload": None, "payload_bytes": int(length), "payload_digest": stated.partition(":")[2]}


def digest_matches(stated: str, data: bytes) -> bool:
    """Whether a ``name:value`` digest (hex or base32) fits; one by an unknown algorithm passes."""
    name, _, value = stated.partition(":")
    if name.lower() not in ("sha1", "sha256", "md5"):
        return True
    h = hashlib.new(name.lower(), data)
    return value.lower() == h.hexdigest() or value.upper() == base64.b32encode(h.digest()).decode().rstrip("=")


def frame_end(content: bytes, at: int) -> int:
    """Where the frame at ``at`` ends, by its blocks' headers; ValueError or ZstdError for what isn't whole."""
    head = memoryview(content)[at : at + 18]
    end, last = at + zstd.frame_header_size(head), 0
    while not last:
        if end + 3 > len(content):
            raise ValueError("cut short")
        block = int.from_bytes(content[end : end + 3], "little")
        last, kind, n = block & 1, block >> 1 & 3, block >> 3
        end += 3 + (1 if kind == 1 else n)
    end += 4 * zstd.get_frame_parameters(head).has_checksum
    if end > len(content):
        raise ValueError("cut short")
    return end


def dictionary_of(body: bytes) -> zstd.ZstdCompressionDict:
    """The dictionary in a leading skippable frame; ZstdError for a broken one."""
    if struct.unpack_from("<I", body.ljust(4, b"\0"))[0] == FRAME_MAGIC:
        tool = zstd.ZstdDecompressor().decompressobj()
        body = tool.decompress(body)
        if not tool.eof:
            raise zstd.ZstdError("cut short")
    dictionary = zstd.ZstdCompressionDict(body)
    zstd.ZstdDecompressor(dict_data=dictionary).decompressobj()
    return dictionary


def read_archive(content: bytes) -> Iterator[bytes | str]:
    """The decoded records of one archive, in order; a str tells what is wrong with the frame there.

    Every byte is looked at once, so the time is linear in the archive's size."""
    at, size, reader, view = 0, len(content), zstd.ZstdDecompressor(), memoryview(content)
    while at < size:
        magic, n = struct.unpack_from("<II", content, at) if size - at >= 8 else (0, 0)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if at + 8 + n > size:
                yield "skippable frame is cut short"
                return
            if magic == SKIPPABLE_MAGIC and at == 0 and n:
                try:
                    reader = zstd.ZstdDecompressor(dict_data=dictionary_of(content[8 : 8 + n]))
                except (zstd.ZstdError, MemoryError) as e:
                    yield f"dictionary: {e}"
                    return
            at += 8 + n
            continue
        try:
            end = frame_end(content, at)
        except (zstd.ZstdError, ValueError) as e:
            yield f"frame at byte {at}: {e}"
            return
        try:
            yield reader.decompressobj().decompress(view[at:end])
        except (zstd.ZstdError, MemoryError) as e:
            yield f"frame at byte {at}: {e}"
        at = end


class ArchiveWriter:
    """Collects records into archives of about ``archive_bytes`` each."""

    def __init__(self, name: str, archive_bytes: int, dict_bytes: int, sample_bytes: int, level: int):
        self.name, self.archive_bytes, self.dict_bytes, self.sample_bytes, self.level = name, archive_bytes, dict_bytes, sample_bytes, level
        self.made = 0
        self.reset()

    def reset(self) -> None:
        self.waiting, self.waiting_bytes, self.frames, self.bytes, self.n, self.packer = [], 0, [], 0, 0, None

    def start(self) -> None:
        """The dictionary is trained on the archive's first ``sample_bytes`` of records."""
        dictionary = train_dictionary(self.waiting, self.dict_bytes)
        self.frames.append(struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary)
        shared = zstd.ZstdCompressionDict(dictionary)
        shared.precompute_compress(level=self.level)
        self.packer = zstd.ZstdCompressor(level=self.level, dict_data=shared, write_checksum=True)
        for x in self.waiting:
            self.put(x)
        self.waiting, self.waiting_bytes = [], 0

    def put(self, record: bytes) -> None:
        frame = self.packer.compress(record)
        self.frames.append(frame)
        self.bytes += len(frame)

    def add(self, record: bytes) -> tuple[str, bytes, int] | None:
        self.n += 1
        if self.packer is None:
            self.waiting.append(record)
            self.waiting_bytes += len(record)
            if self.waiting_bytes >= self.sample_bytes:
                self.start()
        else:
            self.put(record)
        return self.close() if self.bytes >= self.archive_bytes else None

    def close(self) -> tuple[str, bytes, int] | None:
        if not self.n:
            return None
        if self.packer is None:
            self.start()
        out = (f"{self.name}-{self.made:05d}.warc.zst", b"".join(self.frames), self.n)
        self.made += 1
        self.reset()
        return out


def mark_revisits(pages: DataFrame, id_column: str = "page_id", payload: str = "html", min_payload: int = 100) -> DataFrame:
    """Adds ``payload`` (binary), ``payload_digest`` and ``refers_to`` (null for responses).

    Only digests are grouped, with a partial minimum before the exchange, and only those
    of several pages are looked up: broadcast if counted few, else joined by exchange,
    where the engine splits the partition of a hot digest.
    """
    body = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_column).alias("page_id"), F.col("url"), body.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    known = rows.where(F.length("payload") >= min_payload).groupBy(F.unhex("payload_digest").alias("d"))
    first = cut(known.agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    rows = rows.join(broadcast_if_small(first), F.unhex("payload_digest") == F.col("d"), "left")
    return rows.withColumn("refers_to", F.when(F.col("page_id") > F.col("first_id"), F.col("first_id"))).drop("d", "first_id")


def write_archives(records: DataFrame, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 16 << 20, dict_bytes: int = 32 << 10, sample_bytes: int = 2 << 20, level: int = 3) -> DataFrame:
    """Archives ``(path, content, n_records)`` of the rows of :func:`mark_revisits`; each task writes its own."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(f"part-{uuid.uuid4().hex}", archive_bytes, dict_bytes, sample_bytes, level)
        row = lambda x: pa.RecordBatch.from_pydict({"path": [x[0]], "content": [x[1]], "n_records": [x[2]]})
        for batch in batches:
            for r in batch.to_pylist():
                payload = r["payload"] or b""
                kind = "response" if r["refers_to"] is None else "revisit"
                other = None if r["refers_to"] is None else record_urn(r["refers_to"])
                if done := writer.add(build_record(kind, record_urn(r["page_id"]), r["url"], payload, r["payload_digest"], date, other)):
                    yield row(done)
        if done := writer.close():
            yield row(done)

    return records.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(kernel, ARCHIVE_SCHEMA)


def save_archives(archives: DataFrame, where: str) -> None:
    """One object of each row of :func:`write_archives` below ``where``, on any store that Spark writes.

    Spark's text writer puts out the bytes as they are and a separator, which here is an empty skippable frame."""
    archives.select(F.col("content").cast("string")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(where)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the archives ``(path, content)``; ``error`` is null for a valid one."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("path", "position", "record_id", "record_type", "target_uri", "refers_to", "payload", "payload_bytes", "payload_digest", "error")
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string())
        schema = pa.schema(list(zip(names, types, strict=True)))
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows, held = [], 0
                for position, raw in enumerate(read_archive(content or b"")):
                    row = dict.fromkeys(names) | {"path": path, "position": position}
                    if isinstance(raw, str):
                        row["error"] = raw
                    else:
                        try:
                            row |= parse_record(raw)
                        except ValueError as e:
                            row["error"] = str(e)
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    held += len(row["payload"] or b"") + 300
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("path", "content").mapInArrow(kernel, RECORD_SCHEMA)


def round_trip(pages: DataFrame, id_column: str = "page_id", payload: str = "html", min_payload: int = 100) -> DataFrame:
    """Writes a record for each page into archive objects in the shared folder and reads those back."""
    spark = pages.sparkSession
    where = work_path(spark, "warc")
    save_archives(write_archives(mark_revisits(pages, id_column, payload, min_payload)), where)
    return read_archives(spark.read.format("binaryFile").load(where), with_payload=False)
