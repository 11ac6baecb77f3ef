"""Web pages as WARC archives, compressed with a dictionary of their own, and back.

An archive begins with a skippable frame (magic number 0x184D2A5D) that holds a
Zstandard dictionary, built from the first records of that archive; each record
follows as a frame of its own, so that one can be read by its offset.  Of equal
payloads the page with the smallest id is a response; the others are revisit
records, which name it and keep the HTTP header without the payload.

Which digests repeat is an aggregate of digests, never of payloads.  Where few
enough do, the table is broadcast and the texts are not shuffled; beyond that it
is joined by digest, and a digest held by many pages is split by adaptive
execution.  Tasks write archives of bounded size straight into the folder under
names of their own; the index tells which of them are complete.  What lost or
repeated attempts left is in no index and is removed.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, in_slices, whole_text, written

#: Payloads below this size are stored whatever else equals them.
LEAST_BYTES = 100
#: An archive's compressed size; the first records of one, of which the dictionary is built; the dictionary's size.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 64 << 20, 2 << 20, 32 << 10, 3
#: So many repeated digests are broadcast, about 100 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
DATE, RECORD_URN = "1970-01-01T00:00:00Z", "urn:quillmeter:page:"
#: Fixed values of the compressed format: the dictionary's frame, a frame of data, a trained dictionary.
DICTIONARY_FRAME, DATA_FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
INDEX = "archive string, offset long, length long, page_id string"


def record_urn(page_id: str | None) -> str:
    return RECORD_URN.rstrip(":") if page_id is None else RECORD_URN + quote(page_id, safe="")


def page_of(urn: str) -> str | None:
    return unquote(urn.removeprefix(RECORD_URN)) if urn.startswith(RECORD_URN) else None


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response, or a revisit where ``refers_to`` names a page; the HTTP header gives the payload's whole length in both."""
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else record_urn(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_urn(page_id)}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    block = http + payload
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_urn(refers_to)}>"]
        block = http
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """A dictionary of at most ``size`` bytes and an eighth of the samples; of their end as it is, where they are too few to be trained on."""
    size = min(size, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-max(size, 8) :], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """One archive being written: records wait until there are enough for the dictionary, then each becomes a frame."""

    def __init__(self, folder: str, name: str, sample: int = SAMPLE_BYTES):
        self.files, at = fs.FileSystem.from_uri(folder)
        self.path, self.name, self.sample, self.rows = f"{at}/{name}", name, sample, []
        self.waiting, self.held, self.at, self.out = [], 0, 0, None

    def add(self, page_id: str | None, data: bytes) -> None:
        if self.out:
            return self._frame(page_id, data)
        self.waiting.append((page_id, data))
        self.held += len(data)
        if self.held >= self.sample:
            self._begin()

    def _begin(self) -> None:
        built = build_dictionary([d for _, d in self.waiting])
        content = built.as_bytes()
        kept = zstandard.ZstdCompressor(level=19).compress(content)
        built.precompute_compress(level=LEVEL)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=built, write_checksum=True).compress
        self.out = self.files.open_output_stream(self.path, compression=None)  # the frames are made here
        self._write(struct.pack("<II", DICTIONARY_FRAME, len(kept)) + kept)
        for page_id, data in self.waiting:
            self._frame(page_id, data)
        self.waiting = []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _frame(self, page_id: str | None, data: bytes) -> None:
        start = self.at
        self._write(self.compress(data))
        self.rows.append((self.name, start, self.at - start, page_id))

    def close(self) -> list[tuple]:
        if self.waiting:
            self._begin()
        if self.out:
            self.out.close()
        return self.rows


def dictionary_of(archive) -> tuple[zstandard.ZstdCompressionDict, int]:
    """An archive's dictionary and where its first record starts; the frame may hold the dictionary compressed or as it is."""
    magic, size = struct.unpack("<II", archive[:8])
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary")
    content = bytes(archive[8 : 8 + size])
    if content[:4] == DATA_FRAME:
        content = zstandard.ZstdDecompressor().decompress(content)
    return zstandard.ZstdCompressionDict(content), 8 + size


def parse_record(stream: io.BufferedIOBase) -> tuple[dict[str, str], dict[str, str], bytes] | None:
    """(WARC header, HTTP header, payload) of the next record, names in lower case; None at the end."""

    def header(first: bytes) -> dict[str, str]:
        lines = {}
        while line := stream.readline().strip():
            name, _, value = line.decode().partition(":")
            lines[name.strip().lower()] = value.strip()
        if not first:
            raise ValueError("a record ends early")
        return lines

    version = stream.readline()
    if not version:
        return None
    warc = header(version)
    start = stream.tell()
    http = header(stream.readline())
    left = int(warc["content-length"]) - (stream.tell() - start)
    payload = stream.read(left)
    if len(payload) != left or stream.read(4) != b"\r\n\r\n":
        raise ValueError("a record ends early")
    return warc, http, payload


def records_of(archive) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """All records of an archive's bytes, one after the other."""
    archive = memoryview(archive)
    dictionary, start = dictionary_of(archive)
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(archive[start:], read_across_frames=True), 1 << 20)
    while (found := parse_record(stream)) is not None:
        yield found


def read_record(archive, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """One record by its place in the index, without those before it."""
    archive = memoryview(archive)
    frame = zstandard.ZstdDecompressor(dict_data=dictionary_of(archive)[0]).decompress(archive[offset : offset + length])
    return parse_record(io.BufferedReader(io.BytesIO(frame)))


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is the smallest id of an equal payload of 100 bytes or more, where it is not the page's own."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), whole_text(payload_col).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= LEAST_BYTES
    held = rows.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated, _ = written(held.filter("n > 1").select(F.col("digest").alias("of_digest"), "first"))
    repeated = F.broadcast(repeated) if repeated.count() <= broadcast_rows else repeated.hint("shuffle_hash")
    # Small payloads may all be equal: each goes its own way and meets nothing.
    key = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    joined = rows.withColumn("key", key).join(repeated, F.col("key") == F.col("of_digest"), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE, archive_bytes: int = ARCHIVE_BYTES, sample: int = SAMPLE_BYTES
) -> DataFrame:
    """Writes a record a page into archives in ``folder`` (a path or URI of any store that pyarrow.fs opens) and gives their index.

    The index (archive, offset, length, page_id) is a table in ``folder``/index.
    A null payload is an empty one; a null url is replaced by the record's own
    name.  Rows that share both payload and the smallest id are all responses.  A
    row without an id is a record without one, and a revisit where an equal payload
    has an id.  A payload of any length is one record; other columns are ignored.
    No page: an empty index and no archive.
    """
    rows = with_revisits(pages, id_col, url_col, payload_col)
    rows = rows.select(F.col("page_id").cast("string"), "url", F.col("payload").cast("binary"), "digest", F.col("refers_to").cast("string"))

    def write(batches):
        archive = None
        for batch in in_slices(batches, 2):
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if archive is None:
                    archive = Archive(folder, f"pages-{uuid.uuid4().hex}.warc.zst", sample)
                archive.add(page_id, record(page_id, url, payload, digest, refers_to, date))
                if archive.at >= archive_bytes:
                    yield _index(archive)
                    archive = None
        if archive is not None:
            yield _index(archive)

    files, at = fs.FileSystem.from_uri(folder)
    files.create_dir(at)
    spark = pages.sparkSession
    rows.mapInArrow(write, INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    known = index.select("archive").distinct()
    if files.get_file_info(fs.FileSelector(at)):
        left = _archives(spark, folder).select("path", F.element_at(F.split("path", "/"), -1).alias("archive")).join(known, "archive", "left_anti")
        discard(spark, *[r.path for r in left.collect()])  # what repeated attempts left: none as a rule
    return index


def _index(archive: Archive) -> pa.RecordBatch:
    columns = list(zip(*archive.close()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["archive", "offset", "length", "page_id"])


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)


RECORDS = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the archives in ``folder``, an archive a row of Spark's own file reader: (page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]).

    A response's payload has to match its digest and length, or the job stops.
    Ids are texts, as in the records.  An empty folder gives no rows.
    """

    def read(batches):
        for batch in batches:
            for archive in batch.column(0):
                rows, held = [], 0
                for warc, http, payload in records_of(archive.as_buffer()):
                    size, digest, kind = int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha256:"), warc["warc-type"]
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"the payload of {warc['warc-record-id']} is not what was archived")
                    refers = warc.get("warc-refers-to")
                    row = (page_of(warc["warc-record-id"].strip("<>")), size, digest, kind, page_of(refers.strip("<>")) if refers else None)
                    rows.append((*row, payload) if payloads else row)
                    held += len(payload) if payloads else 0
                    if len(rows) >= 4096 or held >= 4 << 20:
                        yield _records(rows)
                        rows, held = [], 0
                if rows:
                    yield _records(rows)

    return _archives(spark, folder).select("content").mapInArrow(read, RECORDS + (", payload binary" if payloads else ""))


def _records(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names[: len(rows[0])])
