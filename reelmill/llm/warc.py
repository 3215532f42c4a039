"""WARC archives: one monolithic gzip stream per file becomes one member per record with an offset index (operator 13).

1. ``write_archives`` writes a table of pages with Spark's text writer: records parted by blank lines, each file a single gzip stream,
   as tools that compress a finished archive leave it. Of equal payloads of at least ``REVISIT_BYTES`` bytes the record with the
   largest id holds the payload, the others are revisit records that refer to it.
2. ``normalise`` inflates each file once, as a stream, and writes every record as a gzip member of its own. A sidecar beside the
   archive lists offset, length, type, ids and payload digest of each record. One task works through one file; of a record only a
   chunk is in memory. Files appear under their name when complete, so a lost or doubled task changes nothing.
3. ``read_records`` reads the records of any part of an index by their offsets, checks their digests and returns them.

Equality of payloads is that of their SHA-256. A null payload is empty. A null id counts as the smallest; rows that repeat the largest id of a
group are all responses, as are groups without any id. Repeated rows give a record each. Urls may be null; line breaks in them are
percent-encoded. Empty tables give no records. Extra columns are ignored. Truncated archives and texts that are no records raise
ValueError with the file's name, as does a payload that differs from its digest. Folders may lie on any file system that pyarrow can open.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import stored

#: Least payload that is stored once for all its copies; bytes read at once; bytes of neighbouring records fetched together.
REVISIT_BYTES, CHUNK, FETCH = 1000, 1 << 20, 4 << 20
#: Fixed values of the format.
END = b"\r\n\r\n"
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = (
    "archive string, offset long, length long, record_id string, record_type string, target_uri string, refers_to string, "
    "payload_bytes long, payload_digest string"
)


def write_archives(pages: DataFrame, folder: str, id_column: str, uri_column: str, payload_column: str, date: str, records_per_file: int = 50_000) -> None:
    """Write a record per row of ``pages`` to gzip files below ``folder``."""
    payload = F.coalesce(F.col(payload_column).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_column).cast("long").alias("id"), F.col(uri_column).cast("string").alias("uri"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"),
    )
    # payloads too small to share get keys that no other row has to meet
    key = F.when(F.col("bytes") >= REVISIT_BYTES, F.sha2("payload", 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "uri").cast("string")))
    rows = rows.withColumn("key", key)
    groups = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("first"))
    shared = stored(groups.where("n > 1").select("key", "first"), "shared_payloads")
    known = rows.join(shared, "key", "left")
    revisit = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("first")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    name = lambda value: F.concat(F.lit("<urn:page:"), F.coalesce(value.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    uri = F.replace(F.replace("uri", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("id"))),
        F.lit(f"WARC-Date: {date}\r\n"),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("payload"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("first"))), F.lit(f"WARC-Profile: {PROFILE}\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    records = known.select(F.concat(head, F.lit("\r\n"), block).alias("value"))
    writer = records.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_file)
    writer.text(folder)


class RecordStream:
    """Records of a gzip stream (of one member or many), one after another; blocks come in chunks."""

    def __init__(self, source, name: str) -> None:
        self.source, self.name = source, name
        self.inflate, self.held, self.ended, self.fresh = zlib.decompressobj(31), bytearray(), False, True

    def _more(self) -> bool:
        """Inflate one more chunk; false at the end."""
        if self.ended:
            return False
        raw = self.inflate.unconsumed_tail or self.source.read(CHUNK)
        if not raw:
            self.ended = True
            if not self.fresh and not self.inflate.eof:
                raise ValueError(f"{self.name}: the gzip stream is cut short")
            return False
        while raw:
            try:
                self.held += self.inflate.decompress(raw, 4 * CHUNK)
            except zlib.error as error:
                raise ValueError(f"{self.name}: {error}") from error
            self.fresh = False
            if not self.inflate.eof:
                break
            raw = self.inflate.unused_data.lstrip(b"\0")
            self.inflate, self.fresh = zlib.decompressobj(31), True
        return True

    def until(self, mark: bytes) -> bytes:
        """The bytes up to a mark, which is skipped; empty at the end of the stream."""
        begin = 0
        while (found := self.held.find(mark, begin)) < 0:
            begin = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held:
                    raise ValueError(f"{self.name}: a record is cut short")
                return b""
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return out

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self._more():
                raise ValueError(f"{self.name}: a record is cut short")
            part = bytes(self.held[:size])
            del self.held[: len(part)]
            size -= len(part)
            if part:
                yield part

    def records(self) -> Iterator[tuple[bytes, dict[str, str], Iterator[bytes]]]:
        """Raw header, header fields (names in lower case) and the chunks of the block, which must be used up."""
        while head := self.until(END):
            fields = header_fields(head)
            if not head.startswith(b"WARC/") or not fields.get("content-length", "").isdigit():
                raise ValueError(f"{self.name}: not a WARC record: {head[:60]!r}")
            yield head, fields, self.take(int(fields["content-length"]))
            if b"".join(self.take(len(END))) != END:
                raise ValueError(f"{self.name}: a record is longer than its Content-Length")


def header_fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


class PayloadDigest:
    """Length and SHA-1 of the payload of a block that comes in chunks; an HTTP head is no payload."""

    def __init__(self, fields: dict[str, str]) -> None:
        self.fields, self.sha, self.size = fields, hashlib.sha1(), 0
        self.head = bytearray() if fields.get("content-type", "").startswith("application/http") else None
        self.http: dict[str, str] = {}

    def add(self, chunk: bytes) -> bytes:
        """The part of a chunk that is payload."""
        if self.head is not None:
            self.head += chunk
            found = self.head.find(END)
            if found < 0:
                return b""
            self.http = header_fields(bytes(self.head[:found]))
            chunk, self.head = bytes(self.head[found + len(END) :]), None
        self.sha.update(chunk)
        self.size += len(chunk)
        return chunk

    def result(self, name: str) -> tuple[int, str]:
        """Of the full payload: a revisit names the length and digest of what it left out; a digest that differs is an error."""
        stated = self.fields.get("warc-payload-digest", "")
        if self.fields.get("warc-type") == "revisit":
            return int(self.http.get("content-length", "0") or 0), stated.removeprefix("sha1:")
        if stated.startswith("sha1:") and stated[5:] != self.sha.hexdigest():
            raise ValueError(f"{name}: payload of {self.fields.get('warc-record-id')} differs from its digest")
        return self.size, self.sha.hexdigest()


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path)


def _publish(system: fs.FileSystem, made: str, place: str) -> None:
    """Move a complete file to its name; an earlier attempt's file of equal content gives way."""
    if not isinstance(system, fs.LocalFileSystem) and system.get_file_info(place).type == fs.FileType.File:
        system.delete_file(place)
    system.move(made, place)


def _normalise_file(path: str, target: str) -> int:
    """Rewrite one archive below ``target``; its sidecar follows when the archive is complete."""
    source, inner = _file_system(path)
    system, folder = _file_system(target)
    base = f"{zlib.crc32(path.encode()):08x}-{path.rsplit('/', 1)[1].split('.')[0]}.warc.gz"
    made = f"{folder}/_{uuid.uuid4().hex}"
    count, offset = 0, 0
    with source.open_input_stream(inner, compression=None) as raw, system.open_output_stream(made, compression=None) as out, \
            system.open_output_stream(f"{made}.index", compression=None) as sidecar:
        for head, fields, chunks in RecordStream(raw, path).records():
            member, payload = zlib.compressobj(6, zlib.DEFLATED, 31), PayloadDigest(fields)
            length = out.write(member.compress(head + END))
            for chunk in chunks:
                payload.add(chunk)
                length += out.write(member.compress(chunk))
            length += out.write(member.compress(END) + member.flush())
            size, digest = payload.result(path)
            entry = {
                "archive": f"{target}/{base}", "offset": offset, "length": length, "record_id": fields.get("warc-record-id"),
                "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
                "payload_bytes": size, "payload_digest": digest,
            }
            sidecar.write(json.dumps(entry).encode() + b"\n")
            offset, count = offset + length, count + 1
    _publish(system, made, f"{folder}/{base}")
    _publish(system, f"{made}.index", f"{folder}/{base}.index")
    return count


def normalise(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Rewrite every ``*.gz`` archive of ``folder`` below ``target``, one member per record; returns the index that the sidecars hold."""
    system, place = _file_system(target)
    system.create_dir(place, recursive=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [_normalise_file(path, target) for path in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["records"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path")
    files.mapInArrow(work, "records long").agg(F.sum("records")).first()
    return read_index(spark, target)


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """The sidecars of all archives of a folder."""
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.index").json(target)


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """record_id, record_type, target_uri, refers_to, payload_bytes, payload_digest and, if asked for, the payload of indexed records.

    Each record is fetched by its offset, inflated alone and checked against its digest and the index. Records that follow
    each other in an archive are fetched together, up to ``FETCH`` bytes. A revisit's payload is null; see ``resolve_revisits``.
    """
    names = ["record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload"][: 6 + with_payload]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, file = None, None
        for batch in batches:
            entries = batch.to_pylist()
            at = 0
            while at < len(entries):
                last, end = at + 1, entries[at]["offset"] + entries[at]["length"]
                while last < len(entries) and entries[last]["archive"] == entries[at]["archive"] and entries[last]["offset"] == end \
                        and end + entries[last]["length"] - entries[at]["offset"] <= FETCH:
                    end += entries[last]["length"]
                    last += 1
                if entries[at]["archive"] != archive:
                    if file is not None:
                        file.close()
                    archive = entries[at]["archive"]
                    system, inner = _file_system(archive)
                    file = system.open_input_file(inner)
                begin = entries[at]["offset"]
                file.seek(begin)
                raw = file.read(end - begin)
                rows = [_read_entry(e, raw[e["offset"] - begin : e["offset"] - begin + e["length"]], with_payload) for e in entries[at:last]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                at = last
        if file is not None:
            file.close()

    schema = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string"
    wanted = index.select("archive", "offset", "length", "payload_digest")
    return wanted.mapInArrow(work, schema + (", payload binary" if with_payload else ""))


def _read_entry(entry: dict, member: bytes, with_payload: bool) -> tuple:
    name = f"{entry['archive']} at {entry['offset']}"
    stream = RecordStream(pa.BufferReader(member), name)
    head, fields, chunks = next(stream.records())
    digest = PayloadDigest(fields)
    parts = [digest.add(chunk) for chunk in chunks]
    size, sha = digest.result(name)
    if sha != entry["payload_digest"]:
        raise ValueError(f"{name}: the record differs from the index")
    kind = fields.get("warc-type")
    row = (fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"), size, sha)
    return row + ((None if kind == "revisit" else b"".join(parts),) if with_payload else ())


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records read with payloads, in which every revisit has the payload of the response that it refers to."""
    full = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload").alias("__payload"))
    wanted = records.where("record_type = 'revisit'").select("refers_to").distinct()
    found = full.join(wanted, "refers_to").dropDuplicates(["refers_to"])
    return records.join(found, "refers_to", "left").withColumn("payload", F.coalesce("payload", "__payload")).select(*records.columns)


def page_records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, read back from normalised archives."""
    spark = pages.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, f"{base}/monolithic", "page_id", "url", "html", date)
    records = read_records(normalise(spark, f"{base}/monolithic", f"{base}/records"))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as long)")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
