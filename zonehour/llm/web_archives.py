"""WARC files packaged in ZIP archives, and a reader that finds records in them by range reads.

An archive holds three stored (not compressed) members: `archive/data.warc.gz`, in which every record is
a gzip member of its own; `indexes/index.cdxj`, one line a record with its offset and length in that
member; and `datapackage.json`, which names both. The reader looks at the end of the ZIP file, its
central directory (ZIP64 included) and the local headers only, then reads the index, and then the byte
ranges of the records; nothing is extracted. An archive without an index has its records located by
walking through the gzip members.

Files are written under a name of their own by each attempt and then renamed, so a task that runs again
after an executor is lost replaces its file by an equal one.
"""

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, slices

#: Fixed values of the ZIP format: signatures, and what stands for "see the ZIP64 field".
END, LOCATOR, END64, CENTRAL, LOCAL = 0x06054B50, 0x07064B50, 0x06064B50, 0x02014B50, 0x04034B50
SHORT_FULL, LONG_FULL, ZIP64_FIELD = 0xFFFF, 0xFFFFFFFF, 1
#: Fixed values of the package layout and the WARC format.
DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Date of all records and members, so that files don't depend on when they are written.
DATE, ZIP_DATE = "2024-01-01T00:00:00Z", (2024, 1, 1, 0, 0, 0)

#: Payloads of at least so many bytes are written once.
LEAST_BYTES = 1000
#: Bytes that one range read gets at most, unless a record is longer; and bytes of records dealt to a task together.
READ_BYTES, BLOCK_BYTES = 1 << 20, 4 << 20

MANIFEST = "path string, n_records bigint, n_bytes bigint"
PLACES = "path string, offset bigint, length bigint"
RECORDS = ("page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
           "payload_digest string, payload binary")


# Writing

def with_record_types(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, digest, size, keeper): keeper is the page whose response a revisit refers to, else NULL.

    Of equal payloads of at least ``least`` bytes the rows with the largest page_id (all of them, if it
    repeats) are responses, the others revisit it; rows with a NULL page_id too, unless all of them have
    none. Digests are pre-aggregated map-side, so a payload that a third of all rows share is one row a
    task there; the payloads are shuffled once, and adaptive execution splits such a payload's partition.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("bigint")})
    repeated = (
        rows.where(F.col("size") >= least).groupBy("digest", "size")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1 AND keeper IS NOT NULL")
        .drop("copies")
    )
    return rows.join(repeated, ["digest", "size"], "left").select(
        "page_id", "url", "html", "digest", "size", F.expr("nullif(keeper, page_id)").alias("keeper"))


def _record_id(page_id: int | None, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page_id}')}>"


def _labelled(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, keeper: int | None) -> bytes:
    """One WARC record, not yet compressed: a response with its payload, or a revisit of ``keeper`` without it."""
    digest = hashlib.sha1(payload).digest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if keeper is None else "revisit"
    block = head + payload if keeper is None else head
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page_id, kind)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f%]", lambda c: f"%{ord(c[0]):02X}", url)))
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if keeper is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(keeper, "response")),
                   ("Refers-To-Page-ID", str(keeper))]
    fields += [("WARC-Payload-Digest", _labelled(digest)), ("WARC-Block-Digest", _labelled(hashlib.sha1(block).digest())),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode() for k, v in fields), b"\r\n", block, b"\r\n\r\n"])


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class ArchiveWriter:
    """Streams records into the data member of a ZIP; ``close`` adds the index and the package description."""

    def __init__(self, stream):
        self.zip, self.lines, self.at = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED), [], 0
        self.data = self._open(DATA)

    def _open(self, name: str):
        return self.zip.open(zipfile.ZipInfo(name, ZIP_DATE), "w", force_zip64=True)

    def add(self, page_id: int | None, url: str | None, payload: bytes, keeper: int | None) -> None:
        packed = _gzip(record_bytes(page_id, url, payload, keeper))
        self.data.write(packed)
        entry = {"url": url, "page": page_id, "filename": DATA, "offset": self.at, "length": len(packed)}
        self.lines.append(f"{DATE[:10].replace('-', '')}000000 {json.dumps(entry)}\n")
        self.at += len(packed)

    def close(self) -> None:
        self.data.close()
        index = "".join(self.lines).encode()
        package = {"profile": "data-package", "resources": [
            {"name": "data.warc.gz", "path": DATA, "bytes": self.at},
            {"name": "index.cdxj", "path": INDEX, "bytes": len(index), "hash": "sha256:" + hashlib.sha256(index).hexdigest()}]}
        for name, content in ((INDEX, index), (PACKAGE, json.dumps(package).encode())):
            with self._open(name) as member:
                member.write(content)
        self.zip.close()


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES) -> DataFrame:
    """Write one archive for each partition of the pages; the manifest has a row for each archive.

    ``folder`` must be shared by all machines (a path, or a URI that pyarrow's file systems know). NULL
    html is an empty payload; a NULL url or page_id is left out of its record; repeated rows all get a
    record; other columns are ignored; an empty table gives archives without records, or none.
    """
    manifest = arrow_schema(MANIFEST)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        place, root = FileSystem.from_uri(folder)
        place.create_dir(root, recursive=True)
        path, draft = f"{root}/part-{part:06d}.wacz", f"{root}/_draft-{part:06d}-{uuid.uuid4().hex}"
        with place.open_output_stream(draft) as stream:
            out = ArchiveWriter(stream)
            for batch in batches:
                for some in slices(batch, READ_BYTES):
                    for page_id, url, html, keeper in zip(*(some[c].to_pylist() for c in ("page_id", "url", "html", "keeper"))):
                        out.add(page_id, url, html.encode(), keeper)
            out.close()
        place.move(draft, path)
        yield pa.RecordBatch.from_pylist(
            [{"path": f"part-{part:06d}.wacz", "n_records": len(out.lines), "n_bytes": out.at}], schema=manifest)

    arrow_map(with_record_types(pages, least), write, MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


# Reading

@dataclass
class Member:
    method: int
    flags: int
    size: int
    header: int


class ZipDirectory:
    """Members of a ZIP file by its central directory. ``source`` has ``size()`` and ``read_at(length, offset)``."""

    def __init__(self, source):
        self.source, self.size = source, source.size()
        tail = self._read(max(0, self.size - 65557), min(self.size, 65557))
        at = len(tail) - 22
        while at >= 0 and not (tail.startswith(struct.pack("<I", END), at)
                               and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] <= len(tail)):
            at = tail.rfind(struct.pack("<I", END), 0, at + 3) if at else -1
        if at < 0:
            raise ValueError("not a ZIP file: no end of central directory")
        disk, first, _, count, length, start, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
        after = self.size - len(tail) + at
        if SHORT_FULL in (disk, first, count) or LONG_FULL in (length, start):
            mark, _, end64, _ = struct.unpack("<IIQI", self._read(after - 20, 20))
            if mark == LOCATOR:
                # The record stands right before its locator, also if other data precede the archive.
                near = after - 20 - 56
                end64 = near if self._read(near, 4) == struct.pack("<I", END64) else end64
                mark, _, _, _, disk, first, _, count, length, start = struct.unpack("<IQHHIIQQQQ", self._read(end64, 56))
                if mark != END64:
                    raise ValueError("the ZIP64 end of central directory is missing")
                after = end64
        if disk or first:
            raise ValueError("ZIP files in several parts can't be read")
        self.shift = after - length - start
        self.members: dict[str, Member] = {}
        directory, at = self._read(start + self.shift, length), 0
        for _ in range(count):
            mark, _, _, flags, method, _, _, _, packed, size, n, m, k, _, _, _, header = struct.unpack_from(
                "<IHHHHHHIIIHHHHHII", directory, at)
            if mark != CENTRAL:
                raise ValueError("the central directory is damaged")
            name = directory[at + 46:at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            size, packed, header = self._wide(directory[at + 46 + n:at + 46 + n + m], size, packed, header)
            self.members[name] = Member(method, flags, packed, header + self.shift)
            at += 46 + n + m + k

    def _read(self, at: int, length: int) -> bytes:
        data = self.source.read_at(length, at) if at >= 0 else b""
        if len(data) != length:
            raise ValueError("the ZIP file ends too early")
        return data

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """The 32-bit values, those that are full replaced in turn by the ZIP64 field's."""
        at, wide = 0, b""
        while at + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, at)
            if kind == ZIP64_FIELD:
                wide = extra[at + 4:at + 4 + length]
            at += 4 + length
        out, used = [], 0
        for value in values:
            if value == LONG_FULL and used + 8 <= len(wide):
                value, used = struct.unpack_from("<Q", wide, used)[0], used + 8
            out.append(value)
        return out

    def place(self, name: str) -> tuple[int, int]:
        """(offset, length) of a stored member's bytes in the ZIP file."""
        member = self.members[name]
        if member.method or member.flags & 1:
            raise ValueError(f"{name} is compressed or encrypted: its records can't be read by range")
        mark, n, m = struct.unpack("<I22xHH", self._read(member.header, 30))
        if mark != LOCAL:
            raise ValueError(f"the local header of {name} is missing")
        return member.header + 30 + n + m, member.size

    def read(self, name: str) -> bytes:
        return self._read(*self.place(name))


def record_places(archive: ZipDirectory) -> Iterator[tuple[int, int]]:
    """(offset, length) in the ZIP file of every record, from the indexes, or by walking through unindexed members."""
    indexed = set()
    for name in archive.members:
        if name.startswith("indexes/") and name.endswith((".cdxj", ".cdx.gz")):
            lines = archive.read(name)
            if name.endswith(".gz"):
                lines = zlib.decompress(lines, 47)
            for line in lines.splitlines():
                if b"{" not in line or line.startswith(b"!"):
                    continue
                entry = json.loads(line[line.index(b"{"):])
                member = entry["filename"]
                member = member if member in archive.members else f"archive/{member}"
                if member not in indexed:
                    indexed.add(member)
                yield archive.place(member)[0] + int(entry["offset"]), int(entry["length"])
    for name in archive.members:
        if name.startswith("archive/") and name.endswith(".warc.gz") and name not in indexed:
            yield from _walk(archive, *archive.place(name))


def _walk(archive: ZipDirectory, start: int, length: int) -> Iterator[tuple[int, int]]:
    """Places of the gzip members between start and start + length."""
    at, end, begin, unpack = start, start + length, start, zlib.decompressobj(31)
    data = b""
    while at < end or data:
        if not data:
            data = archive._read(at, min(READ_BYTES, end - at))
            at += len(data)
        unpack.decompress(data)
        data = unpack.unused_data
        if unpack.eof:
            stop = at - len(data)
            yield begin, stop - begin
            begin, unpack = stop, zlib.decompressobj(31)
    if begin != end:
        raise ValueError("the archive ends within a record")


def parsed_record(data: bytes) -> dict:
    """A record's fields as in ``RECORDS``; a response whose bytes don't match its digests is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    for name, what in (("warc-block-digest", block), ("warc-payload-digest", payload)):
        plain = fields["warc-type"] == "response" or name == "warc-block-digest"
        if plain and fields.get(name, "") not in ("", _labelled(hashlib.sha1(what).digest())):
            raise ValueError(f"a record doesn't match its {name}")
    stated = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    response = fields["warc-type"] == "response"
    digest = fields.get("warc-payload-digest", "")
    return {
        "page_id": int(fields["page-id"]) if "page-id" in fields else None,
        "url": re.sub(r"%([01][0-9A-F]|20|25|7F)", lambda c: chr(int(c[1], 16)), fields["warc-target-uri"])
        if "warc-target-uri" in fields else None,
        "record_type": fields["warc-type"],
        "refers_to": int(fields["refers-to-page-id"]) if "refers-to-page-id" in fields else None,
        "payload_bytes": len(payload) if response else int(stated[1]) if stated else None,
        "payload_digest": base64.b32decode(digest.partition(":")[2]).hex() if digest else None,
        "payload": payload if response else None}


def locate_records(manifest: DataFrame, folder: str) -> DataFrame:
    """(path, offset, length) of all records of the archives that ``manifest`` lists in its column path."""
    places = arrow_schema(PLACES)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch["path"].to_pylist():
                with store.open_input_file(f"{root}/{path}") as source:
                    found = sorted(record_places(ZipDirectory(source)))
                    for at in range(0, len(found), 10_000):
                        some = found[at:at + 10_000]
                        yield pa.RecordBatch.from_pydict(
                            {"path": [path] * len(some), "offset": [o for o, _ in some], "length": [n for _, n in some]},
                            schema=places)

    files = max(1, manifest.count())
    return arrow_map(manifest.select("path").repartition(files, "path"), locate, PLACES)


def read_records(places: DataFrame, folder: str, total_bytes: int, payloads: bool = True) -> DataFrame:
    """``RECORDS`` of all given places, by range reads; ``payloads`` False leaves the payload NULL.

    Places are dealt by blocks of archives, so one large archive is read by many tasks; neighbouring
    records are read together. ``total_bytes`` (of all places) sets the number of tasks.
    """
    records = arrow_schema(RECORDS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = FileSystem.from_uri(folder)
        for batch in batches:
            rows, size, opened, source = [], 0, None, None
            asked = list(zip(*(batch[c].to_pylist() for c in ("path", "offset", "length"))))
            try:
                for path, start, ends in _ranges(asked):
                    if path != opened:
                        if source:
                            source.close()
                        opened, source = path, store.open_input_file(f"{root}/{path}")
                    data = source.read_at(ends[-1] - start, start)
                    at = 0
                    for end in ends:
                        row = parsed_record(zlib.decompress(data[at:end - start], 31))
                        at = end - start
                        size += row["payload_bytes"] or 0
                        rows.append(row if payloads else row | {"payload": None})
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=records)
                        rows, size = [], 0
            finally:
                if source:
                    source.close()
            yield pa.RecordBatch.from_pylist(rows, schema=records)

    tasks = max(1, -(-total_bytes // BLOCK_BYTES))
    dealt = places.withColumn("block", F.expr(f"offset div {BLOCK_BYTES}")).repartition(tasks, "path", "block")
    return arrow_map(dealt.sortWithinPartitions("path", "offset").drop("block"), read, RECORDS)


def _ranges(asked: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, list[int]]]:
    """Neighbouring records together: (path, start, end of each record), at most READ_BYTES unless one is longer."""
    path = start = None
    ends: list[int] = []
    for name, offset, length in asked:
        if ends and (name != path or offset != ends[-1] or offset + length - start > READ_BYTES):
            yield path, start, ends
            ends = []
        if not ends:
            path, start = name, offset
        ends.append(offset + length)
    if ends:
        yield path, start, ends


def archived_pages(pages: DataFrame, folder: str, least: int = LEAST_BYTES) -> DataFrame:
    """Write all pages to archives in ``folder`` and read them back without their payloads."""
    manifest = write_archives(pages, folder, least)
    total = manifest.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    return read_records(locate_records(manifest, folder), folder, total, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
