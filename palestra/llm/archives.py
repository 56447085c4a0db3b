"""Legacy ARC archives, and their conversion to WARC.

Method: ARC records are found by their header lines, whose fields depend on the version
that the archive's first record declares, and by their declared lengths. From each record
the WARC identifier, timestamp, type and digests are synthesised. Payload digests decide
on Spark which records become revisits: only digests, lengths and keys are shuffled, and
counts are pre-aggregated, so many copies of one payload are no hot task.

Archives are written by Spark's own text writer to any file system it knows; the record
separator of the format is the writer's line separator. An archive ends at a number of
records or of bytes, whichever comes first, so that a reader's task is bounded; a longer
record has an archive of its own.

Defined results: a null html is an empty payload, a null url ``about:blank``; null page
ids sort last; of records with equal payload and equal page id one is the response and the
others revisit it; no pages give no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palestra.llm.arrays import slices
from palestra.llm.scratch import Scratch

RECORDS_PER_ARCHIVE = 2000
BYTES_PER_ARCHIVE = 1 << 25
# fixed values: the fields of a record's header line by version
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum",
        "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_END = "\r\n\r\n"
_SPEED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def digest_of(content: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(content).digest()).decode()


def _plain(text: str | None) -> str:
    """A URL without the white space that would end a header field."""
    found = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "")
    return found or "about:blank"


@dataclass(frozen=True)
class ArcRecord:
    version: int
    fields: dict[str, str]
    offset: int
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block[self.block.find(b"\r\n\r\n") + 4 :]

    def http_header(self, name: str) -> str | None:
        head = self.block[: self.block.find(b"\r\n\r\n")].decode("utf-8", "replace")
        for line in head.split("\r\n")[1:]:
            key, _, value = line.partition(":")
            if key.strip().lower() == name.lower():
                return value.strip()
        return None


def arc_records(content: bytes) -> Iterator[ArcRecord]:
    """The records of one archive after its version block."""
    content = zlib.decompress(content, 31) if content[:2] == b"\x1f\x8b" else content
    at, version = 0, 0
    while at < len(content):
        if content[at : at + 1] == b"\n":  # the separator of records
            at += 1
            continue
        end = content.index(b"\n", at)
        values = content[at:end].decode("utf-8").split(" ")
        length = int(values[-1])
        block = content[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError(f"the record at {at} ends before its declared length")
        if version:
            names = ARC_FIELDS[version]
            if len(values) != len(names):
                raise ValueError(f"the header at {at} does not fit version {version}: {values}")
            yield ArcRecord(version, dict(zip(names, values)), at, block)
        else:
            version = int(block.split(b" ", 1)[0])
        at = end + 1 + length


def _arc_start(version: int, name: str, date: str) -> str:
    block = f"{version} 0 palestra\n{' '.join(ARC_FIELDS[version])}\n"
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date,
              "Content-type": "text/plain", "Result-code": "200", "Checksum": "-",
              "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(block))}
    return " ".join(values[f] for f in ARC_FIELDS[version]) + "\n" + block


class _Archives:
    """Gathers the records of one task with the numbers of their archives."""

    schema = "archive int, at long, value string"

    def __init__(self, records: int, bytes_: int):
        self._limits = records, bytes_
        self.archive, self.written, self.size, self.at, self._rows = -1, 0, 0, 0, []

    def full(self, more: int) -> bool:
        """Whether a new archive begins, as the next ``more`` bytes are too many."""
        records, bytes_ = self._limits
        if self.archive >= 0 and self.written < records and (self.written < 2 or self.size + more <= bytes_):
            return False
        self.archive, self.written, self.size = self.archive + 1, 0, 0
        return True

    def add(self, record: str, separator: str) -> None:
        self._rows.append((self.archive, self.at, record))
        self.written, self.at = self.written + 1, self.at + 1
        self.size += len(record.encode()) + len(separator)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self._rows)) or [()] * 3
        self._rows = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.string()))],
            names=["archive", "at", "value"],
        )


def _write(records: DataFrame, path: str, separator: str) -> None:
    """One file per task and archive, the records in their order."""
    ordered = records.sortWithinPartitions("archive", "at").select("archive", "value")
    ordered.write.partitionBy("archive").options(lineSep=separator, **_SPEED).text(path)


def write_arc(
    pages: DataFrame, path: str, date: str = "20240120090000", versions: tuple[int, ...] = (1, 2),
    per_archive: int = RECORDS_PER_ARCHIVE, bytes_per_archive: int = BYTES_PER_ARCHIVE,
) -> None:
    """One ARC record per page; the versions take turns over the partitions."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = versions[part % len(versions)], ""
        out = _Archives(per_archive, bytes_per_archive)
        for batch in slices(batches, "html"):
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                payload = html or ""
                content = payload.encode()
                if out.full(len(content)):
                    name = f"pages-{part}-{out.archive}.arc"
                    out.add(_arc_start(version, name, date), "\n")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(content)}\r\n"
                head += "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                values = {"URL": _plain(url), "IP-address": "0.0.0.0", "Archive-date": date,
                          "Content-type": "text/html", "Result-code": "200",
                          "Checksum": digest_of(content), "Location": "-",
                          "Offset": str(out.size), "Filename": name,
                          "Archive-length": str(len(head.encode()) + 2 + len(content))}
                out.add(" ".join(values[f] for f in ARC_FIELDS[version]) + f"\n{head}\r\n{payload}", "\n")
            yield out.batch()

    _write(pages.select("page_id", "url", "html").mapInArrow(rows, _Archives.schema), path, "\n")


def _archives(spark, path: str) -> DataFrame:
    """The archives; a folder that no record was written to has none."""
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def _record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def _timestamp(date: str) -> str:
    """The ISO form of an ARC date of 14 digits, or of 12 in old archives."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def arc_index(archives: DataFrame) -> DataFrame:
    """Per ARC record its place, keys and payload digest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(batch.column(c) for c in ("path", "content"))):
                archive = path.as_py()
                found = [
                    (archive, r.offset, _record_id(archive, r.offset), r.http_header("X-Page-Id"),
                     r.fields["URL"], _timestamp(r.fields["Archive-date"]), len(r.payload), digest_of(r.payload))
                    for r in arc_records(content.as_py())
                ]
                columns = list(zip(*found)) or [()] * 8
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, _INDEX_TYPES)], names=_INDEX_NAMES
                )

    schema = ("path string, offset long, record_id string, page_id string, url string, "
              "date string, payload_bytes long, payload_digest string")
    return archives.mapInArrow(rows, schema).withColumn("page_id", F.col("page_id").cast("long"))


_INDEX_NAMES = ["path", "offset", "record_id", "page_id", "url", "date", "payload_bytes", "payload_digest"]
_INDEX_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]


def revisits(index: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The records whose payload an earlier record has, with that record's keys."""
    key = ["payload_digest", "payload_bytes"]
    order = F.struct(
        F.col("page_id").isNull().alias("none"), "page_id", "record_id", "url", "date"
    )
    first = (
        index.where(F.col("payload_bytes") >= least_bytes)
        .groupBy(*key)
        .agg(F.min(order).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(*key, F.col("first.record_id").alias("to_id"), F.col("first.url").alias("to_url"),
                F.col("first.date").alias("to_date"))
    )
    return index.join(first, key).where("record_id <> to_id").select(
        "path", "offset", "to_id", "to_url", "to_date"
    )


def _warc_record(kind: str, headers: list[tuple[str, str]], block: str, size: int) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {size}"]
    return "\r\n".join(lines) + "\r\n\r\n" + block


def write_warc(
    archives: DataFrame, found: DataFrame, path: str, per_archive: int = RECORDS_PER_ARCHIVE,
    bytes_per_archive: int = BYTES_PER_ARCHIVE,
) -> None:
    """Each ARC record as a WARC record. The revisits of one archive come as one row, which
    is bounded by the archive's number of records."""
    told = found.groupBy("path").agg(
        F.collect_list(F.struct("offset", "to_id", "to_url", "to_date")).alias("revisits")
    )

    def records(content: bytes, archive: str, told: dict) -> Iterator[tuple[str, int]]:
        for r in arc_records(content):
            at = told.get(r.offset)
            head = r.block[: len(r.block) - len(r.payload)]
            block = head if at else r.block
            headers = [
                ("WARC-Record-ID", _record_id(archive, r.offset)),
                ("WARC-Date", _timestamp(r.fields["Archive-date"])),
                ("WARC-Target-URI", r.fields["URL"]), ("WARC-IP-Address", r.fields["IP-address"]),
                ("WARC-Payload-Digest", f"sha1:{digest_of(r.payload)}"),
                ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
                ("Content-Type", "application/http; msgtype=response"),
            ]
            if at:
                headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", at["to_id"]),
                            ("WARC-Refers-To-Target-URI", at["to_url"]), ("WARC-Refers-To-Date", at["to_date"])]
            yield _warc_record("revisit" if at else "response", headers, block.decode("utf-8"), len(block)), len(block)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Archives(per_archive, bytes_per_archive)
        for batch in batches:
            for archive, content, places in zip(*(batch.column(c) for c in ("path", "content", "revisits"))):
                told = {p["offset"]: p for p in places.as_py() or ()}
                for record, size in records(content.as_py(), archive.as_py(), told):
                    if out.full(size):
                        text = "software: palestra\r\nformat: WARC File Format 1.1\r\n"
                        ident = uuid.uuid5(uuid.NAMESPACE_URL, f"{archive.as_py()}#{out.archive}")
                        headers = [("WARC-Record-ID", f"<urn:uuid:{ident}>"), ("WARC-Date", "2024-01-20T09:00:00Z"),
                                   ("Content-Type", "application/warc-fields")]
                        out.add(_warc_record("warcinfo", headers, text, len(text)), WARC_END)
                    out.add(record, WARC_END)
                yield out.batch()

    _write(archives.join(told, "path", "left").mapInArrow(rows, _Archives.schema), path, WARC_END)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of one archive."""
    content = zlib.decompress(content, 31) if content[:2] == b"\x1f\x8b" else content
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at {at}")
        headers = {k: v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(headers["Content-Length"])
        block = content[end + 4 : end + 4 + size]
        if content[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end after its declared length")
        yield headers, block
        at = end + 8 + size


def read_warc(spark, path: str) -> DataFrame:
    """One row per response and revisit, each payload checked against its digest."""

    def row(headers: dict, block: bytes) -> dict:
        record = ArcRecord(0, {}, 0, block)
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(record.http_header("Content-Length"))
        if headers["WARC-Type"] == "response" and (digest_of(record.payload), len(record.payload)) != (digest, size):
            raise ValueError(f"payload and digest of {headers['WARC-Record-ID']} differ")
        return {"page_id": record.http_header("X-Page-Id"), "url": headers["WARC-Target-URI"],
                "date": headers["WARC-Date"], "payload_bytes": size, "payload_digest": digest,
                "record_type": headers["WARC-Type"], "record_id": headers["WARC-Record-ID"],
                "refers_to_id": headers.get("WARC-Refers-To")}

    names = ["page_id", "url", "date", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_id"]
    types = [pa.int64() if n == "payload_bytes" else pa.string() for n in names]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                found = [row(h, b) for h, b in warc_records(content.as_py()) if h["WARC-Type"] != "warcinfo"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[n] for f in found], t) for n, t in zip(names, types)], names=names
                )

    schema = ", ".join(f"{n} {'long' if n == 'payload_bytes' else 'string'}" for n in names)
    return _archives(spark, path).mapInArrow(rows, schema).withColumn("page_id", F.col("page_id").cast("long"))


def converted(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Pages through ARC to WARC and back: one row per record as the WARC archives tell it."""
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark)
    arc, warc = scratch.path("arc"), scratch.path("warc")
    write_arc(pages, arc)
    archives = _archives(spark, arc)
    index = scratch.table(arc_index(archives), "index")
    write_warc(archives, revisits(index), warc)
    scratch.delete(arc)
    scratch.drop(index)
    # keys and digests only; the archives are read and checked once
    records = scratch.table(read_warc(spark, warc), "records")
    scratch.delete(warc)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date"]
    responses = records.where("record_type = 'response'")
    targets = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    # responses refer to nothing and need no join, which would send them all to one task
    repeated = records.where("record_type = 'revisit'").join(targets, "refers_to_id", "left")
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionAll(repeated.select(columns))
