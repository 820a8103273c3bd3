"""Legacy archives: ARC files to WARC files, and both from and to tables.

Spark's text writer makes the files, so any storage that Spark writes will do; each file is one gzip stream of a bounded
number of records and bytes. ARC records are cut by their declared lengths, with the fields that the file's version block names. WARC records
get identifiers, timestamps, types and digests from what the ARC record says: of equal payloads the one with the largest
page id is the response, the others revisit it. Two archives are never joined by address, only by digest and length.

Defined cases: null html is an empty payload; a null page id never becomes a revisit's target unless all are null, then
all are responses; repeated rows (same id, same payload) are all responses if theirs is the largest id; a null url becomes
urn:page:<id>, and white space in urls is percent-encoded; an empty table gives no records; extra columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.common import bounded_batches, join_counted, materialize, new_path

#: Field names in the version blocks of the two ARC versions. Fixed values of the format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records in one archive file, its version block included, and about its bytes before compression at most. Pages up to
#: `SMALL` bytes share files of RECORDS; larger ones have files of fewer records.
RECORDS = 4096
FILE_BYTES = 64 << 20
SMALL = FILE_BYTES // RECORDS
EPOCH = datetime(2001, 1, 1, tzinfo=UTC)

LIGHT = pa.schema([("page_id", pa.int64()), ("digest", pa.string()), ("size", pa.int64()), ("file", pa.string()), ("at", pa.int32())])
LIGHT_DDL = "page_id long, digest string, size long, file string, at int"
WARC = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("warc_date", pa.string()), ("target_uri", pa.string())])
WARC_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, target_uri string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- ARC ----


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 fieldglass\n{ARC_FIELDS[version]}\n".encode()
    head = {1: f"filedesc://{name} 0.0.0.0 20010101000000 text/plain {len(body)}", 2: f"filedesc://{name} 0.0.0.0 20010101000000 text/plain 200 - - 0 {name} {len(body)}"}[version]
    return head.encode() + b"\n" + body


def arc_record(version: int, name: str, url: str, date: str, block: bytes) -> bytes:
    head = {1: f"{url} 0.0.0.0 {date} text/html {len(block)}", 2: f"{url} 0.0.0.0 {date} text/html 200 - - 0 {name} {len(block)}"}[version]
    return head.encode() + b"\n" + block


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The fields and the block of each record after the version block."""
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        head = data[at:end].decode("utf-8").split(" ")
        size = int(head[-1])
        block = data[end + 1 : end + 1 + size]
        if len(block) != size:
            raise ValueError(f"the record at {at} declares {size} bytes and has {len(block)}")
        at = end + 1 + size
        if fields is None:
            if not head[0].startswith("filedesc://"):
                raise ValueError("an ARC file begins with its version block")
            lines = block.decode("utf-8").split("\n")
            fields = lines[1].split(" ")
            if ARC_FIELDS.get(int(lines[0].split(" ")[0])) != lines[1]:
                raise ValueError(f"unknown ARC version block: {lines[:2]}")
            continue
        if len(head) != len(fields):
            raise ValueError(f"a record has {len(head)} fields, not {len(fields)}")
        yield dict(zip(fields, head, strict=True)), block


def http_block(page_id: int | None, payload: bytes) -> bytes:
    own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n" % (own, len(payload)) + payload


def http_fields(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode("latin-1").split("\r\n")[1:])}, payload


def _lines(rows: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()).view(pa.string())], names=["value"])  # any bytes: Spark writes them as they are


def write_arc(pages: DataFrame, path: str, records: int = RECORDS) -> None:
    """pages: page_id, url, html. Folders `small` and `large` by the page's size; versions 1 and 2 alternate between files."""
    bounded_batches(pages.sparkSession)
    space = {c: f"%{ord(c):02X}" for c in " \t\n\r\x0b\x0c"}

    def archives(count: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
            n = 0
            for batch in batches:
                out = []
                for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if n % count == 0:
                        version, name = 1 + (task + n // count) % 2, f"pages-{task:05d}-{n // count:05d}.arc"
                        out.append(arc_version_block(version, name))
                        n += 1
                    target = (url or f"urn:page:{page_id}").translate(str.maketrans(space)) or "urn:page:"
                    date = (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 29))).strftime("%Y%m%d%H%M%S")
                    out.append(arc_record(version, name, target, date, http_block(page_id, html)))
                    n += 1
                if out:
                    yield _lines(out)

        return run

    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    size = F.octet_length("html")
    for kind, count in records_by_size(rows, records).items():
        _write(rows.where(size <= SMALL if kind == "small" else size > SMALL).mapInArrow(archives(count), "value string"), f"{path}/{kind}", "\n", count)


def records_by_size(rows: DataFrame, records: int) -> dict[str, int]:
    """How many records a file of small and one of large pages holds, so that neither exceeds FILE_BYTES by more than one record."""
    longest = rows.agg(F.max(F.octet_length("html"))).first()[0] or 0
    return {"small": records} | ({"large": max(2, min(records, FILE_BYTES // longest))} if longest > SMALL else {})


def _write(rows: DataFrame, path: str, separator: str, records: int) -> None:
    rows.write.options(lineSep=separator, compression="gzip", maxRecordsPerFile=str(records), **{"zlib.compress.level": "BEST_SPEED"}).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content", "path")


def _unzipped(content: bytes) -> bytes:
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content) + member.flush())
        content = member.unused_data
    return b"".join(out)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, digest and size of each record's payload, and its file and place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, file in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows = []
                for at, (_, block) in enumerate(parse_arc(_unzipped(content.as_py()))):
                    http, payload = http_fields(block)
                    rows.append((_page(http), digest_of(payload), len(payload), file, at))
                if rows:
                    yield _batch(rows, LIGHT)

    return _files(spark, path).mapInArrow(run, LIGHT_DDL)


def _page(http: dict[str, str]) -> int | None:
    return int(http["x-page-id"]) if "x-page-id" in http else None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


# ---- WARC ----


def record_id(page_id: int | None, digest: str) -> str:
    """A version-8 UUID of the page id and the first bits of the digest."""
    n = 0 if page_id is None else page_id & (1 << 64) - 1
    a = int.from_bytes(base64.b32decode(digest)[:6])
    b = (n >> 62) | (4 if page_id is None else 0)
    x = f"{a:012x}8{b:03x}{1 << 63 | n & (1 << 62) - 1:016x}"
    return f"urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}"


def page_of(identifier: str) -> int | None:
    x = identifier.removeprefix("urn:uuid:").replace("-", "")
    b = int(x[13:16], 16)
    n = (b & 3) << 62 | int(x[16:], 16) & (1 << 62) - 1
    return None if b & 4 else n - (1 << 64) if n >> 63 else n


def warc_record(page_id: int | None, digest: str, url: str, date: str, block: bytes, target: int | None) -> bytes:
    """target: the page id of the response that this record revisits, if it does."""
    own = record_id(page_id, digest)
    when = datetime.strptime(date, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    kind = "response"
    more = ""
    if target is not None:
        kind = "revisit"
        more = f"WARC-Refers-To: <{record_id(target, digest)}>\r\nWARC-Profile: {REVISIT_PROFILE}\r\n"
        block = block[: block.index(b"\r\n\r\n") + 4]
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{own}>\r\nWARC-Date: {when}\r\nWARC-Target-URI: {url}\r\n{more}WARC-Payload-Digest: sha1:{digest}\r\nWARC-Block-Digest: sha1:{digest_of(block)}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end where it declares")
        at = end + 8 + size
        yield fields, block


def warc_info(name: str) -> bytes:
    body = b"software: fieldglass\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid5(NAMESPACE_URL, name)}>\r\nWARC-Date: {EPOCH:%Y-%m-%dT%H:%M:%SZ}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body


def write_warc(files: DataFrame, path: str, count: int = RECORDS) -> None:
    """files: content of an ARC file and `targets`, by place in it the page whose response a record revisits."""
    bounded_batches(files.sparkSession, rows=4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, out = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            for content, targets in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                of = {x["at"]: x["target"] for x in targets or ()}
                for at, (fields, block) in enumerate(parse_arc(_unzipped(content.as_py()))):
                    if n % count == 0:
                        out.append(warc_info(f"{path}-{task:05d}-{n // count:05d}"))
                        n += 1
                    http, payload = http_fields(block)
                    out.append(warc_record(_page(http), digest_of(payload), fields["URL"], fields["Archive-date"], block, of.get(at)))
                    n += 1
                    if len(out) >= 500:
                        yield _lines(out)
                        out = []
        if out:
            yield _lines(out)

    _write(files.select("content", "targets").mapInArrow(run, "value string"), path, "\r\n\r\n", count)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for fields, block in parse_warc(_unzipped(content.as_py())):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    http, payload = http_fields(block)
                    kind, own = fields["WARC-Type"], fields["WARC-Record-ID"].strip("<>")
                    digest = digest_of(payload) if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Payload-Digest"] != f"sha1:{digest}" or fields["WARC-Block-Digest"] != f"sha1:{digest_of(block)}":
                        raise ValueError(f"{own}: the digest doesn't match")
                    size = len(payload) if kind == "response" else int(http["content-length"])
                    target = page_of(fields["WARC-Refers-To"].strip("<>")) if kind == "revisit" else None
                    rows.append((page_of(own), size, digest, kind, target, own, fields["WARC-Date"], fields["WARC-Target-URI"]))
                if rows:
                    yield _batch(rows, WARC)

    return _files(spark, path).mapInArrow(run, WARC_DDL)


def convert(spark: SparkSession, arc_path: str, warc_path: str, records: int = RECORDS) -> None:
    """ARC files to WARC files. The first pass learns each payload's response from digests alone, the second writes the records.

    Only records whose payload occurs twice or more meet; what a file needs to know is its list of revisits, so no block of
    a payload is shuffled by its digest.
    """
    light = materialize(read_arc(spark, arc_path), "arc-records")
    first = light.groupBy("digest", "size").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    met = join_counted(light, first, ["digest", "size"], light.count())
    target = met.where(F.col("response").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("response"))))
    targets = materialize(target.groupBy("file").agg(F.collect_list(F.struct("at", F.col("response").alias("target"))).alias("targets")), "arc-targets")
    sizes = light.groupBy(_kind("file").alias("kind"), "file").count().groupBy("kind").agg(F.max("count").alias("most"))
    most = {"small": 1} | {r["kind"]: r["most"] for r in sizes.collect()}  # two rows at most
    for kind, n in most.items():
        own = targets.where(_kind("file") == kind)
        write_warc(_files(spark, f"{arc_path}/{kind}").join(own, F.col("path") == F.col("file"), "left"), f"{warc_path}/{kind}", max(2, min(records, n + 1)))


def _kind(file: str):
    """The folder that a file is in."""
    return F.element_at(F.split(file, "/"), -2)


def op5(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
