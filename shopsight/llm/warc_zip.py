"""WARC archives packed in ZIP files: a writer, and a reader by range requests without extraction.

Each task writes one ZIP with two stored members: ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.tsv`` (offset and length of every record). The reader finds the end-of-directory record
(ZIP64 where there is one), walks the central directory, locates the stored members, reads the index, and
hands out ranges of consecutive records; other tasks read those ranges and parse the records. Archives get
fresh names, and only those that a finished task reports are read.

Defined results: a null payload is empty and a null url is left out. Of records with equal payloads of
at least ``least_bytes`` those with the smallest page_id are responses (rows that repeat that id too), the
others revisit it; a null page_id is never the smallest, and if all are null all are responses. An empty
table writes no archive and reads back no row.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.llm import common as C
from shopsight.llm import files

DATA, INDEX = "archive/data.warc.gz", "indexes/index.tsv"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC record; that of a revisit has no payload."""
    body = _HTTP + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>",
            "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields and the payload of one record."""
    head, _, body = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = body[:int(fields["Content-Length"])]
    return fields | {"payload": body.partition(b"\r\n\r\n")[2]}


def gzip_member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def directory(source, size: int) -> dict[str, tuple[int, int]]:
    """Begin and length of the stored members of a ZIP file, from its central directory alone."""
    tail_at = max(0, size - 65_557 - 20)
    tail = source.read_at(size - tail_at, tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    entries, length, begin = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20:at - 16] == b"PK\x06\x07":
        place = struct.unpack_from("<Q", tail, at - 12)[0]
        end = source.read_at(56, place)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of the central directory")
        entries, length, begin = struct.unpack_from("<QQQ", end, 32)
    listing, found, at = source.read_at(length, begin), {}, 0
    for _ in range(entries):
        if listing[at:at + 4] != b"PK\x01\x02":
            raise ValueError("a damaged central directory")
        method = struct.unpack_from("<H", listing, at + 10)[0]
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", listing, at + 20)
        place = struct.unpack_from("<I", listing, at + 42)[0]
        name = listing[at + 46:at + 46 + n_name].decode()
        extra, k = listing[at + 46 + n_name:at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            tag, width = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # 64-bit values stand here in this order, each only if its short field is full
                values = iter(struct.unpack_from(f"<{width // 8}Q", extra, k + 4))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                place = next(values) if place == 0xFFFFFFFF else place
            k += 4 + width
        if method == 0:
            local = source.read_at(30, place)
            if local[:4] != b"PK\x03\x04":
                raise ValueError("a damaged local header")
            found[name] = (place + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
        at += 46 + n_name + n_extra + n_comment
    return found


def write_archives(pages: DataFrame, *, least_bytes: int = 100) -> DataFrame:
    """Write all rows (page_id, url, html); gives one row per archive: path and records."""
    pages = C.query_columns(pages, page_id="long", url="string", html="string").select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html")})
    copies = pages.where(F.col("size") >= least_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    marked = pages.join(copies, "digest", "left").select("page_id", "url", "html", "digest", "size", refers.alias("refers_to"))
    folder = files.new_folder(pages.sparkSession, "warc")

    def write(batches):
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        if head is None:
            return
        uri = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zip"
        fs, path = files.place(uri)
        index, offset = [], 0
        with fs.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            with archive.open(DATA, "w", force_zip64=True) as member:
                while head is not None:
                    for page_id, url, html, digest, size, refers_to in zip(*[c.to_pylist() for c in head.columns]):
                        packed = gzip_member(record(page_id, url, html.encode() if refers_to is None else b"", digest, size, refers_to))
                        member.write(packed)
                        index.append(f"{offset}\t{len(packed)}\n")
                        offset += len(packed)
                    head = next(batches, None)
            archive.writestr(INDEX, "".join(index))
        yield pa.RecordBatch.from_pydict({"path": [uri], "records": pa.array([len(index)], pa.int64())})

    return C.stage(marked.mapInArrow(write, "path string, records long"), "warc-archives")


def read_archives(archives: DataFrame, *, range_bytes: int = 4 << 20) -> DataFrame:
    """The records of all archives (columns path and records), see RECORDS; digests of payloads are checked."""
    def locate(batches):
        for batch in batches:
            for uri in batch["path"].to_pylist():
                fs, path = files.place(uri)
                with fs.open_input_file(path) as source:
                    members = directory(source, source.size())
                    index = source.read_at(members[INDEX][1], members[INDEX][0]).decode()
                ranges, sizes, begin, end = [], [], 0, 0
                for line in index.splitlines():
                    offset, length = map(int, line.split("\t"))
                    if sizes and end - begin >= range_bytes:
                        ranges.append((begin, sizes))
                        begin, sizes = offset, []
                    sizes.append(length)
                    end = offset + length
                if sizes:
                    ranges.append((begin, sizes))
                for first, sizes in ranges:
                    yield pa.RecordBatch.from_pydict({
                        "path": [uri], "begin": pa.array([members[DATA][0] + first], pa.int64()),
                        "sizes": pa.array([sizes], pa.list_(pa.int64()))})

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = files.place(row["path"])
                with fs.open_input_file(path) as source:
                    data = source.read_at(sum(row["sizes"]), row["begin"])
                out, at = [], 0
                for size in row["sizes"]:
                    found = parse(zlib.decompress(data[at:at + size], 31))
                    at += size
                    digest, kind = found["WARC-Payload-Digest"].removeprefix("sha256:"), found["WARC-Type"]
                    if kind == "response" and hashlib.sha256(found["payload"]).hexdigest() != digest:
                        raise ValueError(f"a damaged payload in {row['path']}")
                    page, refers = found.get("X-Page-ID"), found.get("X-Refers-To-Page")
                    out.append((page and int(page), int(found["X-Payload-Length"]), digest, kind, refers and int(refers),
                                found.get("WARC-Target-URI")))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
                yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*out))})

    ranges = archives.select("path").repartition("path").mapInArrow(locate, "path string, begin long, sizes array<long>")
    # the rows are short but the work behind each is not, so the number of tasks follows the records
    tasks = max(1, (archives.agg(F.sum("records")).first()[0] or 0) // 1000)
    return ranges.repartition(tasks, "path", "begin").mapInArrow(read, RECORDS)


ORACLE = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS f FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
    CASE WHEN n >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 100 AND page_id <> f THEN f END AS refers_to FROM m
"""
