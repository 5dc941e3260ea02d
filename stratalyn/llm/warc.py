"""WARC archives: write, normalise, index, read back.

Writing gives one gzip stream per partition, all records in it ("monolithic"): fast to write, useless for random access.
The normaliser inflates such a file once, as a stream of bounded pieces, rewrites every record as a gzip member of its
own and writes a sidecar index of (offset, length, record) beside the archive. On the way, records whose payload equals
that of a record with a smaller page_id become revisit records. Reading seeks to single members by the index.

Files lie in the folder that driver and executors share (spark.checkpoint.dir), under names unique to the task attempt;
which names count is kept in checkpointed tables, so lost executors and repeated tasks do no harm. Pages are never
shuffled: only digests and places are.

Defined results: null html is an empty payload and is compared like any other; very long pages are one record, held in
memory one at a time; repeated rows and ties at the smallest page_id are all responses; a null page_id is written as an
empty id, never refers, and is smaller than none; null urls are written as an empty target; other columns are ignored,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalyn.llm.common import cut, delete, join_counted, new_folder

PIECE = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PLACES = "page_id long, file string, ordinal long, digest string, payload_bytes long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None = None) -> bytes:
    """One uncompressed WARC/1.0 record. A revisit has no payload of its own."""
    ident = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{ident}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}", f"WARC-Page-ID: {ident}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Page-ID: {refers_to}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def gzip_member(raw: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Records of a gzip stream (any number of members), inflated once, a record in memory at a time."""
    inflate, buffer, need = zlib.decompressobj(31), bytearray(), None
    for piece in pieces:
        while piece:
            buffer += inflate.decompress(piece, PIECE)
            piece = inflate.unconsumed_tail
            if inflate.eof:
                piece, inflate = inflate.unused_data, zlib.decompressobj(31)
            while True:
                if need is None:
                    end = buffer.find(b"\r\n\r\n")
                    if end < 0:
                        break
                    lengths = [line[15:] for line in bytes(buffer[:end]).split(b"\r\n") if line[:15].lower() == b"content-length:"]
                    need = end + 4 + int(lengths[0]) + 4
                if len(buffer) < need:
                    break
                yield bytes(buffer[:need])
                del buffer[:need]
                need = None
    while not inflate.eof and (more := inflate.decompress(inflate.unconsumed_tail, PIECE)):
        buffer += more
    if buffer:
        raise ValueError("the last record is cut off")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _read_pieces(path: str) -> Iterator[bytes]:
    fs, at = _open(path)
    with fs.open_input_stream(at, compression=None) as f:
        while piece := f.read(PIECE):
            yield piece


def write_monoliths(pages: DataFrame, folder: str) -> DataFrame:
    """One gzip stream of response records a partition; the place of each page (``PLACES``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, ordinal = f"{folder}/raw-{uuid.uuid4().hex}.warc.gz", None, 0
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        fs, at = _open(name)
        for batch in batches:
            rows = []
            if out is None and batch.num_rows:
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(at, compression=None)
            for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                digest = payload_digest(payload)
                out.write(z.compress(record("response", page_id, url, payload, digest, len(payload))))
                rows.append((page_id, name, ordinal, digest, len(payload)))
                ordinal += 1
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["page_id", "file", "ordinal", "digest", "payload_bytes"])
        if out is not None:
            out.write(z.flush())
            out.close()

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("binary")).mapInArrow(run, PLACES)


def first_of_equals(places: DataFrame) -> DataFrame:
    """``places`` with refers_to: the smallest page_id of an equal payload, null for that one itself.

    Only payloads that occur twice are joined back; their minima are aggregated before the shuffle, and those of very
    common payloads are broadcast. ``places`` must be cheap to read again.
    """
    firsts = places.groupBy("digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    both = join_counted(places, firsts, ["digest", "payload_bytes"], "n", places.count(), "left")
    return both.select("file", "ordinal", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def normalise(decided: DataFrame, folder: str, n_files: int) -> DataFrame:
    """Rewrite each file that ``decided`` (file, ordinal, refers_to) names; the index of the new archives.

    A file's decisions arrive in the order of its records and are consumed as the stream is inflated. The number of
    partitions is given: the decisions are a few bytes a record, and by their size alone Spark would join them into
    one task, though the work behind them is the whole archive.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int | None]]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = rows(batches)
        row = next(todo, None)
        while row is not None:
            source, index, offset, ordinal = row[0], [], 0, 0
            name = f"{folder}/norm-{uuid.uuid4().hex}.warc.gz"
            fs, at = _open(name)
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(at, compression=None) as out, fs.open_output_stream(f"{at}.idx", compression=None) as side:
                for raw in records(_read_pieces(source)):
                    if row is None or row[0] != source:
                        raise ValueError(f"{source} has more records than decisions")
                    if row[1] is not None:
                        fields, payload = parse(raw)
                        page = fields["WARC-Page-ID"]
                        raw = record("revisit", int(page) if page else None, fields["WARC-Target-URI"], b"", fields["WARC-Payload-Digest"][5:], int(fields["WARC-Payload-Length"]), row[1])
                    member = gzip_member(raw)
                    out.write(member)
                    side.write(json.dumps({"offset": offset, "length": len(member), "record": ordinal}).encode() + b"\n")
                    index.append((name, offset, len(member)))
                    offset, ordinal, row = offset + len(member), ordinal + 1, next(todo, None)
                    if len(index) >= 8192:
                        yield _index(index)
                        index = []
            yield _index(index)

    def _index(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64()))], ["file", "offset", "length"])

    dealt = decided.repartition(max(1, n_files), "file").sortWithinPartitions("file", "ordinal").select("file", "ordinal", "refers_to")
    return dealt.mapInArrow(run, "file string, offset long, length long")


def read_members(index: DataFrame) -> DataFrame:
    """Seek to every member of the index, inflate it alone and digest its payload again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_name, f = None, None
        for batch in batches:
            rows = []
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if name != open_name:
                    if f:
                        f.close()
                    fs, at = _open(name)
                    open_name, f = name, fs.open_input_file(at)
                f.seek(offset)
                fields, payload = parse(zlib.decompress(f.read(length), 31))
                page, kind = fields["WARC-Page-ID"], fields["WARC-Type"]
                told = fields["WARC-Payload-Digest"][5:], int(fields["WARC-Payload-Length"])
                if kind == "response" and told != (payload_digest(payload), len(payload)):
                    raise ValueError(f"{name} at {offset}: the payload is not what its header says")
                refers = fields.get("WARC-Refers-To-Page-ID")
                rows.append((int(page) if page else None, told[1], told[0], kind, int(refers) if refers else None))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if f:
            f.close()

    return index.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """The columns of op8: write, normalise with an index, read back."""
    folder = new_folder(pages.sparkSession, "warc")
    places = cut(write_monoliths(pages, f"{folder}/raw"))
    files = [r.file for r in places.select("file").distinct().collect()]  # one a partition of pages
    index = cut(normalise(first_of_equals(places), f"{folder}/members", len(files)))
    delete(pages.sparkSession, f"{folder}/raw")  # only now: a repeated task reads its source again
    _sweep(f"{folder}/members", index)
    return read_members(index)


def _sweep(folder: str, index: DataFrame) -> None:
    """Delete archives of task attempts that do not count; one name a file reaches the driver."""
    fs, at = _open(folder)
    kept = {r.file.rsplit("/", 1)[-1] for r in index.select("file").distinct().toLocalIterator()}
    for found in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
        if found.base_name.removesuffix(".idx") not in kept:
            fs.delete_file(found.path)


#: SHA-1 in base32 from hex: each five bytes are eight digits of five bits.
ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex FROM p),
e AS (
  SELECT page_id, payload_bytes, hex,
         list_reduce(list_transform(range(0, 40), lambda i: printf('%04d', CAST(bin(CAST(strpos('0123456789abcdef', hex[i + 1]) - 1 AS BIGINT)) AS BIGINT))), lambda a, b: a || b) AS bits
  FROM d),
f AS (
  SELECT page_id, payload_bytes,
         list_reduce(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT) AS INT)]), lambda a, b: a || b) AS payload_digest
  FROM e),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM g
"""
