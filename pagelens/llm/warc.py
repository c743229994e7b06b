"""WARC archives with a two-level capture index.

Records are written where the rows are, one compressed member a record, so payloads move once (to meet their digest's
first page). The index holds a line for each record, sorted by reversed-host URL key and cut in compressed blocks; a
sparse directory holds the first key of every block. Index files each end with their part of the directory; a list of
the files (MAX_FILES at most) is all that look-ups are given. A look-up finds its file, searches that file's directory,
reads one block, searches that, and reads the record's range of its archive. Many look-ups are dealt out in order of
their keys, so a task reads few blocks, and ranges that lie close are read together.

Defined results: null html is empty; a null URL has the key "-"; a null page_id is written as empty and read as null;
of equal payloads that repeat the smallest page_id each such record is a response; rows that repeat a page are each
written and read; an empty table makes no archive; columns other than page_id, url and html are not read, whatever
their names; one record is held at a time when written, a few megabytes of them (or one) when read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import struct
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import commit_file, drop, filesystem_of, new_folder, save
from .tokens import runs

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Index lines in a block, and records in a range of the index, about.
BLOCK_LINES = 2000
RANGE_LINES = 20_000
#: Index files at most: beyond it their ranges grow.
MAX_FILES = 20_000
#: The end of an index file: where its directory starts, and its length.
_TRAILER = "<qq"
#: Ranges of an archive that are so close are read together, up to so many bytes.
READ_GAP = 64_000
READ_BYTES = 4_000_000
#: Payloads shorter than this are always stored.
LEAST_BYTES = 100


def url_key(url: str | None) -> str:
    """Reversed host, port, then path and query in lower case: pages of a host and its subdomains sort together."""
    if not url:
        return "-"
    m = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)", url)
    if not m:
        return url.lower()
    host, port, rest = m[1].lower().removeprefix("www."), m[2], m[3] or "/"
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + rest.lower()


def _clean(value: str | None) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "" if page_id is None else page_id
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:page:{name}>", "WARC-Date": DATE, "WARC-Target-URI": _clean(url),
        "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response",
        **({"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{'' if refers_to is None else refers_to}>"} if revisit else {}),
        "Content-Length": str(len(block)),
    }
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record headers, HTTP headers (names in lower case) and body of one member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}, body


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def write_archives(pages: DataFrame) -> tuple[str, DataFrame]:
    """Write archives and index; returns the folder's URI and the directory: first_key, first_page, path, offset, length, lines."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = rows.filter(F.octet_length("payload") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    firsts = save(firsts, "firsts")
    # short payloads meet nothing; keys of their own keep the many empty ones apart
    own = F.when(F.octet_length("payload") >= LEAST_BYTES, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    known = rows.withColumn("_key", own).join(firsts.withColumnRenamed("digest", "_key"), "_key", "left").withColumn("revisit", F.coalesce(F.col("page_id") != F.col("first"), F.col("page_id").isNull() & F.col("first").isNotNull()))
    folder = new_folder(spark, "warc")
    filesystem, inner = filesystem_of(folder)
    filesystem.create_dir(inner, recursive=True)
    entry = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, inner = filesystem_of(folder)
        task = TaskContext.get()
        # the name holds the attempt: index lines always mean the file of the attempt that wrote them
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, at = None, 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            lines = []
            for page, url, data, digest, first, revisit in zip(*columns, strict=True):
                if out is None:
                    out = filesystem.open_output_stream(f"{inner}/.{name}", compression=None)
                record = make_record(page, url, data, digest, first, revisit)
                out.write(record)
                lines.append((url_key(url), page, f"{folder}/{name}", at, len(record)))
                at += len(record)
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lines, strict=True), entry, strict=True)], schema=entry)
        if out is not None:
            out.close()
            commit_file(filesystem, f"{inner}/.{name}", f"{inner}/{name}")

    made = known.select("page_id", "url", "payload", "digest", "first", "revisit").mapInArrow(archive, "key string, page_id long, path string, offset long, length long")
    entries = save(made, "captures")
    drop(spark, firsts)
    ranges = min(MAX_FILES, max(spark.sparkContext.defaultParallelism, entries.count() // RANGE_LINES))
    directory = pa.schema([("first_key", pa.string()), ("first_page", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int32())])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, inner = filesystem_of(folder)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}.idx"
        out, at, held, blocks = None, 0, [], []

        def flush() -> None:
            nonlocal out, at, held
            if held:
                if out is None:
                    out = filesystem.open_output_stream(f"{inner}/.{name}", compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                block = packer.compress("".join(json.dumps(x) + "\n" for x in held).encode()) + packer.flush()
                out.write(block)
                blocks.append((*held[0][:2], f"{folder}/{name}", at, len(block), len(held)))
                at, held = at + len(block), []

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(line)
                if len(held) == BLOCK_LINES:
                    flush()
        flush()
        if out is not None:
            own = zlib.compress(json.dumps(blocks).encode(), 6)
            out.write(own + struct.pack(_TRAILER, at, len(own)))
            out.close()
            commit_file(filesystem, f"{inner}/.{name}", f"{inner}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*blocks, strict=True), directory, strict=True)], schema=directory)

    ordered = entries.repartitionByRange(ranges, "key", "page_id", "path", "offset").sortWithinPartitions("key", "page_id", "path", "offset")
    made = save(ordered.mapInArrow(index, "first_key string, first_page long, path string, offset long, length long, lines int"), "directory")
    drop(spark, entries)
    return folder, made


class _Files:
    """A few open files, for range reads."""

    def __init__(self, most: int = 16):
        self._open: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self._most = most

    def read(self, path: str, offset: int, length: int) -> bytes:
        return self._file(path).read_at(length, offset)

    def size(self, path: str) -> int:
        return self._file(path).size()

    def _file(self, path: str) -> pa.NativeFile:
        if path not in self._open:
            if len(self._open) >= self._most:
                self._open.popitem(last=False)[1].close()
            filesystem, inner = filesystem_of(path)
            self._open[path] = filesystem.open_input_file(inner)
        self._open.move_to_end(path)
        return self._open[path]


def read_block(files: _Files, path: str, offset: int, length: int) -> list[list]:
    """Index lines of one block: key, page_id, path, offset, length."""
    return [json.loads(x) for x in zlib.decompress(files.read(path, offset, length), 31).decode().splitlines()]


def describe(fields: dict[str, str], http: dict[str, str], body: bytes) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to; a response's payload is hashed anew."""
    revisit = fields["warc-type"] == "revisit"
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if not revisit and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(http["content-length"])):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    return _page(fields["warc-record-id"]), fields["warc-target-uri"], int(http["content-length"]), digest, fields["warc-type"], _page(fields["warc-refers-to"]) if revisit else None


def read_archives(directory: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record that the index names: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the
    payload (null for revisits) if asked for."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if payloads else [])]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files()
        for batch in batches:
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                lines = sorted(read_block(files, path, offset, length), key=lambda x: x[2:])
                for a, b in runs([x[4] for x in lines], READ_BYTES):
                    rows = []
                    for _, _, where, at, size in lines[a:b]:
                        head, http, body = parse_record(files.read(where, at, size))
                        rows.append((*describe(head, http, body), *([None if head["warc-type"] == "revisit" else body] if payloads else [])))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=schema)

    ranges = max(directory.sparkSession.sparkContext.defaultParallelism, directory.count())
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payloads else "")
    return directory.repartition(ranges).mapInArrow(run, ddl)


def load_directory(directory: DataFrame) -> list[tuple]:
    """The whole sparse directory in order of its keys, for look-ups from one process into an archive of its size."""
    return sorted((r.first_key, r.path, r.offset, r.length) for r in directory.collect())


def look_up(blocks: list[tuple], url: str) -> list[tuple[dict[str, str], dict[str, str], bytes]]:
    """Captures of one URL: binary search in the directory and in each block that may hold the key, then range reads."""
    key, files, found = url_key(url), _Files(), []
    at = max(0, bisect.bisect_left([b[0] for b in blocks], key) - 1)
    while at < len(blocks) and blocks[at][0] <= key:
        lines = read_block(files, *blocks[at][1:])
        keys = [x[0] for x in lines]
        for _, _, path, offset, length in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
            found.append(parse_record(files.read(path, offset, length)))
        at += 1
    return found


def _place(key: str, page: int | None) -> tuple:
    """Order of index lines: by key, then page_id, null first."""
    return key, page is not None, page or 0


class CaptureIndex:
    """Look-ups by key and page_id in a list of index files (first key, first page_id, path)."""

    def __init__(self, index_files: list[tuple[str, int | None, str]], keep: int = 8):
        self._firsts = sorted((_place(key, page), path) for key, page, path in index_files)
        self._files, self._keep = _Files(), keep
        self._directories: OrderedDict[str, list] = OrderedDict()
        self._blocks: OrderedDict[tuple, list] = OrderedDict()

    def _kept(self, cache: OrderedDict, key, make: Callable) -> list:
        if key not in cache:
            if len(cache) >= self._keep:
                cache.popitem(last=False)
            cache[key] = make()
        cache.move_to_end(key)
        return cache[key]

    def _directory(self, path: str) -> list[tuple]:
        """The blocks of one index file: place of the first line, offset, length."""
        size, end = self._files.size(path), struct.calcsize(_TRAILER)
        at, length = struct.unpack(_TRAILER, self._files.read(path, size - end, end))
        return [(_place(key, page), offset, n) for key, page, _, offset, n, _ in json.loads(zlib.decompress(self._files.read(path, at, length)))]

    def lines(self, key: str, page: int | None) -> Iterator[list]:
        """Index lines of a page: binary searches among the files, in a file's directory and in a block."""
        wanted = _place(key, page)
        at = max(0, bisect.bisect_left(self._firsts, wanted, key=lambda x: x[0]) - 1)
        for first, path in self._firsts[at:]:
            if first > wanted:
                return
            blocks = self._kept(self._directories, path, lambda: self._directory(path))  # noqa: B023
            k = max(0, bisect.bisect_left(blocks, wanted, key=lambda x: x[0]) - 1)
            for start, offset, length in blocks[k:]:
                if start > wanted:
                    return
                found = self._kept(self._blocks, (path, offset), lambda: read_block(self._files, path, offset, length))  # noqa: B023
                lo, hi = (side(found, wanted, key=lambda x: _place(*x[:2])) for side in (bisect.bisect_left, bisect.bisect_right))
                yield from found[lo:hi]

    def records(self, lines: list[list]) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
        """The records of some index lines, in the order of the archives; close ranges are read together."""
        lines = sorted(lines, key=lambda x: x[2:])
        a = 0
        while a < len(lines):
            path, begin = lines[a][2:4]
            b, end = a + 1, begin + lines[a][4]
            while b < len(lines) and lines[b][2] == path and lines[b][3] <= end + READ_GAP and lines[b][3] + lines[b][4] - begin <= READ_BYTES:
                end, b = max(end, lines[b][3] + lines[b][4]), b + 1
            data = self._files.read(path, begin, end - begin)
            for _, _, _, offset, length in lines[a:b]:
                yield parse_record(data[offset - begin : offset - begin + length])
            a = b


def fetch(pages: DataFrame, directory: DataFrame) -> DataFrame:
    """The records of the pages (page_id, url), looked up in the index: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to. Rows that repeat a key and page_id are looked up once and give all records of theirs."""
    spark = directory.sparkSession
    listed = directory.groupBy("path").agg(F.min(F.struct("first_key", "first_page")).alias("f")).select("f.first_key", "f.first_page", "path")
    shared = spark.sparkContext.broadcast([tuple(r) for r in listed.collect()])  # MAX_FILES rows at most
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(1).to_pylist()], pa.string()), batch.column(0)], names=["key", "page_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, before = CaptureIndex(shared.value), None
        for batch in batches:
            lines = []
            for wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if wanted != before:  # rows come in order
                    lines += index.lines(*wanted)
                before = wanted
            rows = [describe(*record) for record in index.records(lines)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))

    wanted = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(keys, "key string, page_id long")
    parts = max(spark.sparkContext.defaultParallelism, 2 * len(shared.value))
    return wanted.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages and read each back by a look-up of its URL."""
    _, directory = write_archives(pages)
    return fetch(pages, directory)
