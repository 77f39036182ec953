"""WARC archives with a two-level capture index.

Pages become records of compressed archives; a payload that several pages share is written once, by the page of
the largest id, and the others revisit it. A capture's key is its URL with the host reversed, then its page id.
Sorted keys go into compressed blocks (the second level); the first key of each block goes into a directory of
DIRECTORY entries at most (the first level), small enough to hand to every worker. A lookup searches the directory,
reads one block by its range, searches the block, and reads one record by its range.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, slices, stored

DATE = "2024-01-01T00:00:00Z"
BLOCK_LINES, DIRECTORY = 512, 32_768
ARCHIVE_BYTES = 1 << 30
_END = b"\r\n\r\n"


def surt(url: str | None) -> str:
    """A sort key of a URL: its host's labels reversed, then port, path and query; no scheme, no fragment."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return quote(url, safe="/:?&=%,;~@!$'()*+#[]")
    name = ",".join(reversed(host.split(".")))
    return quote(f"{name}{f':{port}' if port else ''}){parts.path or '/'}{'?' + parts.query if parts.query else ''}", safe="/:?&=%,;~@!$'()*+[]")


def sort_key(url: str | None, page_id: int | None) -> str:
    return f"{surt(url)} {'-' * 20 if page_id is None else f'{page_id + (1 << 63):020d}'}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id} {payload_digest}'.encode()).digest()[:16])}>"


def write_record(url: str | None, page_id: int | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a compressed member of an archive."""
    name = digest(payload)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, name)), ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe="/:?&=%,;~@!$'()*+#[]")), ("WARC-Payload-Digest", f"sha1:{name}"), ("X-Payload-Length", str(len(payload))),
        ("X-Page-Id", "-" if page_id is None else str(page_id)), ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, name)), ("X-Refers-To-Page", str(refers_to))]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += payload if refers_to is None else b""
    fields.append(("Content-Length", str(len(block))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + _END) + pack.flush()


def read_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of a compressed record; a revisit's payload is empty."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(_END)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(_END)[2]


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of a whole archive, one member after the other."""
    while data:
        unpack = zlib.decompressobj(31)
        unpack.decompress(data)
        size = len(data) - len(unpack.unused_data)
        yield read_record(data[:size])
        data = data[size:]


class Ranges:
    """Reads byte ranges of files, with a few files open."""

    def __init__(self, most: int = 16):
        self.open: OrderedDict[str, object] = OrderedDict()
        self.most = most

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path not in self.open:
            system, name = pafs.FileSystem.from_uri(path)
            self.open[path] = system.open_input_file(name)
            if len(self.open) > self.most:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(path)
        file = self.open[path]
        file.seek(offset)
        return file.read(length)


def _create(path: str):
    system, name = pafs.FileSystem.from_uri(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    return system.open_output_stream(name, compression=None)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes the records; returns the captures: key, page_id, file, offset, length.

    Of rows whose equal payloads have min_bytes at least, those of the largest id are responses and the others
    revisit them; a null id is smaller than any. Each try of a task writes files of its own, and captures name
    those of tries that ended well.
    """
    plain = pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    plain = plain.withColumn("digest", F.unhex(F.sha1("html")))
    narrow = plain.where(F.octet_length("html") >= min_bytes).select("page_id", "digest")
    keepers = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"))
    # Only narrow rows meet by digest (AQE splits what many copies share); pages move by id and digest, evenly.
    revisits = narrow.distinct().join(keepers, "digest").where(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = revisits.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to").hint("shuffle_hash")
    chosen = plain.join(revisits, plain["page_id"].eqNullSafe(revisits["r_id"]) & (plain["digest"] == revisits["r_digest"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, path, at = None, "", 0
        for part in slices(batches, "html"):
            rows = {k: [] for k in ("key", "page_id", "file", "offset", "length")}
            for page_id, url, html, refers_to in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                if file is None or at > ARCHIVE_BYTES:
                    if file:
                        file.close()
                    path, at = f"{folder}/warc/{uuid.uuid4().hex}.warc.gz", 0
                    file = _create(path)
                member = write_record(url, page_id, html.encode(), refers_to)
                file.write(member)
                for k, v in zip(rows, (sort_key(url, page_id), page_id, path, at, len(member)), strict=True):
                    rows[k].append(v)
                at += len(member)
            yield pa.RecordBatch.from_pydict({"key": pa.array(rows["key"], pa.string()), "page_id": pa.array(rows["page_id"], pa.int64()), "file": pa.array(rows["file"], pa.string()), "offset": pa.array(rows["offset"], pa.int64()), "length": pa.array(rows["length"], pa.int64())})
        if file:
            file.close()

    captures = chosen.select("page_id", "url", "html", "refers_to").mapInArrow(run, "key string, page_id bigint, file string, offset bigint, length bigint")
    return stored(captures, "captures")


Block = tuple[str, int, int]


@dataclass
class CaptureIndex:
    """The top directory: the first key of each block, in order, and where the block lies. Its blocks hold lines of
    captures (depth 0), or of a directory of blocks one level lower."""

    keys: list[bytes]
    blocks: list[Block]
    depth: int = 0

    def block(self, key: bytes) -> int:
        """The first block that may hold lines of a key; -1 before the first."""
        return _begin(self.keys, key)


def _begin(keys: list[bytes], key: bytes) -> int:
    """Where the lines of a key may begin: they can at the end of the block before one that the key is the first of."""
    at = bisect_left(keys, key)
    return max(at - 1, 0) if at < len(keys) and keys[at] == key else at - 1


def write_blocks(rows: DataFrame, total: int, folder: str) -> DataFrame:
    """Sorts rows (key, file, offset, length) over all tasks and writes them as blocks of BLOCK_LINES lines; the same
    columns of the blocks."""
    ordered = rows.repartitionByRange(max(1, total // (8 * BLOCK_LINES)), "key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, at = f"{folder}/index/{uuid.uuid4().hex}.cdx.z", None, 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal file, at
            file = file or _create(path)
            block = zlib.compress("\n".join("\t".join(map(str, x)) for x in held).encode())
            file.write(block)
            at += len(block)
            return pa.RecordBatch.from_pydict({"key": [held[0][0]], "file": [path], "offset": pa.array([at - len(block)], pa.int64()), "length": pa.array([len(block)], pa.int64())})

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("key", "file", "offset", "length")), strict=True):
                held.append(row)
                if len(held) == BLOCK_LINES:
                    yield flush()
                    held.clear()
        if held:
            yield flush()
        if file:
            file.close()

    return stored(ordered.mapInArrow(run, "key string, file string, offset bigint, length bigint"), "blocks")


def build_index(captures: DataFrame, folder: str) -> CaptureIndex:
    """Sorts captures into blocks, then the directory of these into blocks, until the directory on top has DIRECTORY
    entries at most: it travels to every worker."""
    rows, depth = write_blocks(captures.select("key", "file", "offset", "length"), captures.count(), folder), 0
    while (total := rows.count()) > DIRECTORY:
        rows, depth = write_blocks(rows, total, folder), depth + 1
    found = sorted(rows.toArrow().to_pylist(), key=lambda x: (x["key"].encode(), x["file"], x["offset"]))
    return CaptureIndex([x["key"].encode() for x in found], [(x["file"], x["offset"], x["length"]) for x in found], depth)


class Finder:
    """Lines of keys, by binary search in the top directory and then in the blocks below; keeps the last blocks read."""

    def __init__(self, index: CaptureIndex, ranges: Ranges, most: int = 8):
        self.index, self.ranges, self.most = index, ranges, most
        self.held: OrderedDict[Block, tuple[list[bytes], list[Block]]] = OrderedDict()

    def read(self, block: Block) -> tuple[list[bytes], list[Block]]:
        if block not in self.held:
            lines = [x.rsplit("\t", 3) for x in zlib.decompress(self.ranges.read(*block)).decode().split("\n")]
            self.held[block] = [x[0].encode() for x in lines], [(x[1], int(x[2]), int(x[3])) for x in lines]
            if len(self.held) > self.most:
                self.held.popitem(last=False)
        self.held.move_to_end(block)
        return self.held[block]

    def find(self, key: bytes) -> list[Block]:
        return self._in(self.index.keys, self.index.blocks, self.index.depth, key)

    def _in(self, keys: list[bytes], blocks: list[Block], depth: int, key: bytes) -> list[Block]:
        out = []
        for block in blocks[max(_begin(keys, key), 0) : bisect_right(keys, key)]:
            inner = self.read(block)
            out += self._in(*inner, depth - 1, key) if depth else inner[1][bisect_left(inner[0], key) : bisect_right(inner[0], key)]
        return out


def lookup(requests: DataFrame, index: CaptureIndex, id_col: str = "page_id", url_col: str = "url", once: bool = False) -> DataFrame:
    """A row for each request (a URL and a page id) and each of its captures: page_id, payload_bytes,
    payload_digest, record_type, refers_to, payload_ok (a response's bytes have its digest). Requests without captures
    have no row. With `once`, requests of the same key, whose URLs may differ in scheme or fragment, are one request, and
    one without captures is an error."""
    shared = requests.sparkSession.sparkContext.broadcast(index)
    plain = requests.select(requests[id_col].cast("bigint").alias("page_id"), requests[url_col].cast("string").alias("url"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [sort_key(u, i) for i, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "block": pa.array([max(shared.value.block(x.encode()), 0) for x in keys], pa.int64())})

    placed = plain.mapInArrow(place, "key string, block bigint")
    # A few blocks a task: the rows are narrow, but each reads a record.
    # A key asked for again and again is read once: its captures carry the number of requests.
    asked = placed.groupBy("block", "key").agg((F.lit(1) if once else F.count("*")).alias("times")).repartition(max(16, -(-len(index.keys) // 4)), "block").sortWithinPartitions("block", "key")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        finder = Finder(shared.value, ranges)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload_ok")}
                for key, times in zip(part.column("key").to_pylist(), part.column("times").to_pylist(), strict=True):
                    hits = finder.find(key.encode())
                    if once and not hits:
                        raise KeyError(f"no capture of {key!r}")
                    for hit in hits:
                        fields, payload = read_record(ranges.read(*hit))
                        revisit = fields["WARC-Type"] == "revisit"
                        name = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        got = digest(payload)
                        row = (None if fields["X-Page-Id"] == "-" else int(fields["X-Page-Id"]), int(fields["X-Payload-Length"]) if revisit else len(payload), name if revisit else got, fields["WARC-Type"], int(fields["X-Refers-To-Page"]) if revisit else None, revisit or got == name)
                        for column, value in zip(out.values(), row, strict=True):
                            column.extend([value] * times)
                yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)})

    return asked.mapInArrow(fetch, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload_ok boolean")


def archive_and_read_back(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes all pages, indexes them, looks every distinct key up. Null html is an empty payload; a null URL
    has the key "-"; rows that repeat an id and a URL each have a record and a row; an empty table gives none."""
    folder = folder or new_folder(pages.sparkSession, "archive")
    index = build_index(write_archives(pages, folder, min_bytes=min_bytes), folder)
    return lookup(pages.select("page_id", "url"), index, once=True)
