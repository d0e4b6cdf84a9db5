"""WARC archives with a two-level capture index.

Records are gzip members in flat files.  The index holds one line for each capture, sorted by a key that starts
with the reversed host, in compressed blocks of ``BLOCK_LINES`` lines; a sparse directory keeps the first and last
key of each block.  A lookup bisects the parts' bounds, then the directory of a part, then the lines of a block,
and only then reads a byte range of an archive.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.flatfiles import files, open_file, write_bytes
from foldwise.session import scratch_path

BLOCK_LINES = 256
#: Payloads of fewer bytes are stored again rather than revisited.
LEAST_BYTES = 100
#: Bytes of an archive that one lookup task reads in order.
RANGE_BYTES = 8 << 20
READ = 1 << 20
_URN = "urn:page:"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


#: An empty gzip member: it may stand between others, so it can serve the text sink as separator.
SEPARATOR = _member(b"")
_URL = re.compile(r"^\s*(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d+))?([^#]*)", re.S)


def url_key(url: str | None) -> str:
    """Reversed host, then port, path and query; texts that are no URL are their own key, null has the empty key."""
    found = _URL.match(url or "")
    if not found:
        return (url or "").strip()
    host = ",".join(reversed(found[2].lower().rstrip(".").removeprefix("www.").split("."))) if not found[2].startswith("[") else found[2]
    port = "" if found[3] in (None, "", "80", "443") else f":{found[3]}"
    return f"{host}{port}){found[4] or '/'}"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page_id, url, text, digest, first in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "digest", "first"))):
            payload = (text or "").encode("utf-8", "surrogatepass")
            revisit = first is not None and page_id is not None and first != page_id
            head = [
                "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Payload-Digest: sha256:{digest}",
                f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>", f"X-Payload-Length: {len(payload)}",
            ]
            if url is not None:
                # a header value is one line of visible characters; other texts are kept as a JSON string
                head.append(f"WARC-Target-URI: {url}" if url and url.isprintable() and url == url.strip() and url[0] != '"' else f"WARC-Target-URI: {json.dumps(url)}")
            if revisit:
                head += [f"WARC-Refers-To: <{_URN}{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
            body = b"" if revisit else payload
            head.append(f"Content-Length: {len(body)}")
            out.append(_member("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """One record for each row of ``pages`` (page_id, url, html).

    Of rows with equal payloads of at least ``least_bytes`` the one with the smallest page_id is a response and the
    others revisit it.  A null html is an empty payload, a null page_id is always a response.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    shared = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    marked = rows.join(shared.select("digest", "first"), "digest", "left")
    write_bytes(marked.select("page_id", "url", "html", "digest", "first").mapInArrow(_records, "record binary"), "record", SEPARATOR, path)


def _parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return fields, body[: int(fields["Content-Length"])]


def _urn(value: str | None) -> int | None:
    value = (value or "").removeprefix(f"<{_URN}").removesuffix(">")
    return int(value) if value else None


def _members(uri: str) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each member that isn't empty, reading the file in order."""
    with open_file(uri) as source:
        at, pending = 0, b""
        while True:
            packer, parts, used = zlib.decompressobj(31), [], 0
            while not packer.eof:
                if not pending:
                    pending = source.read(READ)
                    if not pending:
                        if parts or used:
                            raise ValueError(f"{uri} ends within a record")
                        return
                parts.append(packer.decompress(pending))
                used += len(pending) - len(packer.unused_data)
                pending = packer.unused_data
            content = b"".join(parts)
            if content:
                yield at, used, content
            at += used


_LINES = "url_key string, page_id bigint, url string, file string, offset bigint, length bigint"


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("url_key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    for batch in batches:
        for uri in batch["path"].to_pylist():
            rows = []
            for offset, length, content in _members(uri):
                fields, _ = _parse(content)
                url = fields.get("WARC-Target-URI")
                url = json.loads(url) if url and url[0] == '"' else url
                rows.append({"url_key": url_key(url), "page_id": _urn(fields["WARC-Record-ID"]), "url": url, "file": uri, "offset": offset, "length": length})
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)


_BLOCKS = "part int, block bigint, first_key string, last_key string, lines binary"


def _compress_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, count, held = TaskContext.get().partitionId(), 0, []
    names = ["part", "block", "first_key", "last_key", "lines"]
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def block(rows: list[tuple]) -> pa.RecordBatch:
        nonlocal count
        values = [part, part << 32 | count, rows[0][0], rows[-1][0], zlib.compress(json.dumps(rows).encode())]
        count += 1
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    for batch in batches:
        held += zip(*(batch[c].to_pylist() for c in ("url_key", "page_id", "file", "offset", "length")))
        while len(held) >= BLOCK_LINES:
            yield block(held[:BLOCK_LINES])
            held = held[BLOCK_LINES:]
    if held:
        yield block(held)


def build_index(spark: SparkSession, archives: str, path: str) -> None:
    """Read the archives and write the index: sorted compressed blocks with their first and last keys."""
    listed = files(spark, archives)
    lines = listed.repartition(max(1, listed.count()), "path").mapInArrow(_captures, _LINES)
    order = ["url_key", "page_id", "file", "offset"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_compress_blocks, _BLOCKS).write.parquet(path)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch["url"].to_pylist()], pa.string())], names=["url_key"])


def _parts_of(bounds: list[tuple[str, str, int]]):
    firsts, lasts, parts = [b[0] for b in bounds], [b[1] for b in bounds], [b[2] for b in bounds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for key in batch["url_key"].to_pylist():
                for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    keys.append(key)
                    found.append(parts[k])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(keys, pa.string())], names=["part", "url_key"])

    return run


def _blocks_of(keys: pd.DataFrame, directory: pd.DataFrame) -> pd.DataFrame:
    directory = directory.sort_values("block")
    firsts, lasts, blocks = (directory[c].tolist() for c in ("first_key", "last_key", "block"))
    out = [
        (blocks[k], key) for key in keys["url_key"] for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))
    ]
    return pd.DataFrame(out, columns=["block", "url_key"])


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures of a key within a block, by bisecting its lines."""
    schema = pa.schema([("url_key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    for batch in batches:
        rows = []
        for keys, packed in zip(batch["keys"].to_pylist(), batch["lines"].to_pylist()):
            lines = json.loads(zlib.decompress(packed))
            firsts = [line[0] for line in lines]
            for key in keys:
                rows += lines[bisect.bisect_left(firsts, key) : bisect.bisect_right(firsts, key)]
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def lookup(spark: SparkSession, index: str, urls: DataFrame) -> DataFrame:
    """The captures (url_key, page_id, file, offset, length) of every distinct URL in ``urls``, found through the index.

    What reaches the driver is one pair of bounds for each part of the index, whose number is that of the shuffle
    partitions it was written with.
    """
    blocks = spark.read.schema(_BLOCKS).parquet(index)
    bounds = blocks.groupBy("part").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).orderBy("part").collect()
    keys = urls.select(F.col("url").cast("string").alias("url")).distinct().mapInArrow(_keys, "url_key string").distinct()
    placed = keys.mapInArrow(_parts_of([(b.low, b.high, b.part) for b in bounds]), "part int, url_key string")
    directory = blocks.select("part", "block", "first_key", "last_key")
    wanted = placed.groupBy("part").cogroup(directory.groupBy("part")).applyInPandas(_blocks_of, "block bigint, url_key string")
    # a block has at most BLOCK_LINES keys, so this list is bounded
    per_block = wanted.groupBy("block").agg(F.collect_list("url_key").alias("keys"))
    return per_block.join(blocks.select("block", "lines"), "block").select("keys", "lines").mapInArrow(
        _in_blocks, "url_key string, page_id bigint, file string, offset bigint, length bigint"
    )


_READ = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _READ.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        source = name = None
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                rows = []
                for uri, offset, length in zip(*(batch[c].slice(a, 128).to_pylist() for c in ("file", "offset", "length"))):
                    if uri != name:
                        if source is not None:
                            source.close()
                        source, name = open_file(uri), uri
                    fields, body = _parse(zlib.decompress(source.read_at(length, offset), 31))
                    kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(fields["X-Payload-Length"])
                    if kind == "response":
                        if hashlib.sha256(body).hexdigest() != stated or len(body) != size:
                            raise ValueError(f"record at {offset} of {uri} doesn't match its digest")
                    url = fields.get("WARC-Target-URI")
                    url = json.loads(url) if url and url[0] == '"' else url
                    rows.append((_urn(fields["WARC-Record-ID"]), url, kind, size, stated, _urn(fields.get("WARC-Refers-To")), body if with_payload and kind == "response" else None))
                columns = list(zip(*rows)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return run


def read_records(captures: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records at the captures' byte ranges, checked against their digests.

    Captures are dealt by file and stretch of ``RANGE_BYTES`` and read in order of offset.
    """
    stretch = F.floor(F.col("offset") / RANGE_BYTES)
    dealt = captures.select("file", "offset", "length").repartition(F.col("file"), stretch).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_reader(with_payload), _READ)


def archive_and_read(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write archives and index of ``pages`` below ``folder``, then look up every URL and read its records.

    One row for each row of ``pages``: page_id, url, payload_bytes, payload_digest, record_type, refers_to.
    Repeated rows with a payload to revisit are all responses if they have the smallest page_id.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    write_archives(pages, f"{folder}/archives")
    build_index(spark, f"{folder}/archives", f"{folder}/index")
    return read_records(lookup(spark, f"{folder}/index", pages)).drop("payload")
