"""WARC archives with a two-level capture index.

Writing: each page becomes one gzip member of a ``.warc.gz`` file. Of records with equal payloads the
one with the smallest id is a ``response``; the others are ``revisit`` records without a payload.

Index: captures are sorted by their reversed-host URL key and stored in compressed blocks of lines;
a sparse directory holds the first key and the place of each block. A look-up searches the directory
for the block, searches the block's lines for the key, and reads only the record's byte range.

Archives are written and range-read through ``pyarrow.fs``, under the folder's full address as Hadoop
names it, so the folder may be in any shared store that both know.
Every attempt of a task writes a file under a name of its own, and only the rows of the attempt that
ended well name it: a lost executor leaves an unused file, never a broken one.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.session import scratch_path, written

BLOCK_LINES = 1_000
FILE_BYTES = 256 * 2**20
# Bytes of records that one task reads back, about.
READ_BYTES = 16 * 2**20
CAPTURE_DATE = "2024-01-01T00:00:00Z"

_RENDERED = "page_id long, url string, digest string, payload_bytes long, record binary"
_CAPTURE = "key string, page_id long, file string, offset long, length long"
_RECORD = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)


def url_key(url: str | None) -> str:
    """Sortable key: host labels reversed, then ``)`` and the path with its query; no fragment.

    ``http://www.a.com/b?c`` gives ``com,a)/b?c``. A null or unparsable URL keeps its text after ``)``.
    Tabs and line breaks are percent-encoded.
    """
    url = (url or "").replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D")
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return ")" + url
    if not host:
        return ")" + url
    host = re.sub(r"^www\d*\.", "", host)
    place = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{place}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, page_id, url, digest: str, size: int, refers_to, payload: bytes) -> bytes:
    """One gzip member. Line breaks inside a URL are percent-encoded, as they would end the header."""
    target = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {target} {digest}')}>",
        f"WARC-Date: {CAPTURE_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is None:
        lines.append("X-No-URI: 1")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    lines.append(f"Content-Length: {len(payload)}")
    head = ("\r\n".join(lines) + "\r\n\r\n").encode()
    return gzip.compress(head + payload + b"\r\n\r\n", 6, mtime=0)


def _parsed(member: bytes) -> tuple:
    """The fields of :data:`_RECORD` from one gzip member; raises if it is not one whole record."""
    raw = gzip.decompress(member)
    head, found, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if version != "WARC/1.1" or not found or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    payload = rest[:size]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and payload_digest(payload) != digest:
        raise ValueError(f"payload of page {fields.get('X-Page-ID')} differs from its digest")
    uri = fields["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    page, first = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    return (
        None if page is None else int(page),
        None if "X-No-URI" in fields else uri,
        int(fields["X-Payload-Length"]),
        digest,
        kind,
        None if first is None else int(first),
        payload if kind == "response" else None,
    )


def full_address(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme: one without names the default store to Hadoop, but the local disk to others."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return re.sub("^file:/(?!/)", "file:///", found)


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write (page_id, url, html) as archives; returns their captures (key, page_id, file, offset, length).

    Payloads below ``min_revisit_bytes`` are always responses. A null html is an empty payload. Rows
    without a page_id are responses and are never referred to; of rows that share the smallest id,
    each is a response. An empty table gives no captures.
    """

    def render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page_id, url, html in zip(frame.page_id, frame.url, frame.html):
                page_id = None if pd.isna(page_id) else int(page_id)
                payload = (html or "").encode()
                digest = payload_digest(payload)
                record = _record("response", page_id, url, digest, len(payload), None, payload)
                out.append((page_id, url, digest, len(payload), record))
            columns = ["page_id", "url", "digest", "payload_bytes", "record"]
            frame = pd.DataFrame(out, columns=columns)
            yield frame.astype({"page_id": "Int64"})

    # Records are compressed before they are shuffled. The smallest ids of payloads that occur twice
    # are found from digests alone; a payload that a third of all pages share is split by the join.
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    rendered = written(base.mapInPandas(render, _RENDERED), "warc-records")
    firsts = (
        rendered.filter((F.col("payload_bytes") >= min_revisit_bytes) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    refers = F.when(
        (F.col("page_id") > F.col("first")) & (F.col("payload_bytes") >= min_revisit_bytes),
        F.col("first"),
    )
    placed = rendered.join(firsts, "digest", "left").withColumn("refers_to", refers).drop("first")
    folder = full_address(pages.sparkSession, scratch_path(pages.sparkSession, "warc"))

    def store(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, path = fs.FileSystem.from_uri(folder)
        stream, name, offset = None, "", 0
        try:
            for frame in frames:
                out = []
                rows = zip(frame.page_id, frame.url, frame.digest, frame.payload_bytes, frame.refers_to, frame.record)
                for page_id, url, digest, size, refers_to, record in rows:
                    page_id = None if pd.isna(page_id) else int(page_id)
                    if not pd.isna(refers_to):
                        record = _record("revisit", page_id, url, digest, size, int(refers_to), b"")
                    if stream is None or offset >= file_bytes:
                        if stream is not None:
                            stream.close()
                        filesystem.create_dir(path, recursive=True)
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        stream = filesystem.open_output_stream(f"{path}/{name}", compression=None)
                    stream.write(record)
                    out.append((url_key(url), page_id, f"{folder}/{name}", offset, len(record)))
                    offset += len(record)
                columns = ["key", "page_id", "file", "offset", "length"]
                yield pd.DataFrame(out, columns=columns).astype({"page_id": "Int64"})
        finally:
            if stream is not None:
                stream.close()

    # Written at once: running it again would write other archives.
    return written(placed.mapInPandas(store, _CAPTURE), "warc-captures")


def build_index(captures: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Blocks of sorted captures: (first_key, last_key, lines, bytes, block), about ``block_lines`` lines
    each; ``bytes`` are those of the records that the block names.

    Keys are cut into ranges by Spark's range partitioning, with the page id as second key, so that
    a URL with any number of captures is spread over blocks.
    """

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, str, int]] = []

        def block(lines: list[tuple[str, str, int]]) -> pd.DataFrame:
            body = zlib.compress("\n".join(f"{k}\t{r}" for k, r, _ in lines).encode(), 6)
            size = sum(n for _, _, n in lines)
            return pd.DataFrame(
                {"first_key": [lines[0][0]], "last_key": [lines[-1][0]], "lines": [len(lines)], "bytes": [size], "block": [body]}
            )

        for frame in frames:
            for key, page_id, file, offset, length in frame.itertuples(index=False):
                page_id = "" if pd.isna(page_id) else int(page_id)
                held.append((key, f"{page_id}\t{file}\t{offset}\t{length}", int(length)))
                if len(held) == block_lines:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    order = ["key", "page_id", "file", "offset"]
    return (
        captures.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInPandas(blocks, "first_key string, last_key string, lines long, bytes long, block binary")
    )


def _lines(block: bytes) -> list[list[str]]:
    return [line.split("\t") for line in zlib.decompress(block).decode().split("\n")]


def _read(frames: Iterator[pd.DataFrame], wanted=None) -> Iterator[pd.DataFrame]:
    """Records of the blocks, by range reads in file order; with ``wanted``, of those keys only."""
    handles: dict[str, object] = {}
    for frame in frames:
        for i, body in enumerate(frame["block"]):
            lines = _lines(body)
            if wanted is not None:
                chosen, keys = [], [line[0] for line in lines]
                for key in wanted(frame, i):
                    chosen += lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
                lines = chosen
            out = []
            for _, _, file, offset, length in sorted(lines, key=lambda x: (x[2], int(x[3]))):
                if file not in handles:
                    if len(handles) >= 64:
                        handles.pop(next(iter(handles))).close()
                    filesystem, path = fs.FileSystem.from_uri(file)
                    handles[file] = filesystem.open_input_file(path)
                out.append(_parsed(handles[file].read_at(int(length), int(offset))))
            columns = [field.split()[0] for field in _RECORD.split(", ")]
            frame_out = pd.DataFrame(out, columns=columns)
            yield frame_out.astype({"page_id": "Int64", "refers_to": "Int64"})
    for handle in handles.values():
        handle.close()


def _spread(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks dealt to as many tasks as their records' bytes ask for; the blocks themselves are small."""
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    return blocks.repartition(max(-(-total // READ_BYTES), 1), key)


def read_archives(index: DataFrame) -> DataFrame:
    """Every record the index names, read back from the archives by byte ranges."""
    return _spread(index, "first_key").select("block").mapInPandas(_read, _RECORD)


def look_up(index: DataFrame, urls: DataFrame, directory_rows: int = 100_000) -> DataFrame:
    """Records of the given ``urls`` (column url): sparse directory, block, line, byte range.

    The directory (one row per block) is searched on every executor, ``directory_rows`` rows at a
    time. A URL that is not archived gives no rows; repeated URLs are looked up once. Records without
    a URL are filed under the empty one, and a null URL asks for these.
    """
    key = F.pandas_udf(lambda urls: urls.map(url_key), T.StringType())
    wanted = urls.select(F.coalesce("url", F.lit("")).alias("url")).distinct()
    wanted = written(wanted.select(key("url").alias("key")).distinct(), "warc-keys")
    blocks = written(index.withColumn("block_id", F.monotonically_increasing_id()), "warc-directory")
    hits = wanted.select("key", F.lit(0).cast("bigint").alias("block_id")).limit(0)
    after = None
    while True:
        rest = blocks
        if after is not None:
            key_at, id_at = F.col("first_key"), F.col("block_id")
            later = (key_at == after[0]) & (id_at > after[1])
            rest = blocks.filter((key_at > after[0]) | later)
        part = rest.select("first_key", "last_key", "block_id").orderBy("first_key", "block_id")
        part = part.limit(directory_rows).collect()
        if not part:
            break
        after = (part[-1].first_key, part[-1].block_id)
        hits = hits.unionByName(wanted.select("key", F.explode(_search(part)("key")).alias("block_id")))
    asked = hits.groupBy("block_id").agg(F.collect_set("key").alias("keys"))
    found = written(blocks.join(asked, "block_id").select("block_id", "bytes", "block", "keys"), "warc-asked")
    return _spread(found, "block_id").select("block", "keys").mapInPandas(lambda frames: _read(frames, lambda f, i: sorted(f["keys"].iloc[i])), _RECORD)


def _search(directory: list):
    """Binary search of keys in a slice of the directory; gives the ids of the blocks that may hold each."""
    places = sorted((p.last_key, p.first_key, p.block_id) for p in directory)
    ends = [p[0] for p in places]

    def blocks_of(keys: pd.Series) -> pd.Series:
        out = []
        for key in keys:
            at, found = bisect.bisect_left(ends, key), []
            while at < len(places) and places[at][1] <= key:
                found.append(places[at][2])
                at += 1
            out.append(found)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(blocks_of, T.ArrayType(T.LongType()))
