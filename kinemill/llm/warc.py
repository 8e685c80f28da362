r"""WARC archives with an externally merged index.

Every page becomes a WARC 1.1 record: a response with its payload, or a revisit of the response with the smallest
page_id among equal payloads of at least ``least_bytes`` bytes. Each record is a gzip member of its own, so an index
entry's ``offset`` is where a reader can seek to. Members are written by Spark's text sink to any file system that
Spark reaches; its line separator is an empty gzip member, so an archive is a valid sequence of members. A task begins
a new archive after ``archive_bytes`` bytes. Reading takes the members one by one, checks the digests, and yields one
locally sorted run of index entries an archive.

The runs are written to the shared folder and merged externally: ranges of (URL key, time, page) hold at most about
``range_rows`` entries, whatever the size of the index; in each range Spark's sort brings the runs' slices one after
another, and a loser tree merges them, so the index is in one global order.

Defined cases: a null payload is empty; a null or empty URL is ``about:blank``; a null page_id never is the smallest;
rows that share the smallest page_id are all responses; repeated rows are records of their own; a very long payload is
one member; page ids are whole numbers; an empty table gives an empty index; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, small

CRLF = "\r\n"
ID = "urn:kinemill:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIRST_DAY = 1704067200  # 2024-01-01


def _lines(*fields: tuple[str, Column]) -> Column:
    return F.concat(*[x for name, value in fields for x in (F.lit(f"{name}: "), value, F.lit(CRLF))])


def records(pages: DataFrame, least_bytes: int = 100, time: Column | None = None) -> DataFrame:
    """One WARC record a page as text, without the two line ends that close it."""
    page, payload = F.col("page_id"), F.col("__payload")
    time = F.timestamp_seconds(F.lit(_FIRST_DAY) + F.coalesce(F.pmod(page, F.lit(1 << 31)), F.lit(0))) if time is None else time
    time = F.to_utc_timestamp(time, F.current_timezone())  # what date_format() shows is UTC in any session
    uri = F.regexp_replace(F.regexp_replace(F.coalesce(F.when(F.col("url") != "", F.col("url")), F.lit("about:blank")), "[\\r\\n]", "%0A"), "[\\x00-\\x20]", "%20")
    base = pages.select(page, F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("__date"), uri.alias("__uri"), F.coalesce(F.col("html"), F.lit("")).alias("__payload"))
    base = base.withColumn("__size", F.octet_length("__payload")).withColumn("__sha", F.sha2("__payload", 256))
    # Only payloads that occur more than once take part in the join; counts and minima combine before the shuffle.
    repeated = base.where(F.col("__size") >= least_bytes).groupBy("__sha").agg(F.min("page_id").alias("__first"), F.count("*").alias("__n")).where("__n > 1").select("__sha", "__first")
    joined = base.join(repeated, "__sha", "left").withColumn("__again", F.col("__first").isNotNull() & ~F.col("__first").eqNullSafe(page))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}"), _lines(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("__size").cast("string"))), F.lit(CRLF))
    name = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    block = F.when(F.col("__again"), http).otherwise(F.concat(http, payload))
    common = [("WARC-Target-URI", F.col("__uri")), ("WARC-Date", F.col("__date")), ("WARC-Record-ID", name(page)), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("__sha")))]
    last = [("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(F.col("__block")).cast("string"))]
    head = F.when(F.col("__again"), _lines(("WARC-Type", F.lit("revisit")), *common, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", name(F.col("__first"))), *last)).otherwise(_lines(("WARC-Type", F.lit("response")), *common, *last))
    return joined.withColumn("__block", block).select(F.concat(F.lit(f"WARC/1.1{CRLF}"), head, F.lit(CRLF), F.col("__block")).alias("value"))


#: A gzip member without content: ten octets of header, an empty block, check and size.
EMPTY_MEMBER = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0]) + bytes(8)


def write_archives(pages: DataFrame, path: str, archive_bytes: int = 1 << 26, **options) -> None:
    """Archives of gzip members in the folder ``path``; ``archive_bytes`` bounds one but for its last record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        volume = size = 0
        for batch in small(batches, 200):
            members, volumes = [], []
            for text in batch.column("value").to_pylist():
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                members.append(pack.compress(f"{text}{CRLF}{CRLF}".encode()) + pack.flush())
                volumes.append(volume)
                size += len(members[-1])
                if size >= archive_bytes:
                    volume, size = volume + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary()), pa.array(volumes, pa.int32())], ["value", "volume"])

    packed = records(pages, **options).mapInArrow(run, "value binary, volume int").select(F.col("value").cast("string"), "volume")
    packed.write.partitionBy("volume").option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


@lru_cache(maxsize=65536)
def url_key(url: str) -> str:
    """Sort-friendly key: host parts from the right, then the path and the sorted query; no scheme, port or fragment."""
    try:
        parts = urlsplit(url.lower())
        host = parts.hostname or ""
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return ",".join(reversed(host.removeprefix("www.").split("."))) + ")" + (parts.path.rstrip("/") or "/") + (f"?{query}" if query else "")


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse_record(text: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    end = text.find(b"\r\n\r\n")
    if end < 0 or not text.startswith(b"WARC/"):
        raise ValueError("no record here")
    fields = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(text[: end + 2])}
    start = end + 4
    if text[start + int(fields["content-length"]) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, text[start:-4]


def record_at(data: bytes | memoryview, offset: int) -> tuple[bytes, int]:
    """Content of the gzip member at ``offset`` of an archive, and where the next member begins."""
    stream = zlib.decompressobj(31)
    parts, at = [], offset
    while not stream.eof:
        if at >= len(data):
            raise ValueError("the archive ends within a record")
        parts.append(stream.decompress(data[at : at + (1 << 16)]))
        at += 1 << 16
    return b"".join(parts), min(at, len(data)) - len(stream.unused_data)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Header fields, block and offset of each record of an archive; members without content are passed over."""
    at, view = 0, memoryview(data)
    while at < len(data):
        text, following = record_at(view, at)
        if text:
            yield *parse_record(text), at
        at = following


_INDEX = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, capture_time string, archive string, offset long"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
_NAMES = [c.split()[0] for c in _INDEX.split(", ")]


def _page(name: str | None) -> int | None:
    key = (name or "").strip("<>").removeprefix(ID)
    return None if key in ("", "none") else int(key)


def _order(row: tuple) -> tuple:
    """(URL key, time, page); a null page before all others."""
    return row[5], row[6], row[0] is not None, row[0] or 0, row[7], row[8]


def _batches(rows: Iterable[tuple], names: list[str], types: list[pa.DataType], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names)


def index_runs(spark: SparkSession, path: str) -> DataFrame:
    """The entries of each archive, sorted: one run an archive. Digests of stored payloads are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, archive = [], "/".join(name.as_py().rsplit("/", 2)[-2:])
                for fields, block, place in parse_archive(content.as_py()):
                    split = block.index(b"\r\n\r\n") + 4
                    size = int(dict(_FIELD.findall(block[:split]))[b"Content-Length"])
                    digest, payload = fields["warc-payload-digest"].removeprefix("sha256:"), block[split:]
                    if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"record {fields['warc-record-id']} isn't what was written")
                    rows.append((_page(fields["warc-record-id"]), size, digest, fields["warc-type"], _page(fields.get("warc-refers-to")), url_key(fields["warc-target-uri"]), fields["warc-date"], archive, place))
                yield from _batches(sorted(rows, key=_order), _NAMES, _TYPES)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, _INDEX)


class LoserTree:
    """K-way merge: each inner node keeps the loser of its match, so a step replays one path from leaf to root."""

    def __init__(self, runs: list[Iterable[tuple]], key):
        self.runs, self.key = [iter(r) for r in runs], key
        k = max(1, len(self.runs))
        self.heads: list[tuple | None] = [None] * k
        self.keys: list[tuple] = [(1,)] * k
        for i in range(len(self.runs)):
            self._pull(i)
        self.losers = [0] * k
        winners = [0] * (2 * k)
        winners[k:] = range(k)
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def _pull(self, i: int) -> None:
        self.heads[i] = next(self.runs[i], None)
        self.keys[i] = (1,) if self.heads[i] is None else (0, self.key(self.heads[i]))

    def _before(self, a: int, b: int) -> bool:
        return (self.keys[a], a) <= (self.keys[b], b)

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.heads)
        while (row := self.heads[self.winner]) is not None:
            yield row
            i = self.winner
            self._pull(i)
            node = (i + k) // 2
            while node:
                if self._before(self.losers[node], i):
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.winner = i


def merge_runs(runs: DataFrame, range_rows: int = 100_000) -> DataFrame:
    """All entries, with ``position``: ascending in the global order by URL key, time and page.

    Ranges are cut by the whole key, so captures of one URL may lie in several of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own.setdefault(row[7], []).append(row)  # a run's rows come in its order
        base = TaskContext.get().partitionId() << 32
        merged = LoserTree(list(own.values()), _order)
        yield from _batches(((*row, base + i) for i, row in enumerate(merged)), [*_NAMES, "position"], [*_TYPES, pa.int64()])

    n = max(shuffle_partitions(runs.sparkSession), -(-runs.count() // range_rows))
    order = ["url_key", "capture_time", "page_id", "archive", "offset"]
    return runs.select(*_NAMES).repartitionByRange(n, *order).sortWithinPartitions("archive", *order).mapInArrow(run, f"{_INDEX}, position long")


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write the archives under ``path``, read them back, and merge their index."""
    spark = pages.sparkSession
    write_archives(pages, f"{path}/archives")
    index_runs(spark, f"{path}/archives").write.parquet(f"{path}/runs")
    return merge_runs(spark.read.schema(_INDEX).parquet(f"{path}/runs"))
