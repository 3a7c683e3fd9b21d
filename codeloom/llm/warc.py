"""WARC archives: a writer of Spark rows and a Python data source.

The reader plans partitions from the files, takes equality predicates on the
record type and on header columns, parses a record's headers first, and skips
the payload of a record that the predicates or the options rule out.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

# Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

PIECE = 1 << 20  # bytes read from a file at once
BATCH_BYTES = 8 << 20  # payload bytes in one emitted batch

SCHEMA = (
    "record_id string, record_type string, date string, target_uri string, payload_digest string, "
    "payload_length long, refers_to string, payload binary"
)
#: Header of each column that can be compared before the payload is touched.
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "date": "warc-date",
    "target_uri": "warc-target-uri",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32: four groups of forty bits, eight digits each."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), DIGITS32, BASE32)


def _one_line(value: Column) -> Column:
    return F.regexp_replace(value, r"[\x00-\x20\x7F]+", "%20")


def record_ids(ids: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), _one_line(ids.cast("string")), F.lit(">"))


def id_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^<urn:page:(.*)>$", 1)


def write_warc(
    pages: DataFrame,
    path: str,
    *,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    least: int = 0,
    date: str = "2000-01-01T00:00:00Z",
    compression: str = "gzip",
    records_per_file: int = 20_000,
) -> None:
    """One record per row under ``path``, through Spark's own text writer, so
    the folder may be in any store that Spark reaches.

    Among rows with equal payloads of at least ``least`` bytes the one with the
    smallest key is a response and the others are revisits of it without a
    payload; shorter payloads are always responses. A null payload is an empty
    one. Rows that share key and payload are all responses. A null key gives a
    record without a page number, which revisits where another row has one; a
    null address leaves out its header. Extra columns are ignored. An empty
    table writes an archive without records.

    Which row comes first is found on (key, digest) alone, and the payloads
    meet the revisits by key, so equal payloads never gather in one task.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    facts = {"__size": F.octet_length("__p").cast("long"), "__digest": base32_sha1(F.col("__p").cast("binary"))}
    narrow = pages.select(F.col(key).alias("__key"), payload.alias("__p")).withColumns(facts).drop("__p")
    same = narrow.where(F.col("__size") >= least)
    first = same.groupBy("__digest", "__size").agg(F.min("__key").alias("__first"), F.count(F.lit(1)).alias("__n"))
    first = first.where("__n > 1 AND __first IS NOT NULL").select(
        F.col("__digest").alias("__d"), F.col("__size").alias("__s"), "__first"
    )
    repeats = (
        same.join(first, (F.col("__digest") == F.col("__d")) & (F.col("__size") == F.col("__s")))
        .where(~F.col("__key").eqNullSafe(F.col("__first")))
        .select(F.col("__key").alias("__r"), F.col("__d"), "__first")
        .distinct()
    )
    own = pages.select(F.col(key).alias("__key"), F.col(url).cast("string").alias("__url"), payload.alias("__p"))
    # a key may repeat with other payloads, so the digest is compared as well
    held = own.withColumns(facts).join(
        repeats, F.col("__key").eqNullSafe(F.col("__r")) & (F.col("__digest") == F.col("__d")), "left"
    )
    again = F.col("__first").isNotNull()

    def header(name: str, value) -> Column:
        value = F.lit(value) if isinstance(value, str) else value
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    block = F.when(again, F.lit(0)).otherwise(F.col("__size") + len(HTTP))
    record = F.concat(
        F.lit(f"{VERSION}\r\n"),
        header("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", F.coalesce(record_ids(F.col("__key")), F.lit("<urn:page:>"))),
        header("WARC-Date", date),
        header("WARC-Target-URI", _one_line(F.col("__url"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "__digest")),
        header("WARC-Payload-Length", F.col("__size").cast("string")),
        header("WARC-Profile", F.when(again, F.lit(REVISIT_PROFILE))),
        header("WARC-Refers-To", record_ids(F.col("__first"))),
        header("Content-Type", "application/http; msgtype=response"),
        header("Content-Length", block.cast("string")),
        F.lit("\r\n"),
        F.when(again, F.lit("")).otherwise(F.concat(F.lit(HTTP), F.col("__p"))),
    )
    writer = held.select(record.alias("value")).write.option("lineSep", END).option("compression", compression)
    writer.option("maxRecordsPerFile", records_per_file).text(path)


class Stream:
    """Buffered reading with search and skip over a plain or packed file."""

    def __init__(self, raw):
        self.raw, self.held, self.at = raw, b"", 0

    def _more(self, size: int = PIECE) -> bool:
        piece = self.raw.read(max(size, PIECE))
        if not piece:
            return False
        self.held, self.at = self.held[self.at :] + piece, 0
        return True

    def block(self) -> bytes | None:
        """Up to the next empty line; None at the end of the file."""
        while (end := self.held.find(b"\r\n\r\n", self.at)) < 0:
            if not self._more():
                if self.held[self.at :].strip():
                    raise ValueError("archive ends within a header")
                return None
        found, self.at = self.held[self.at : end], end + 4
        return found

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if not self._more(n - (len(self.held) - self.at)):
                raise ValueError("archive ends within a record")
        found = self.held[self.at : self.at + n]
        self.at += n
        return found

    def skip(self, n: int) -> None:
        inside = min(n, len(self.held) - self.at)
        self.at, n = self.at + inside, n - inside
        if n and self.raw.seekable():
            self.raw.seek(self.raw.tell() + n)
        while n and not self.raw.seekable():
            piece = self.raw.read(min(n, PIECE))
            if not piece:
                raise ValueError("archive ends within a record")
            n -= len(piece)


def parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record header: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(raw, wanted: list[tuple[str, frozenset]], payloads: bool) -> Iterator[tuple]:
    """Rows of SCHEMA for the records whose headers are wanted."""
    stream = Stream(raw)
    while (head := stream.block()) is not None:
        headers = parsed(head)
        size = int(headers.get("content-length", 0))
        if any(headers.get(name) not in values for name, values in wanted):
            stream.skip(size + 4)
            continue
        payload = None
        if payloads and size:
            payload = stream.take(size)
            if headers.get("content-type", "").startswith("application/http"):
                payload = payload.partition(b"\r\n\r\n")[2]
            stream.skip(4)
        else:
            stream.skip(size + 4)
        length = headers.get("warc-payload-length")
        yield (
            *(headers.get(HEADERS[c]) for c in ("record_id", "record_type", "date", "target_uri", "payload_digest")),
            int(length) if length else None,
            headers.get("warc-refers-to"),
            payload if size and payloads else None,
        )


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payloads = options.get("payloads", "true").lower() == "true"
        self.most = int(options.get("partitionBytes", str(32 << 20)))
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = HEADERS.get(f.attribute[0]) if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name is None:
                yield f  # Spark applies what is not decided by a header
            else:
                self.wanted.append((name, frozenset(f.value if isinstance(f, In) else [f.value])))

    def partitions(self):
        plain = self.path if urlsplit(self.path).scheme else f"file://{self.path}"
        store, base = pafs.FileSystem.from_uri(plain)
        found = store.get_file_info(pafs.FileSelector(base, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
        groups, size = [], 0
        for path, n in files:
            if not groups or size + n > self.most:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += n
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition):
        plain = self.path if urlsplit(self.path).scheme else f"file://{self.path}"
        store, _ = pafs.FileSystem.from_uri(plain)
        kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for path in partition.paths:
            packed = "gzip" if path.endswith(".gz") else None
            opened = store.open_input_stream(path, compression="gzip") if packed else store.open_input_file(path)
            with opened as raw:
                rows, size = [], 0
                for row in records(raw, self.wanted, self.payloads):
                    rows.append(row)
                    size += len(row[-1] or b"") + 200
                    if size > BATCH_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)


class WarcSource(DataSource):
    """``spark.read.format("warc")``; options: path, payloads (true or false),
    partitionBytes (bytes of files in one partition)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))


def read_warc(spark, path: str, payloads: bool = True) -> DataFrame:
    """The records below ``path``; a ``where`` on header columns with = or IN
    is decided in the reader. A record without a payload has a null one."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payloads", str(payloads).lower()).load(path)
