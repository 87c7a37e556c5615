"""Web archives (WARC 1.1): written with Spark's text writer, read with a Python data source."""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from . import common

END = "\r\n\r\n"  # between header and block, and after each record
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records are read in batches of so many payload bytes; a skipped payload is passed in pieces of SKIP bytes.
BATCH_BYTES, SKIP = 8_000_000, 1_000_000
#: column: header field
FIELDS = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
SCHEMA = "warc_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_bytes long, computed_digest string, payload binary"


def base32(digest: pd.Series) -> pd.Series:
    return digest.map(lambda b: base64.b32encode(b).decode())


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), page_id.cast("string"), F.lit(">"))


def page_of(record: Column) -> Column:
    return F.expr("try_cast(nullif(regexp_extract({0}, '^<urn:x-page:(-?[0-9]+)>$', 1), '') as long)".format("`" + record + "`"))


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Writes a WARC record for each row of `pages` (page_id, url, html), compressed, as many files as Spark makes partitions.

    Of rows with equal payloads of `min_revisit_bytes` or more the largest page_id is a response; the others are revisit
    records without payload that refer to it and carry the length of the payload in an extension field. Only digests
    are exchanged to find equal payloads; the election is salted, so that one payload may be that of most pages.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    prints = common.stored(pages.select("page_id", F.unhex(F.sha1(html)).alias("sha"), F.octet_length(html).alias("bytes")), "payloads")
    large = prints.where(F.col("bytes") >= min_revisit_bytes)
    winners = common.elect(large, ["sha", "bytes"], "page_id")
    revisits = (
        large.withColumn("run", common.run_of("page_id"))
        .join(winners, ["sha", "bytes", "run"])
        .where(F.col("page_id").isNotNull() & (F.col("page_id") != F.col("keep")))
        .select(F.col("page_id").alias("revisit"), F.col("sha").alias("r_sha"), "keep")
        .distinct()
    )
    field = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(field(name, value), F.lit(""))
    rows = pages.select("page_id", F.regexp_replace("url", r"[\r\n]+", "%0D%0A").alias("url"), html.alias("html"), F.unhex(F.sha1(html)).alias("sha"))
    rows = rows.join(revisits, (F.col("page_id") == F.col("revisit")) & (F.col("sha") == F.col("r_sha")), "left").withColumn("digest", F.pandas_udf(base32, "string")("sha"))
    is_revisit = F.col("keep").isNotNull()
    length = F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), field("Content-Length", length), F.lit("\r\n"))
    block = F.concat(http, F.when(is_revisit, F.lit("")).otherwise(F.col("html")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", F.coalesce(record_id(F.col("page_id")), F.lit("<urn:x-page:none>"))),
        field("WARC-Date", F.lit(DATE)),
        optional("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(is_revisit, F.concat(field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", record_id(F.col("keep"))), field("X-Payload-Length", length))).otherwise(F.lit("")),
        field("Content-Type", F.lit("application/http;msgtype=response")),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


class File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class WarcReader(DataSourceReader):
    """One partition for a file. Predicates on the type and on header fields are tested before a payload is touched."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.wanted: dict[str, frozenset] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in FIELDS and isinstance(f, (EqualTo, In)):
                values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.wanted[FIELDS[name]] = self.wanted.get(FIELDS[name], values) & values
            else:
                yield f

    def partitions(self) -> list[File]:
        store, root = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(fs.FileSelector(root, recursive=True))
        base = self.path[: len(self.path) - len(root)]
        names = sorted(x.path for x in info if x.is_file and x.size and x.base_name[0] not in "._")
        return [File(base + x) for x in names]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(partition.path)
        schema = pa.schema([(x.split()[0], {"long": pa.int64(), "binary": pa.binary()}.get(x.split()[1], pa.string())) for x in SCHEMA.split(", ")])
        rows, held = [], 0
        with store.open_input_stream(path, compression=None) as raw:
            stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
            for row in records(stream, self.wanted, self.payload):
                rows.append(row)
                held += len(row["payload"] or b"") + 300
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class _Lines:
    """Lines and blocks of a byte stream."""

    def __init__(self, stream) -> None:
        self.stream, self.left = stream, b""

    def fill(self) -> bool:
        got = self.stream.read(SKIP)
        self.left += got
        return bool(got)

    def until(self, end: bytes) -> bytes | None:
        at = self.left.find(end)
        while at < 0:
            if not self.fill():
                return None
            at = self.left.find(end)
        out, self.left = self.left[:at], self.left[at + len(end) :]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.left and not self.fill():
                raise EOFError("a WARC record ends before its length")
            piece, self.left = self.left[:n], self.left[n:]
            n -= len(piece)
            yield piece


def records(stream, wanted: dict[str, frozenset] | None = None, payload: bool = True) -> Iterator[dict]:
    """The records of a WARC stream as rows of SCHEMA; with header fields in `wanted`, only records with one of the values."""
    source = _Lines(stream)
    while (head := source.until(END.encode())) is not None:
        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
        length = int(header["content-length"])
        if any(header.get(k) not in v for k, v in (wanted or {}).items()):
            for _ in source.pieces(length):
                pass
        else:
            row = {k: header.get(v) for k, v in FIELDS.items()} | {"payload": None, "computed_digest": None}
            if row["warc_type"] == "revisit":
                row["payload_bytes"] = int(header["x-payload-length"]) if "x-payload-length" in header else None
                for _ in source.pieces(length):
                    pass
            else:
                block = b"".join(source.pieces(length))
                body = block.partition(END.encode())[2] if header.get("content-type", "").startswith("application/http") else block
                row |= {"payload_bytes": len(body), "computed_digest": base64.b32encode(hashlib.sha1(body).digest()).decode(), "payload": body if payload else None}
            yield row
        if source.until(END.encode()) is None:
            raise EOFError("a WARC record has no end")


class WarcSource(DataSource):
    """spark.read.format("warc").option("payload", "false").load(uri): files of a folder that Python reads by its URI (file:, hdfs:, s3:).

    Predicates on warc_type, record_id, target_uri, payload_digest and refers_to are pushed down where
    spark.sql.python.filterPushdown.enabled is set. With payload=false the payload column is null; length and digest of
    a response are computed from its bytes all the same. A file cut off within a record raises EOFError.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path if ":/" in path else f"file://{path}")


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: `pages` (page_id, url, html) written as WARC files and read back.

    Null html: an empty payload. Null url: a record without target. Null page_id: a response, whatever its
    payload. Rows that repeat a page_id with the same payload are alike. Other columns are not read. An empty table
    gives an empty result. Raises where the digest of a payload that was read differs from its header.
    """
    spark = pages.sparkSession
    path = common.scratch_path(spark, "warc")
    write_warc(pages, path, min_revisit_bytes)
    digest = F.regexp_replace("payload_digest", "^sha1:", "")
    sound = F.col("computed_digest").isNull() | (F.col("computed_digest") == digest)
    return read_warc(spark, path, payload=False).where(F.col("warc_type").isin("response", "revisit")).select(
        page_of("record_id").alias("page_id"),
        "payload_bytes",
        F.when(sound, digest).otherwise(F.raise_error(F.lit("a payload differs from its digest"))).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        page_of("refers_to").alias("refers_to"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "pages"))
