"""WARC archives as a data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading: folders, files and their sizes are listed once, and files are packed into
partitions of a target size. Conditions on record_type, record_id, target_uri,
payload_digest, refers_to and content_length are taken over from Spark's filters. A
reader parses a record's header lines first; if they fail a condition, or if the
option payload is false, the block is passed over by its Content-Length and neither
read nor decoded. ``.warc.gz`` files are read member by member, where passing over
still inflates.

Writing: each task writes files of its own, rolled at a size, and the list of files
is put down when all tasks are done, so that what a lost or repeated task left is not
read. The block of a response is an HTTP message whose payload may be stored under
Content-Encoding gzip; digest and length in the header are those of the payload.

Paths have any scheme that pyarrow.fs opens (a plain path is local). Null texts are
empty payloads; a null address is left out; line breaks in header values are
percent-encoded, so a value can't begin a header line of its own.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from io import SEEK_CUR, BufferedReader
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from weftline.llm.runtime import checked_broadcast, kept, small_batches
from weftline.sources.tables import fresh_path

SCHEMA = "record_type string, record_id string, target_uri string, record_date string, payload_digest string, payload_length bigint, refers_to string, content_length bigint, payload binary"

#: Bytes of an archive file after which a task begins another, and of files that are read by one task.
FILE_BYTES, PARTITION_BYTES = 256 << 20, 64 << 20

#: Bytes of payloads in one batch that a reader hands over.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 512

#: What lists a folder's files.
MANIFEST = "_manifest.json"

#: Payloads of fewer bytes are stored again even if they repeat.
LEAST_REVISIT = 100

DATE = "2024-01-01T00:00:00Z"
VERSION = b"WARC/1.1"

#: Names of header fields (fixed values), and this archive's own field for a payload's length.
FIELDS = {"WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Target-URI": "target_uri", "WARC-Date": "record_date", "WARC-Payload-Digest": "payload_digest", "WARC-Refers-To": "refers_to", "Content-Length": "content_length", "X-Payload-Length": "payload_length"}
_BY_NAME = {k.lower().encode(): v for k, v in FIELDS.items()}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _value(v: object) -> str:
    """A header value on one line."""
    s = str(v).strip()
    return "".join(c if c > "\x1f" and c != "\x7f" else quote(c) for c in s)


# ---- records


def head(**fields: object) -> bytes:
    """Header lines of a record, with the empty line behind them."""
    lines = [VERSION, *(f"{name}: {_value(fields[key])}".encode() for name, key in FIELDS.items() if fields.get(key) is not None)]
    if fields.get("record_type") == "revisit":
        lines.append(f"WARC-Profile: {IDENTICAL}".encode())
    lines.append(b"Content-Type: application/http; msgtype=response")
    return b"\r\n".join(lines) + b"\r\n\r\n"


def record(row: dict, gzip_payload: bool) -> Iterator[bytes]:
    """A record's bytes. A revisit has the HTTP header only."""
    payload = row.get("payload") or b""
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8"]
    body = b""
    if row["record_type"] != "revisit":
        body = payload
        if gzip_payload and payload:
            packer = zlib.compressobj(3, zlib.DEFLATED, 31)
            body = packer.compress(payload) + packer.flush()
            http.append(b"Content-Encoding: gzip")
        http.append(b"Content-Length: %d" % len(body))
    message = b"\r\n".join(http) + b"\r\n\r\n"
    yield head(**{k: v for k, v in row.items() if k not in ("payload", "content_length")}, content_length=len(message) + len(body))
    yield message
    yield body
    yield b"\r\n\r\n"


def _header(stream: BufferedReader) -> dict | None:
    """The fields of the next record, None at the end of the file."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record begins with {line[:40]!r}")
    found: dict = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("the file ends within a record's header")
        name, _, value = line.partition(b":")
        if key := _BY_NAME.get(name.strip().lower()):
            found[key] = value.strip().decode("utf-8", "replace")
    found["content_length"] = int(found.get("content_length", 0))
    if "payload_length" in found:
        found["payload_length"] = int(found["payload_length"])
    if str(found.get("payload_digest", "")).startswith("sha256:"):
        found["payload_digest"] = found["payload_digest"].removeprefix("sha256:")
    return found


def payload(block: bytes) -> bytes:
    """What an HTTP message holds, its Content-Encoding undone."""
    top, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return b""
    for line in top.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-encoding" and value.strip().lower() in (b"gzip", b"x-gzip"):
            return zlib.decompress(body, 47)
    return body


class _Skipping:
    """Passes over bytes: by seeking where the file can, else by reading."""

    def __init__(self, file: pa.NativeFile, packed: bool) -> None:
        self.packed = packed
        self.stream = BufferedReader(pa.CompressedInputStream(file, "gzip") if packed else file, 1 << 16)

    def skip(self, n: int) -> None:
        if self.packed:
            while n > 0 and (got := self.stream.read(min(n, 1 << 20))):
                n -= len(got)
        else:
            self.stream.seek(n, SEEK_CUR)


def records(path: str, wanted: list, with_payload: bool) -> Iterator[dict]:
    """Records of one file whose header meets all conditions; blocks of others aren't read."""
    files, name = _place(path)
    with files.open_input_file(name) as file:
        source = _Skipping(file, path.endswith(".gz"))
        while (found := _header(source.stream)) is not None:
            if with_payload and all(c(found) for c in wanted) and found.get("record_type") != "revisit":
                block = source.stream.read(found["content_length"])
                if len(block) < found["content_length"]:
                    raise ValueError(f"{path} ends within a record")
                found["payload"] = payload(block)
                yield found
            else:
                source.skip(found["content_length"])
                if all(c(found) for c in wanted):
                    yield found


# ---- the data source


class Files(InputPartition):
    """Files that one task reads."""

    def __init__(self, paths: list[str]) -> None:
        super().__init__(None)
        self.paths = paths


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class _Is:
    """A condition on a header field that Spark has handed over."""

    def __init__(self, field: str, kind: str, value: object) -> None:
        self.field, self.kind, self.value = field, kind, value

    def __call__(self, found: dict) -> bool:
        got = found.get(self.field)
        if got is None:
            return False
        return {"is": lambda: got == self.value, "in": lambda: got in self.value, "has": lambda: True, "from": lambda: got.startswith(self.value)}[self.kind]()


class WarcReader(DataSourceReader):
    def __init__(self, path: str, options: dict) -> None:
        self.path, self.size = path, int(options.get("partitionBytes", PARTITION_BYTES))
        self.with_payload = str(options.get("payload", "true")).lower() == "true"
        self.wanted: list[_Is] = []

    def pushFilters(self, filters: list) -> Iterator:
        """Keeps conditions on header fields; a reader then decides them before it reads a block."""
        for f in filters:
            field = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = next((k for c, k in ((EqualTo, "is"), (In, "in"), (IsNotNull, "has"), (StringStartsWith, "from")) if isinstance(f, c)), None)
            if field in FIELDS.values() and kind:
                self.wanted.append(_Is(field, kind, set(f.value) if kind == "in" else getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Files in parts of about the target size, largest first; a listed folder has just its files."""
        files, top = _place(self.path)
        info = files.get_file_info(top)
        if info.type == fs.FileType.File:
            found = [(self.path, info.size)]
        else:
            listed = files.get_file_info(f"{top}/{MANIFEST}")
            if listed.type == fs.FileType.File:
                with files.open_input_stream(f"{top}/{MANIFEST}") as f:
                    found = [(f"{self.path}/{n}", size) for n, size in json.loads(f.read())]
            else:
                below = files.get_file_info(fs.FileSelector(top, recursive=True))
                found = [(f"{self.path}{x.path.removeprefix(top)}", x.size) for x in below if x.path.endswith((".warc", ".warc.gz"))]
        parts: list[list[str]] = []
        room = 0
        for path, size in sorted(found, key=lambda x: (-x[1], x[0])):
            if room < size or not parts:
                parts.append([])
                room = max(self.size, size)
            parts[-1].append(path)
            room -= size
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64() if c.endswith("bigint") else pa.binary() if c.endswith("binary") else pa.string() for c in SCHEMA.split(", ")]

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

        rows, held = [], 0
        for path in partition.paths if partition is not None else []:
            for r in records(path, self.wanted, self.with_payload):
                rows.append(r)
                held += len(r.get("payload") or b"")
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        self.gzip_payload = str(options.get("payloadEncoding", "gzip")).lower() == "gzip"
        self.size = int(options.get("fileBytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, top = _place(self.path)
        files.create_dir(top, recursive=True)
        done: list[tuple[str, int]] = []
        out, name, size = None, "", 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        name, size = f"part-{uuid.uuid4().hex}.warc", 0
                        out = files.open_output_stream(f"{top}/{name}")
                    for piece in record(row, self.gzip_payload):
                        out.write(piece)
                        size += len(piece)
                    if size >= self.size:
                        out.close()
                        done.append((name, size))
                        out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append((name, size))
        return Written(done)

    def commit(self, messages: list) -> None:
        files, top = _place(self.path)
        files.create_dir(top, recursive=True)
        before: list = []
        if not self.overwrite and files.get_file_info(f"{top}/{MANIFEST}").type == fs.FileType.File:
            with files.open_input_stream(f"{top}/{MANIFEST}") as f:
                before = json.loads(f.read())
        now = before + [list(x) for m in messages if m is not None for x in m.files]
        with files.open_output_stream(f"{top}/{MANIFEST}") as f:
            f.write(json.dumps(now).encode())

    def abort(self, messages: list) -> None:
        files, top = _place(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else []:
                files.delete_file(f"{top}/{name}")


class Warc(DataSource):
    """``warc``. Options: path; payload (true), partitionBytes; payloadEncoding (gzip, identity), fileBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> WarcReader:
        return WarcReader(self.options["path"].rstrip("/"), self.options)

    def writer(self, schema: object, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"].rstrip("/"), self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    small_batches(spark)
    spark.dataSource.register(Warc)


def read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Records under path. Filters are taken over once for what is loaded, so each set of conditions within a plan needs a read of its own."""
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


# ---- pages


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Adds digest, length, record_type, record_id and refers_to: of equal payloads of ``least`` bytes or more, that of the least page_id is a response and others revisit it.

    pages: page_id, url, payload (binary, not null). Null page_ids come last, then the url
    decides. Rows that are alike in all three are told apart by nothing, so they are
    counted and made again: one response, the others revisits. Decisions rest on values
    only, not on a row's place. Only payloads that repeat are joined; the rows of one
    payload meet in partial aggregates only.
    """
    who = F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("p"), F.col("url").isNull().alias("m"), F.col("url").alias("u"))
    told = pages.withColumns({"digest": F.sha2("payload", 256), "length": F.octet_length("payload").cast("bigint"), "who": who})
    alike = told.where(F.col("length") >= least).groupBy("digest", "who").agg(F.count("*").alias("n"))
    repeats = alike.groupBy("digest").agg(F.sum("n").alias("all"), F.min(F.struct("who", "n")).alias("first")).where("`all` > 1")
    name = F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("first.who.p").cast("string"), F.lit("-")), F.lit(":"), F.col("digest"), F.lit(">"))
    repeats = kept(repeats.select("digest", F.col("first.who").alias("first"), F.col("first.n").alias("alike"), name.alias("response")), "warc-repeats")
    joined = told.join(checked_broadcast(repeats), "digest", "left")
    own = F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(":"), F.uuid(), F.lit(">"))
    columns = [*pages.columns, "digest", "length", "record_type", "record_id", "refers_to"]

    def named(df: DataFrame, again: Column) -> DataFrame:
        kind = {"record_type": F.when(again, "revisit").otherwise("response"), "record_id": F.when(again, own).otherwise(F.coalesce("response", own)), "refers_to": F.when(again, F.col("response"))}
        return df.withColumns(kind).select(*columns)

    mine = F.col("who").eqNullSafe(F.col("first"))
    several = F.coalesce(mine & (F.col("alike") > 1), F.lit(False))
    done = named(joined.where(~several), F.col("response").isNotNull() & ~mine)
    if repeats.where("alike > 1").isEmpty():
        return done
    one = joined.where(several).groupBy("digest").agg(*[F.first(c).alias(c) for c in [*pages.columns, "length", "response", "alike"]])
    each = one.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("alike"))))
    return done.unionByName(named(each, F.col("i") > 1))


def archive(pages: DataFrame, path: str) -> None:
    """A WARC record per page under path. pages: page_id, url, html."""
    register(pages.sparkSession)
    raw = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    told = with_revisits(raw)
    body = F.when(F.col("record_type") == "response", F.col("payload"))
    told.select(
        "record_type", "record_id", F.col("url").alias("target_uri"), F.lit(DATE).alias("record_date"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.col("length").alias("payload_length"), "refers_to", F.lit(None).cast("bigint").alias("content_length"), body.alias("payload"),
    ).write.format("warc").mode("append").option("path", path).save()


def page_of(record_id: Column, kind: str) -> Column:
    """The page_id in a record's id."""
    return F.regexp_extract(record_id, r"^<urn:x-page:(.*):[^:]*>$", 1).try_cast(kind)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back: responses with their payload, revisits by their header."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    archive(pages, path)
    kind = pages.schema["page_id"].dataType.simpleString()
    responses = read(spark, path).where(F.col("record_type") == "response").select(page_of(F.col("record_id"), kind).alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    revisits = read(spark, path, payload=False).where(F.col("record_type") == "revisit").select(page_of(F.col("record_id"), kind).alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", page_of(F.col("refers_to"), kind).alias("refers_to"))
    return responses.unionByName(revisits)


