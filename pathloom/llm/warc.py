"""WARC archives: a writer with revisit records and a data source for reading.

Writing. A record per row, as a gzip member of its own. Of rows with equal payloads of at least ``min_bytes``
the one with the largest key holds the payload, the others are revisits that refer to it. Payloads are
never shuffled: digests are, and what a part's rows refer to is laid beside that part. Each task writes one
file under a new name and reports it; only files in the stored manifest belong to the archive.

Reading. ``spark.read.format("warc")``, one partition per file. Filters on header columns are pushed down;
a member's headers are inflated first, and if they are ruled out, or ``payload`` is set to false, the rest
of the member is skipped: members carry their length in the gzip extra field ``sl``, so it is not even
inflated. Members without that field are inflated to find their end, and nothing of them is kept.

Cases. A null payload is an empty one. Null urls have no target header. A null key gives a record id from the
digest and its place; it is never referred to. Rows that share the largest key of their group are all
responses. Control characters in urls are percent-encoded. An empty table gives no files and reads as no
rows. Other columns are not written.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith

from pathloom.llm.scratch import ROW_BITS, Scratch, by_part, file_system, rows_beside, with_row

SCHEMA = (
    "file string, offset long, record_id string, record_type string, target_uri string, date string, "
    "refers_to string, payload_digest string, content_type string, headers map<string,string>, payload binary"
)
# header of each column that filters may be pushed on
HEADERS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH = 8 << 20


# --- records --------------------------------------------------------------------------------


def member(record: bytes, level: int = 4) -> bytes:
    """A gzip member with its own and its content's length in the extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0\0\0\0" + b"\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def page_record(record_id: str, url: str | None, date: str, payload: bytes, sha1: str, refers_to: str | None) -> bytes:
    head = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()))
    if refers_to:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{refers_to}>"), ("X-Payload-Length", str(len(payload)))]
    head.append(("Content-Type", "application/http; msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record_bytes(head, http if refers_to else http + payload)


def page_id_of(column: str):
    """Key in a record id of this writer; null for other ids."""
    return F.nullif(F.regexp_extract(column, r"^urn:page:(-?\d+)$", 1), F.lit("")).cast("long")


def _write(folder: str, beside: str, date: str):
    def records(batch: pa.RecordBatch, known: dict) -> Iterator[bytes]:
        for row, key, url, payload, sha1 in zip(*(batch[c].to_pylist() for c in ("row", "key", "url", "payload", "sha1"))):
            last = known.get(row)
            own = f"urn:page:{key}" if key is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{sha1}/{row}')}"
            refers = f"urn:page:{last}" if last is not None and last != key else None
            yield member(page_record(own, url, date, payload, sha1, refers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, part, known, count, size = None, None, {}, 0, 0
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            if not batch.num_rows:
                continue
            if stream is None:
                system, plain = file_system(folder)
                system.create_dir(plain, recursive=True)
                stream = system.open_output_stream(f"{plain}/{name}", compression=None)
                info = record_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                size += stream.write(data := member(info)) or len(data)
            for of, some in by_part(batch):
                if of != part:
                    found = rows_beside(beside, part := of, ["row", "last"])
                    known = {} if found is None else dict(zip(found["row"].to_pylist(), found["last"].to_pylist()))
                data = b"".join(records(some, known))
                stream.write(data)
                count, size = count + some.num_rows, size + len(data)
        if stream is not None:
            stream.close()
            yield pa.record_batch({"file": [name], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return run


def write_warc(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 1000,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write ``pages`` to ``folder``; the stored manifest. Text payloads are UTF-8."""
    scratch = Scratch(pages.sparkSession, "warc")
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = with_row(pages, [F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload")], scratch)
    rows = rows.withColumn("sha1", F.sha1("payload"))
    digests = rows.where(F.length("payload") >= min_bytes).select("row", "key", F.unhex("sha1").alias("sha1"))
    digests = scratch.put(digests, "digests")
    groups = digests.groupBy("sha1").agg(F.max("key").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null")
    copies = digests.join(groups, "sha1").select(F.shiftright("row", ROW_BITS).cast("int").alias("part"), "row", "last")
    beside = scratch.beside(copies, "copies")
    manifest = rows.mapInArrow(_write(f"{folder}/data", beside, date), "file string, records long, bytes long")
    manifest.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema("file string, records long, bytes long").parquet(f"{folder}/manifest")


# --- reading --------------------------------------------------------------------------------


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """Records of an archive. Conditions on header columns are pushed into the scan."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


class WarcSource(DataSource):
    """WARC files of a folder: those of its manifest, or all ``.warc`` and ``.warc.gz`` files below it."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "WarcReader":
        return WarcReader(self.options["path"], str(self.options.get("payload", "true")).lower() != "false")


class WarcFile(InputPartition):
    pass


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, payload: bool):
        self.folder, self.payload = folder, payload
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Takes what the headers alone decide. Spark checks the rest."""
        for f in filters:
            test = self._test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def _test(self, f: Filter):
        kinds = {EqualTo: "=", EqualNullSafe: "=", In: "in", IsNull: "null", IsNotNull: "some", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has"}
        if type(f) not in kinds or len(f.attribute) != 1 or f.attribute[0] not in HEADERS:
            return None
        value = getattr(f, "value", None)
        if type(f) in (EqualTo, EqualNullSafe) and value is None:
            return None
        return f.attribute[0], kinds[type(f)], tuple(value) if isinstance(value, (list, tuple)) else value

    def partitions(self) -> list[InputPartition]:
        system, plain = file_system(self.folder)
        if system.get_file_info(f"{plain}/manifest").type == fs.FileType.Directory:
            table = ds.dataset(f"{plain}/manifest", filesystem=system, format="parquet", exclude_invalid_files=True).to_table()
            files = [f"{plain}/data/{f}" for f in table["file"].to_pylist()] if table.num_rows else []
        else:
            listed = system.get_file_info(fs.FileSelector(plain, recursive=True))
            files = [i.path for i in listed if i.path.endswith((".warc", ".warc.gz"))]
        return [WarcFile(f) for f in sorted(files)] or [WarcFile(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        system, _ = file_system(self.folder)
        with system.open_input_file(partition.value) as source:
            rows, held = [], 0
            for offset, head, payload in read_records(source, self._wanted, self.payload):
                rows.append(_row(partition.value, offset, head, payload))
                held += len(payload or b"") + 500
                if held >= BATCH:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    def _wanted(self, head: dict[str, str]) -> bool:
        return all(_holds(_column(head, c), kind, value) for c, kind, value in self.tests)


def _holds(found: str | None, kind: str, value) -> bool:
    if kind == "null":
        return found is None
    if found is None:
        return False
    return {
        "some": lambda: True, "=": lambda: found == value, "in": lambda: found in value, "starts": lambda: found.startswith(value),
        "ends": lambda: found.endswith(value), "has": lambda: value in found,
    }[kind]()


def _column(head: dict[str, str], column: str) -> str | None:
    value = head.get(HEADERS[column])
    if value is not None and column in ("record_id", "refers_to"):
        return value.strip("<>")
    if value is not None and column == "payload_digest" and value.startswith("sha1:"):
        return base64.b32decode(value[5:]).hex()
    return value


def _row(file: str, offset: int, head: dict[str, str], payload: bytes | None) -> tuple:
    return (file, offset, *(_column(head, c) for c in HEADERS), list(head.items()), payload)


_ARROW = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), *((c, pa.string()) for c in HEADERS),
    ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [*_ARROW.names[:2], *HEADERS, "headers", "payload"]
    columns = dict(zip(names, zip(*rows)))
    arrays = [pa.array(columns[f.name], f.type) for f in _SPARK_ORDER]
    return pa.RecordBatch.from_arrays(arrays, schema=_SPARK_ORDER)


_SPARK_ORDER = pa.schema([_ARROW.field(c.split()[0]) for c in SCHEMA.replace("map<string,string>", "map").split(", ")])


def parse_headers(raw: bytes) -> dict[str, str]:
    """Named fields of a header block, names in lower case. Folded lines are joined; the first of equal names counts."""
    out: dict[str, str] = {}
    lines = re.sub(r"\r?\n[ \t]+", " ", raw.decode("utf-8", "replace")).split("\n")
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def read_records(source, wanted, with_payload: bool) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    """Offset, headers and payload of each record whose headers pass ``wanted``."""
    size, at = source.size(), 0
    while at < size:
        source.seek(at)
        magic = source.read(2)
        step = _member if magic == b"\x1f\x8b" else _plain
        end, head, payload = step(source, at, size, wanted, with_payload)
        if head is not None:
            yield at, head, payload
        if end <= at:
            raise ValueError(f"no record at {at}")
        at = end


def _payload(head: dict[str, str], block: bytes) -> bytes:
    """Body of an HTTP message, or the block itself."""
    if head.get("content-type", "").startswith("application/http"):
        _, blank, body = block.partition(b"\r\n\r\n")
        return body if blank else b""
    return block


def _plain(source, at: int, size: int, wanted, with_payload: bool):
    raw = b""
    while b"\r\n\r\n" not in raw:
        source.seek(at + len(raw))
        more = source.read(4096)
        if not more:
            return size, None, None
        raw += more
    begin = raw.index(b"\r\n\r\n") + 4
    head = parse_headers(raw[:begin])
    length = int(head.get("content-length", 0))
    end = min(size, at + begin + length + 4)
    if not wanted(head):
        return end, None, None
    if not with_payload:
        return end, head, None
    source.seek(at + begin)
    return end, head, _payload(head, source.read(length))


def _skip_length(head: bytes) -> int | None:
    """Length of the member, from the extra field of its gzip header."""
    if not head[3] & 4:
        return None
    extra = head[12 : 12 + struct.unpack("<H", head[10:12])[0]]
    while len(extra) >= 4:
        n = struct.unpack("<H", extra[2:4])[0]
        if extra[:2] == b"sl" and n == 8:
            return struct.unpack("<I", extra[4:8])[0] or None
        extra = extra[4 + n :]
    return None


def _member(source, at: int, size: int, wanted, with_payload: bool):
    source.seek(at)
    raw = source.read(min(4096, size - at))
    known = _skip_length(raw)
    unpack = zlib.decompressobj(31)
    text, place = unpack.decompress(raw), at + len(raw)
    while b"\r\n\r\n" not in text and not unpack.eof and place < size:
        source.seek(place)
        raw = source.read(4096)
        place += len(raw)
        text += unpack.decompress(raw)
    begin = text.find(b"\r\n\r\n") + 4
    head = parse_headers(text[:begin]) if begin > 3 else {}
    good = bool(head) and wanted(head)
    keep = good and with_payload
    if not keep and known:
        return at + known, head if good else None, None
    parts = [text] if keep else []
    while not unpack.eof and place < size:
        source.seek(place)
        raw = source.read(1 << 16)
        place += len(raw)
        more = unpack.decompress(raw)
        if keep:
            parts.append(more)
    end = place - len(unpack.unused_data)
    if not good:
        return end, None, None
    if not keep:
        return end, head, None
    block = b"".join(parts)[begin : begin + int(head.get("content-length", 0))]
    return end, head, _payload(head, block)
