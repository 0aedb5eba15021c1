"""WARC archives: a writer, and a reader that splits files at gzip members.

The writer puts one record, a gzip member of its own, for each row. Equal
payloads of at least `revisit_from` bytes are stored once: the row with the
largest id is the response, the others are revisits that name it.

The reader deals out byte ranges. A task scans its range for the gzip magic;
a candidate counts as a member if it inflates to a WARC header block and,
where its range begins before it, the bytes behind the member again begin
one or end the file. A task owns the records that start inside its range and
reads the last one to its end, wherever that lies.

Files are reached by their URI through pyarrow's file systems. A task writes to
a name of its own attempt and reports it in its result; only the files named
there count, so a lost or repeated task leaves nothing behind that is read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, new_path, stored

MAGIC = b"\x1f\x8b\x08"
STEP = 1 << 20
HOT = 1000  # payloads whose copies are told from a table that every task gets
MOST_TASKS = 1 << 16  # reading tasks; of more ranges a task takes several
URN = "urn:sitespan:page:"
DATE = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing -----------------------------------------------------------------


def record(kind: str, page_id, url: str | None, payload: bytes, sha: str, size: int, refers_to=None) -> bytes:
    """One record, uncompressed. A revisit holds the HTTP header alone and the full payload's digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_warc(
    df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 0, level: int = 3, file_bytes: int = 1 << 30
) -> DataFrame:
    """Write df's rows as records under `folder` (a URI that driver and executors share); the list of files: path, bytes, records.

    Null payloads are empty. Rows with a null id are always responses. Among
    rows that repeat an id with equal payloads every one of the largest id is a
    response.
    """
    spark = df.sparkSession
    p = df.select(
        df[id_col].cast("long").alias("id"), df[url_col].cast("string").alias("url"),
        F.coalesce(df[payload_col].cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("size", F.length("payload"))
    # one thin row for each payload that occurs twice or more; copies are counted before they are moved
    top = stored(p.filter((F.col("size") >= revisit_from) & F.col("id").isNotNull()).groupBy("sha", "size").agg(F.max("id").alias("top"), F.count("*").alias("n")).filter("n > 1"), "warc-copies")
    # the most frequent payloads are known to every task, whose copies lose their payload before anything moves;
    # of the others none has more than 1 / HOT of the rows, and they are streamed past thin rows instead of being sorted
    hot = top.orderBy(F.desc("n"), "sha", "size").limit(HOT).select(F.col("sha").alias("k"), F.col("size").alias("ks"), F.col("top").alias("hot"))
    p = p.join(F.broadcast(hot), (F.col("sha") == F.col("k")) & (F.col("size") == F.col("ks")), "left").drop("k", "ks")
    p = p.withColumn("payload", F.when(F.coalesce(F.col("id") < F.col("hot"), F.lit(False)), F.lit(None)).otherwise(F.col("payload")))
    p = p.withColumn("key", F.when(F.col("hot").isNull(), F.col("sha")).otherwise(F.unhex(F.sha1(F.concat(F.lit("hot "), F.col("id").cast("string"))))))
    rest = top.select(F.col("sha").alias("k"), F.col("size").alias("ks"), "top").hint("shuffle_hash")
    joined = p.join(rest, (F.col("key") == F.col("k")) & (F.col("size") == F.col("ks")), "left")
    known = F.coalesce("hot", "top")
    ref = F.when(F.col("id") < known, known)
    rows = joined.select("id", "url", F.when(ref.isNull(), F.col("payload")).alias("payload"), "sha", "size", ref.alias("refers_to"))
    shape = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("warc")
        fs, root = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        names = (f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}-{k:04d}.warc.gz" for k in range(10**6))
        made, out = [], None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for key, url, payload, sha, size, refers_to in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        path, n, count = next(names), 0, 0
                        out = fs.open_output_stream(path, compression=None)
                    data = member(record("revisit" if refers_to is not None else "response", key, url, payload or b"", base64.b32encode(sha).decode(), size, refers_to), level)
                    out.write(data)
                    n += len(data)
                    count += 1
                    if n >= file_bytes:
                        out.close()
                        made.append((path, n, count))
                        out = None
        if out is not None:
            out.close()
            made.append((path, n, count))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], schema=shape)

    files = rows.mapInArrow(run, "path string, bytes long, records long")
    return stored(files, "warc-files").withColumn("folder", F.lit(folder))


# --- reading -----------------------------------------------------------------


class Window:
    """A file's bytes from an offset on, fetched in steps; what lies behind is let go a step at a time."""

    def __init__(self, f: pa.NativeFile, start: int, size: int) -> None:
        self.f, self.base, self.size, self.data, self.pos = f, start, size, bytearray(), 0

    @property
    def at(self) -> int:
        """The offset in the file."""
        return self.base + self.pos

    def left(self) -> int:
        return len(self.data) - self.pos

    def more(self) -> bool:
        """Fetches a step; what counts from `pos` stays as it is."""
        end = self.base + len(self.data)
        if end >= self.size:
            return False
        if self.pos >= STEP:
            del self.data[: self.pos]
            self.base += self.pos
            self.pos = 0
        self.data += self.f.read_at(min(STEP, self.size - end), end)
        return True

    def bytes(self, k: int, n: int) -> bytes:
        return bytes(memoryview(self.data)[self.pos + k : self.pos + k + n])

    def seek(self, mark: bytes) -> bool:
        """Goes to the next mark; false, at the end of what was fetched, if there is none there."""
        k = self.data.find(mark, self.pos)
        self.pos = k if k >= 0 else max(self.pos, len(self.data) - len(mark) + 1)
        return k >= 0


def parsed_head(data: bytes) -> tuple[dict[str, str], int] | None:
    """The named fields of a WARC header block and where the block begins; None if there is no whole valid one."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        return None
    fields = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    if "warc-type" not in fields or "warc-record-id" not in fields or not fields.get("content-length", "").isdigit():
        return None
    return fields, end + 4


def inflated(w: Window) -> tuple[bytes, int] | None:
    """The member at the window's place and its length; None if it is not a whole record's member."""
    z = zlib.decompressobj(31)
    out, n, step, checked = bytearray(), 0, 1 << 12, False
    try:
        while not z.eof:
            if n >= w.left() and not w.more():
                return None
            part = w.bytes(n, step)
            out += z.decompress(part)
            n += len(part) - len(z.unused_data)
            step = min(4 * step, STEP)
            if not checked:
                if out[:7] != b"WARC/1."[: len(out)]:
                    return None
                if (end := out.find(b"\r\n\r\n")) >= 0:
                    if parsed_head(bytes(out[: end + 4])) is None:
                        return None
                    checked = True
    except zlib.error:
        return None
    return (bytes(out), n) if checked else None


def members(w: Window, end: int, first: bool) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record that begins before `end`. `first`: the window begins the file.

    A record cut off by the file's end is none.
    """
    sure = first
    while w.at < end:
        while not w.seek(MAGIC):
            if w.at >= end or not w.more():
                return
        if w.at >= end:
            return
        found = inflated(w)
        if found and not sure:  # in the midst of a file: the neighbour has to be one, too
            while w.left() < found[1] + 3 and w.more():
                pass
            if w.left() > found[1] and w.bytes(found[1], 3) != MAGIC:
                found = None
        head = found and parsed_head(found[0])
        if not head:
            w.pos += 1
            continue
        sure = True
        fields, begin = head
        yield w.at, fields, found[0][begin : begin + int(fields["content-length"])]
        w.pos += found[1]


def read_warc(files: DataFrame, split_bytes: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """The records of gzip WARC files, read in byte ranges of `split_bytes`.

    `files` has path and bytes (paths as pyarrow's file system has them) and
    folder (a URI of the same file system). Columns: path, offset, warc_type,
    record_id, target_uri, refers_to, payload_digest, payload_length,
    http_header, payload. A revisit's digest and length are those that it
    states of the full payload; a response's are taken from what was read.
    `with_payload` false leaves the payload out. No files: no rows; a record
    that the file's end cuts off: none.
    """
    ranges = files.select("folder", "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    fields = [
        pa.field("path", pa.string()), pa.field("offset", pa.int64()), pa.field("warc_type", pa.string()), pa.field("record_id", pa.string()), pa.field("target_uri", pa.string()),
        pa.field("refers_to", pa.string()), pa.field("payload_digest", pa.string()), pa.field("payload_length", pa.int64()), pa.field("http_header", pa.binary()), pa.field("payload", pa.binary()),
    ]
    shape = pa.schema(fields)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("warc")
        rows, held = [], 0
        for batch in batches:
            for folder, path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, _ = pafs.FileSystem.from_uri(folder)
                with fs.open_input_file(path) as f:
                    for at, head, block in members(Window(f, start, size), min(size, start + split_bytes), start == 0):
                        cut = block.find(b"\r\n\r\n") + 4 if head["warc-type"] in ("response", "revisit") and block.startswith(b"HTTP/") else 0
                        if head["warc-type"] == "revisit":
                            sha, length = head.get("warc-payload-digest", "").removeprefix("sha1:"), head.get("x-payload-length", "")
                            length = int(length) if length.isdigit() else None
                        else:
                            sha, length = digest(block[cut:]), len(block) - cut
                        rows.append((path, at, head["warc-type"], head["warc-record-id"], head.get("warc-target-uri"), head.get("warc-refers-to"), sha, length, block[:cut], block[cut:] if with_payload else None))
                        held += len(block)
                        if len(rows) >= 256 or held >= 4 << 20:
                            yield made(rows)
                            rows, held = [], 0
        if rows:
            yield made(rows)

    schema = "path string, offset long, warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, http_header binary, payload binary"
    # dealt out by number: adaptive execution does not merge the ranges, whose rows are tiny, into one task
    n = ranges.count()
    return ranges.repartition(max(1, min(n, MOST_TASKS))).mapInArrow(run, schema)


def warc_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 0) -> DataFrame:
    """Rows written as archives in the shared folder and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Null payloads are empty ones. Rows with a null id are responses; rows that
    repeat all stay, see write_warc. An empty table gives none; other columns,
    whatever their names, are not looked at.
    """
    spark: SparkSession = df.sparkSession
    files = write_warc(df, new_path(spark, "warc"), id_col, url_col, payload_col, revisit_from)
    r = read_warc(files, with_payload=False)
    number = lambda c: F.nullif(F.regexp_extract(c, f"{URN}(-?[0-9]+)", 1), F.lit("")).cast("long")
    return r.select(
        number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest",
        F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"), F.col("target_uri").alias("url"),
    )
