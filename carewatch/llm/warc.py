"""WARC archives: a writer for record rows and a sequential reader with bounded memory."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes read from an archive at a time, and bytes of records after which a writer begins the next archive.
READ, ROLL = 1 << 16, 256 << 20
#: Longest header of a record: more than a Spark string can make of a url. Longest HTTP header looked for in a block.
HEADER, HTTP_HEADER = 7 << 30, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "target_uri string, record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string, status string"


def _fs(uri: str):
    """A file system and path for a URI; Arrow knows local files, HDFS and the object stores."""
    from pyarrow import fs

    if "://" not in uri:
        uri = re.sub("^file:/*", "/", uri)
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def sha1_name(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def clean(value: str) -> str:
    """A header value on one line: control signs and spaces are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(target: str, record_id: str, kind: str, refers_to: str | None, payload: bytes, date: str) -> bytes:
    """One gzip member. A revisit keeps the HTTP header of the full payload and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {clean(target)}", f"WARC-Date: {date}", f"WARC-Record-ID: <{record_id}>"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Block-Digest: sha1:{sha1_name(block)}", f"WARC-Payload-Digest: sha1:{sha1_name(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write_warc(records: DataFrame, folder: str, date: datetime | None = None) -> DataFrame:
    """Write records(target_uri, record_id, record_type, refers_to, payload) and return the manifest (path, n_records).

    Each task writes archives under names of its own attempt; the manifest is written by
    Spark's committer, so it lists those of successful attempts alone and a lost executor
    or a repeated task leaves at most files that nothing names. Null target_uri counts as
    the record id, null payload as empty. An empty table writes no archive.
    """
    stamp = (date or datetime(2026, 1, 1, tzinfo=timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def put(batches):
        fs, root = _fs(folder)
        out, n, size, path = None, 0, 0, ""
        for pdf in batches:
            for target, rid, kind, ref, payload in pdf.itertuples(index=False, name=None):
                if out is None:
                    path, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{path}", compression=None)
                data = record_bytes(target or rid, rid, kind, ref, payload or b"", stamp)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ROLL:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [f"{folder}/{path}"], "n_records": [n]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{path}"], "n_records": [n]})

    cols = records.select("target_uri", "record_id", "record_type", "refers_to", F.col("payload").cast("binary").alias("payload"))
    return cols.mapInPandas(put, "path string, n_records long")


class Members:
    """The gzip members of a stream one after the other, each decompressed piece by piece."""

    def __init__(self, stream):
        self.stream, self.raw, self.plain, self.z, self.ended = stream, b"", b"", None, False

    def next(self) -> bool:
        """Go to the next member; False at the end of the stream."""
        self.raw = self.raw or self.stream.read(READ)
        self.plain, self.z, self.ended = b"", zlib.decompressobj(31), False
        return bool(self.raw)

    def more(self) -> bool:
        """Decompress a piece more of this member; False at its end."""
        if self.ended:
            return False
        self.raw = self.raw or self.stream.read(READ)
        if not self.raw:
            raise ValueError("truncated member")
        self.plain += self.z.decompress(self.raw, READ)
        self.raw = self.z.unconsumed_tail or self.z.unused_data
        self.ended = self.z.eof
        return True

    def header(self, most: int = HEADER) -> bytes:
        """Up to the next empty line."""
        out = bytearray()
        while True:
            seen = max(0, len(out) - 3)
            out += self.plain
            self.plain = b""
            if (end := out.find(b"\r\n\r\n", seen)) >= 0:
                self.plain = bytes(out[end + 4 :])
                return bytes(out[:end])
            if len(out) > most or not self.more():
                raise ValueError("header without end")

    def body(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if not self.plain and not self.more():
                raise ValueError("content ends before its length")
            piece, self.plain = self.plain[:n], self.plain[n:]
            n -= len(piece)
            yield piece


def fields(header: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a folded line goes on with the value before."""
    lines = re.sub(r"\r\n[ \t]+", " ", header.decode("utf-8", "replace")).split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read_record(m: Members, keep: bool) -> dict:
    """The record of the current member, framed by its content length, its digests verified as it streams."""
    head = m.header()
    if not head.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    h = fields(head)
    left = int(h["content-length"])
    block, payload, kept, n, status = hashlib.sha1(), hashlib.sha1(), [], 0, "ok"
    http = bytearray() if h.get("content-type", "").startswith("application/http") else None
    said = None
    for piece in m.body(left):
        block.update(piece)
        if http is not None:
            seen = max(0, len(http) - 3)
            http += piece
            if (end := http.find(b"\r\n\r\n", seen)) >= 0:
                said = fields(bytes(http[:end])).get("content-length")
                piece = bytes(http[end + 4 :])
            elif len(http) > HTTP_HEADER:  # a block without an HTTP header: all of it is payload
                piece = bytes(http)
            else:
                continue
            http = None
        payload.update(piece)
        n += len(piece)
        if keep:
            kept.append(piece)
    tail = b"".join(m.body(4))
    if tail != b"\r\n\r\n" or m.plain or m.more() and m.plain:
        raise ValueError("content doesn't end at its length")
    bare = lambda x: x.removeprefix("sha1:").upper()
    name = lambda d: base64.b32encode(d.digest()).decode()
    kind = h.get("warc-type", "")
    if "warc-block-digest" in h and bare(h["warc-block-digest"]) != name(block):
        status = "block digest differs"
    elif kind != "revisit" and "warc-payload-digest" in h and bare(h["warc-payload-digest"]) != name(payload):
        status = "payload digest differs"
    digest = bare(h["warc-payload-digest"]) if kind == "revisit" and "warc-payload-digest" in h else name(payload)
    size = int(said) if kind == "revisit" and said else n
    angle = lambda x: x and x.strip("<>")
    return {"target_uri": h.get("warc-target-uri"), "record_id": angle(h.get("warc-record-id")), "record_type": kind, "refers_to": angle(h.get("warc-refers-to")), "payload_bytes": size, "payload_digest": digest, "status": status} | ({"payload": b"".join(kept) if kind != "revisit" else None} if keep else {})


def records_of(stream, keep: bool) -> Iterator[dict]:
    """Every record of an archive. A member that can't be read gives a row with the reason as status; the next members follow, if its end is known."""
    m = Members(stream)
    while m.next():
        try:
            yield read_record(m, keep)
        except (ValueError, KeyError, zlib.error) as e:
            yield {"record_type": "unreadable", "status": str(e)[:200] or type(e).__name__}
            try:
                while m.more():
                    m.plain = b""
            except (ValueError, zlib.error):
                return


def read_warc(spark: SparkSession, paths: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives in paths(path), one task for each few archives.

    Records stream through in pieces of 64 KB, their digests are verified on the way; whole
    payloads are only held one by one when asked for. Damaged records are rows whose status
    says why, never a failure. No paths give no rows.
    """

    def get(batches):
        held = []
        for pdf in batches:
            for path in pdf["path"]:
                fs, root = _fs(path)
                with fs.open_input_stream(root, compression=None) as stream:
                    for r in records_of(stream, payloads):
                        held.append(r)
                        if len(held) == (64 if payloads else 5000):
                            yield frame(held)
                            held = []
        if held:
            yield frame(held)

    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * payloads

    def frame(rows):
        out = pd.DataFrame(rows).reindex(columns=names)
        return out.assign(payload_bytes=out["payload_bytes"].astype("Int64"))

    return paths.select("path").repartition(max(1, min(paths.count(), 4 * spark.sparkContext.defaultParallelism))).mapInPandas(get, RECORD + ", payload binary" * payloads)


def with_revisits(pages: DataFrame, scratch: Scratch, least: int = 0) -> DataFrame:
    """pages(page_id, url, html) as records: of equal payloads of at least `least` bytes all but those with the smallest page_id revisit it.

    Payloads of equal SHA-256 and length are equal. Null html is an empty payload. Rows that
    share the smallest page_id are all responses; a null page_id is never smallest unless
    all are null, and then all are responses.
    """
    html = F.coalesce("html", F.lit(""))
    keys = pages.select("page_id", F.octet_length(html).alias("n"), F.sha2(html, 256).alias("key"))
    firsts = keys.where(F.col("n") >= least).groupBy("key", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    firsts = scratch.stored(firsts.where("copies > 1 and first is not null").select("key", "first"), "firsts")
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("key"))
    got = rows.select("page_id", "key").join(firsts, "key").where("not page_id <=> first").select("page_id", "key", "first")
    got = scratch.stored(got.distinct(), "revisits")
    on = rows["page_id"].eqNullSafe(got["page_id"]) & (rows["key"] == got["key"])
    both = rows.join(got, on, "left").select(rows["page_id"], "url", "html", "first")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    return both.select(
        F.col("url").alias("target_uri"), name(F.col("page_id")).alias("record_id"), F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.when(F.col("first").isNotNull(), name(F.col("first"))).alias("refers_to"), F.col("html").cast("binary").alias("payload"),
    )


def op1_warc(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """One row per row of pages(page_id, url, html, ...), as read back: page_id, payload_bytes, payload_digest, record_type, refers_to, status.

    Null html is an empty payload, a null url the record's id; very long payloads are read
    in pieces; rows that repeat a page are records of their own (see with_revisits). Other
    columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(spark)
    records = with_revisits(pages, scratch)
    manifest = scratch.stored(write_warc(records, scratch.sub("archives")), "manifest")
    back = read_warc(spark, manifest)
    page = lambda c: F.substring_index(c, ":", -1).try_cast(pages.schema["page_id"].dataType)
    return back.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"), "status")


OP1_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS first,
         list_transform([1, 6, 11, 16, 21, 26, 31, 36], lambda i: ('0x' || substr(h, i, 5))::BIGINT) AS parts
  FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(parts, lambda n:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 15) & 31) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 10) & 31) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 5) & 31) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, 'ok' AS status
FROM d
"""
