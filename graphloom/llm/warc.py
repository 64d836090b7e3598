"""Legacy web archives: writing and parsing ARC files, converting them to WARC, reading WARC back.

An ARC file starts with a version block, whose last line names the fields of all record
headers: five in version 1, ten in version 2. A record is its header line, as many bytes of
network response as the header's last field declares, and a line feed. The converter
parses the header by its file's version, takes the declared bytes, and synthesises what
WARC asks for: record identifiers, ISO timestamps, types and digests.

Archives are gzip files of UTF-8 text of about ``file_bytes`` each, written by Spark's
own writer, so that any store that Spark writes to can hold them and a lost task
leaves no part of a file behind.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import written

FILE_BYTES = 8 << 20
#: Tables with at most so many rows of a digest, a record id, a url and a date may be broadcast (some 30 MB).
BROADCAST_ROWS = 100_000

# The header fields that each ARC version declares, in order.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_BLOCK_END = "\r\n\r\n"
_SAFE = "!#$%&'()*+,/:;=?@[]~-._"


def sha1_base32(data: bytes) -> str:
    """The digest that WARC names ``sha1:``: upper-case base32 without the prefix."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _packed(parts: Iterable[str], head: str, file_bytes: int) -> Iterator[str]:
    """Whole files: ``head`` and as many parts as fit; a larger part gets a file of its own."""
    held, size = [], 0
    for part in parts:
        if held and size + len(part) > file_bytes:
            yield head + "".join(held)
            held, size = [], 0
        held.append(part)
        size += len(part)
    if held:
        yield head + "".join(held)


def _save(files: DataFrame, path: str) -> None:
    """Writes each row's text as one gzip file."""
    files.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").option("compression", "gzip").text(path)


def _arc_head(version: int, name: str) -> str:
    body = f"{version} 0 Synthetic\n{FIELDS[version]}\n"
    blank = {1: "", 2: "200 - - 0 {} ".format(name)}[version]
    return f"filedesc://{name} 0.0.0.0 19960101000000 text/plain {blank}{len(body)}\n{body}\n"


def _arc_record(version: int, name: str, page_id: str | None, url: str | None, html: str, date: str) -> str:
    named = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}\r\n{html}"
    data = block.encode("utf-8", "replace")
    target = quote(url, safe=_SAFE) if isinstance(url, str) and url else "-"
    middle = {1: "", 2: f"200 {hashlib.md5(data).hexdigest()} - 0 {name} "}[version]
    return f"{target} 0.0.0.0 {date} text/html {middle}{len(data)}\n{data.decode()}\n"


def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "20200101000000", file_bytes: int = FILE_BYTES) -> None:
    """Writes one ARC record for each row; files with an even hash of their first record are of version 1, others of version 2.

    A null html is an empty payload, a null or empty url is ``-``, other characters
    that a header line can't hold are percent-encoded, and a null page_id leaves its response header out.
    Repeated rows become repeated records; other columns take no part.
    """

    def files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, u, h if isinstance(h, str) else "") for p, u, h in zip(frame["p"], frame["u"], frame["h"], strict=True)]
            while rows:
                size, n = 0, 0
                while n < len(rows) and (not n or size + len(rows[n][2]) <= file_bytes):
                    size += len(rows[n][2])
                    n += 1
                own, rows = rows[:n], rows[n:]
                mark = hashlib.sha1(repr(own[0][:2]).encode("utf-8", "replace")).digest()
                version = 1 + mark[0] % 2
                name = f"{mark.hex()[:12]}.arc"
                text = _arc_head(version, name) + "".join(_arc_record(version, name, *x, date) for x in own)
                yield pd.DataFrame({"value": [text[:-1]]})  # the writer ends it with the last line feed

    rows = pages.select(F.col(page_id).cast("bigint").cast("string").alias("p"), F.col(url).alias("u"), F.col(html).alias("h"))
    _save(rows.mapInPandas(files, "value string"), path)


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record after the version block of an ARC file."""
    at, fields = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            break
        line = data[at:end].decode("utf-8", "replace")
        if not line:
            at = end + 1
            continue
        values = line.split(" ")
        length = int(values[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError(f"ARC record at {at} declares {length} bytes, {len(block)} are there")
        if fields is None:
            fields = block.decode("utf-8", "replace").split("\n")[1].split(" ")
        elif len(values) != len(fields):
            raise ValueError(f"ARC header at {at} has {len(values)} fields, its version {len(fields)}")
        else:
            yield dict(zip(fields, values, strict=True)), block
        at = end + 1 + length


_PAGE = re.compile(rb"^X-Page-Id: (-?[0-9]+)\r$", re.MULTILINE)


def _payload(block: bytes) -> tuple[object, bytes]:
    """Page id and payload of a network response."""
    cut = block.find(_BLOCK_END.encode())
    named = _PAGE.search(block, 0, cut + 2)
    return (int(named[1]) if named else None), block[cut + 4 :]


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """A frame whose ids stay whole numbers beside nulls."""
    ids = ("page_id", "refers_to")
    return pd.DataFrame({c: pd.array([r[k] for r in rows], dtype="Int64") if c in ids else [r[k] for r in rows] for k, c in enumerate(columns)})


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the ARC files in a folder: page_id, url, date (14 digits), mime, block, payload_bytes, payload_digest and record_id.

    A file without records gives none. A record that is shorter than it declares, or has another number of header fields than its version, is an error.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, content in zip(frame["path"], frame["content"], strict=True):
                out = []
                for head, block in arc_records(gzip.decompress(content)):
                    page, payload = _payload(block)
                    # The place of a record in the archive is its own, however often its content repeats.
                    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{source.rpartition('/')[2]} {len(out)}")
                    out.append((page, head["URL"], head["Archive-date"], head["Content-type"], block.decode(), len(payload), sha1_base32(payload), f"urn:uuid:{name}"))
                if out:
                    yield _frame(out, ["page_id", "url", "date", "mime", "block", "payload_bytes", "payload_digest", "record_id"])

    schema = "page_id bigint, url string, date string, mime string, block string, payload_bytes bigint, payload_digest string, record_id string"
    return _stored(spark, path).mapInPandas(parse, schema)


def mark_revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The records with refers_to: null for a response, else the page_id of the response with the same payload, and that record's id, url and date.

    Among equal payloads of ``least_bytes`` or more the smallest page_id is the response; repeated
    rows of that id are all responses, and records without a page_id revisit it (alone among
    themselves they are responses). The first ids are counted with partial sums in each
    task. They reach the records by broadcast only when they are few, else by two joins: payloads with
    more than a thousandth of all records (a thousand at most) by broadcast, the rest by shuffle.
    """
    firsts = (
        records.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id", "url", "date"))).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first is not null")
        .select(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"), "first", "n")
    )
    firsts = written(firsts, "responses")
    same = (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes"))
    groups, copies = firsts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if groups <= BROADCAST_ROWS:
        joined = records.join(F.broadcast(firsts), same, "left").select(records["*"], "first")
    else:
        hot = F.broadcast(firsts.where(F.col("n") > copies / 1000))
        marked = records.join(hot, same, "left").select(records["*"], F.col("first").alias("_hot"))
        # Records that the hot list answered get keys of their own, so that they spread.
        key = F.when(F.col("_hot").isNull(), F.col("payload_digest")).otherwise(F.col("record_id"))
        marked = marked.withColumn("_key", key)
        joined = marked.join(firsts, (F.col("_key") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
        joined = joined.select(records["*"], F.coalesce("_hot", "first").alias("first"))
    revisit = ~F.coalesce(F.col("page_id") == F.col("first.page_id"), F.lit(False))
    names = {"refers_to": "page_id", "refers_record": "record_id", "refers_url": "url", "refers_date": "date"}
    return joined.withColumns({name: F.when(revisit, F.col(f"first.{c}")) for name, c in names.items()}).drop("first")


def _stamp(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def _warc_record(kind: str, name: str, url: str, date: str, digest: str, block: str, extra: str = "") -> str:
    data = block.encode()
    return (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nWARC-Date: {_stamp(date)}\r\n"
        f"WARC-Target-URI: {url}\r\nWARC-Payload-Digest: sha1:{digest}\r\nWARC-Block-Digest: sha1:{sha1_base32(data)}\r\n{extra}"
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(data)}\r\n\r\n{block}{_BLOCK_END}"
    )


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes the marked records of ``mark_revisits`` as WARC 1.1, each file with a warcinfo record.

    A revisit keeps the response's headers only; the size of the payload it stands for is in ``X-Payload-Length``.
    """

    def parts(frame: pd.DataFrame) -> Iterator[str]:
        for r in frame.itertuples(index=False):
            extra = f"X-Payload-Length: {r.payload_bytes}\r\n"
            if r.refers_to is None:
                yield _warc_record("response", r.record_id, r.url, r.date, r.payload_digest, r.block, extra)
            else:
                extra += f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nX-Refers-To-Page: {r.refers_to}\r\n"
                extra += f"WARC-Refers-To: <{r.refers_record}>\r\nWARC-Refers-To-Target-URI: {r.refers_url}\r\nWARC-Refers-To-Date: {_stamp(r.refers_date)}\r\n"
                head = r.block[: r.block.find(_BLOCK_END) + 4]
                yield _warc_record("revisit", r.record_id, r.url, r.date, r.payload_digest, head, extra)

    def files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        info = "software: graphloom\r\nformat: WARC file version 1.1\r\n"
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, info)}>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n{info}{_BLOCK_END}"
        for frame in frames:
            for text in _packed(parts(frame), head, file_bytes):
                yield pd.DataFrame({"value": [text[:-1]]})  # the writer ends it with the last line feed

    rows = records.select("record_id", "url", "date", "payload_bytes", "payload_digest", "block", F.col("refers_to").cast("string").alias("refers_to"), "refers_record", "refers_url", "refers_date")
    _save(rows.mapInPandas(files, "value string"), path)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each WARC record."""
    at = 0
    while at < len(data):
        cut = data.find(b"\r\n\r\n", at)
        lines = data[at:cut].decode("utf-8", "replace").split("\r\n")
        if cut < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        end = cut + 4 + int(head["Content-Length"])
        yield head, data[cut + 4 : end]
        at = end + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records but warcinfo of the WARC files in a folder.

    Columns: page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id and
    payload (null in a revisit). A response whose payload does not have the digest it names is an error.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                out = []
                for head, block in warc_records(gzip.decompress(content)):
                    kind = head["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    page, payload = _payload(block)
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and sha1_base32(payload) != digest:
                        raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its digest")
                    refers = int(head["X-Refers-To-Page"]) if kind == "revisit" else None
                    text = payload.decode() if kind == "response" else None
                    out.append((page, head["WARC-Target-URI"], int(head["X-Payload-Length"]), digest, kind, refers, head["WARC-Record-ID"], text))
                columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "payload"]
                if out:
                    yield _frame(out, columns)

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, payload string"
    return _stored(spark, path).mapInPandas(parse, schema)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Converts a folder of ARC files to WARC files with revisit records for repeated payloads."""
    write_warc(mark_revisits(read_arc(spark, arc_path), least_bytes), warc_path, file_bytes)
