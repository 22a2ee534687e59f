"""WARC archives: write captures, read records, assemble transactions."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.staging import fresh_path, materialize, size_checked

#: Captures per archive file: a file is read by one task, as a whole.
CAPTURES_PER_FILE = 1000
_END = "\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
RECORD = "type string, record_id string, concurrent_to string, refers_to string, uri string, payload_bytes long, payload_digest string, page_id string, payload string"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, page_id: str | None, url: str | None, digest: str) -> str:
    """The same id for the same capture, however often it is written."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr((kind, page_id, url, digest)).encode()).digest())}>"


def _record(kind: str, rid: str, uri: str | None, content: str, block: str, **more: str | None) -> str:
    names = {"uri": "WARC-Target-URI", "to": "WARC-Concurrent-To", "refers": "WARC-Refers-To", "profile": "WARC-Profile", "digest": "WARC-Payload-Digest"}
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {_DATE}", f"Content-Type: {content}"]
    safe = None if uri is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", uri)
    head += [f"{names[k]}: {v}" for k, v in {"uri": safe, **more}.items() if v is not None]
    return "\r\n".join([*head, f"Content-Length: {len(block.encode())}", "", block])


def capture(page_id: str | None, url: str | None, html: str, first: tuple[str | None, str | None] | None) -> str:
    """Request, response (or revisit of the page ``first``) and metadata record of one page, as text."""
    digest = digest_of(html.encode())
    kind, rid = ("response" if first is None else "revisit"), record_id("capture", page_id, url, digest)
    _, _, rest = (url or "").partition("://")
    host, slash, path = _UNSAFE.sub("", rest.partition("#")[0]).partition("/")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html.encode())}{_END}"
    more = {} if first is None else {"refers": record_id("capture", *first, digest), "profile": _PROFILE}
    return _END.join((
        _record("request", record_id("request", page_id, url, digest), url, "application/http; msgtype=request", f"GET {slash or '/'}{path} HTTP/1.1\r\nHost: {host}{_END}", to=rid),
        _record(kind, rid, url, "application/http; msgtype=response", http + (html if first is None else ""), digest=f"sha1:{digest}", **more),
        _record("metadata", record_id("metadata", page_id, url, digest), url, "application/warc-fields", "" if page_id is None else f"page-id: {page_id}\r\n", to=rid),
    ))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write request, response or revisit, and metadata records of every row to gzip archives below ``path``.

    Of rows with equal payloads of ``least_bytes`` or more, that with the
    smallest id holds the payload; the others are revisits of it. Payloads are
    compared by their SHA-256; only digests, ids and urls are shuffled, unless
    the table of repeated payloads is too large to broadcast.
    """
    rows = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(id_col).alias("sort_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("html", 256)))
    large = F.octet_length("html") >= least_bytes
    order = F.struct(F.col("sort_id").isNull().alias("none"), "sort_id", "url", "page_id")
    firsts = rows.where(large).select("sha", order.alias("o")).groupBy("sha").agg(F.count("*").alias("n"), F.min("o").alias("o")).where("n > 1")
    firsts = materialize(firsts.select("sha", F.col("o.page_id").alias("first_id"), F.col("o.url").alias("first_url"), F.lit(True).alias("again")), "warc-firsts")
    tagged = rows.join(size_checked(firsts, 256), "sha", "left")
    revisit = F.coalesce(F.col("again") & large & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            records = [capture(i, u, h, (fi, fu) if again else None) for i, u, h, fi, fu, again in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.string())], names=["value"])

    out = tagged.select("page_id", "url", "html", "first_id", "first_url", revisit.alias("again")).mapInArrow(run, "value string")
    out.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", CAPTURES_PER_FILE).text(path)


# --------------------------------------------------------------------- reading


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an archive, plain or gzip in any number of members."""
    if content[:2] == b"\x1f\x8b":
        parts = []
        while content:
            z = zlib.decompressobj(wbits=31)
            parts.append(z.decompress(content))
            content = z.unused_data.lstrip(b"\0")
        content = b"".join(parts)
    at = 0
    while (at := content.find(b"WARC/", at)) >= 0:
        end = content.index(b"\r\n\r\n", at)
        fields = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in content[at:end].decode("utf-8", "replace").split("\r\n")[1:]))
        size = int(fields["content-length"])
        yield fields, content[end + 4 : end + 4 + size]
        at = end + 4 + size


def read_records(spark, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of all archives below ``path`` (columns of ``RECORD``).

    Length and digest are those of the payload found in the archive (after the
    HTTP header); payloads are returned as text only ``with_payload``.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        kinds = {"payload_bytes": pa.int64()}
        for b in batches:
            for content in b.column(0):
                rows = []
                for fields, block in parse_archive(content.as_py()):
                    kind = fields.get("warc-type")
                    row = {"type": kind, "record_id": fields.get("warc-record-id"), "concurrent_to": fields.get("warc-concurrent-to"), "refers_to": fields.get("warc-refers-to"), "uri": fields.get("warc-target-uri")}
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        row |= {"payload_bytes": len(payload), "payload_digest": digest_of(payload), "payload": payload.decode("utf-8", "replace") if with_payload else None}
                    elif kind == "revisit":
                        row["payload_digest"] = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    elif kind == "metadata" and block.startswith(b"page-id: "):
                        row["page_id"] = block[9:].partition(b"\r\n")[0].decode()
                    rows.append(row)
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, copies, capture, request, metadata (structs of a record's columns).

    Requests and metadata find their response or revisit by WARC-Concurrent-To.
    Records written ``copies`` times under one id are one capture. A capture
    whose response is missing keeps what there is, with a null ``capture``.
    """
    cols = [f.split()[0] for f in RECORD.split(", ")]
    of = lambda *kinds: F.when(F.col("type").isin(*kinds), F.struct(*cols))
    main = of("response", "revisit")
    return records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        F.greatest(F.count(main), F.lit(1)).alias("copies"), F.max(main).alias("capture"), F.max(of("request")).alias("request"), F.max(of("metadata")).alias("metadata")
    )


def archive_digests(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all rows to archives in the shared folder, read them back, and describe each page.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to
    (the page that holds a revisit's payload). Length and digest of a revisit
    are those of the response it refers to.

    Null html is an empty payload. A null url leaves the field out. A null id
    never holds a payload that a row with an id has too. Rows that repeat a
    page are copies of one capture and all are returned. Other columns are
    ignored; an empty table gives no rows.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    path = fresh_path(spark, "warc")
    write_archives(pages, path, least_bytes, id_col, url_col, html_col)
    captures = materialize(
        assemble(read_records(spark, path)).select(
            "capture_id", "copies", F.col("metadata.page_id").cast(kind).alias("page_id"), "capture.type", "capture.refers_to", "capture.payload_bytes", "capture.payload_digest"
        ),
        "warc-captures",
    )
    held = captures.where("type = 'response'")
    found = held.select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("first_id"), F.col("payload_bytes").alias("bytes"))
    again = captures.where("type = 'revisit'").join(found, "refers_to", "left")
    out = held.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast(kind).alias("refers_to"), "copies").unionByName(
        again.select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), F.col("first_id").alias("refers_to"), "copies")
    )
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies", "__copy")
