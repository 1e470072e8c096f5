"""WARC archives: writing records in segments, and putting segments together again.

Writing. Pages whose payload is equal to that of a page with a larger id become revisits of
it, if the payload is long enough to be worth it; all others are responses, an HTTP message
whose body is sent in chunks. Equal payloads are those with equal SHA-1, SHA-256 and length;
only pages that may have a twin move for it. A record beyond ``segment_bytes`` goes on in
continuation records. Every record is a gzip member of its own. Spark's text writer puts the
members one after the other (a member ends with a zero byte, which is the writer's line
separator), so any file system and Spark's commit protocol serve. No record is longer than a
segment and no file has more than ``file_records`` records.

Reading. Each task walks its archives record by record, by the stated length; an archive may
be of any size, as its bytes are streamed (in stores that only Spark's readers open it is one
value, 2 GB at most), and gzipped by record, as a whole, or plain. Records that came whole are
decoded where they are. Segments are grouped by the record they began in, ordered by number,
checked against the stated total length, joined once, and only then is the chunked framing
undone. A group holds one record; no page's payload meets another's. Revisits get
their payload's length and digest from the record that they refer to, by a join with one
row per response on one side.

Results that are defined: a null payload is empty, and a null url is left out of the record;
pages with equal id and payload (repeated rows) are each a response, as neither is larger;
a null id is smaller than all others; a very long payload is many segments, and whole in one
task alone; other columns are not read, whatever their names; a record whose segments are
missing or don't add up has a ``problem`` and neither length nor digest; a digest by another
algorithm is not checked; an empty table gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.llm.shared import stored
from textveil.operators.fields import rows_with
from textveil.sources.scratch import arrow_target, scratch_path

#: Payloads below this many bytes are not worth a revisit.
LEAST_REVISIT = 1000
END = b"\r\n\r\n"
#: Bytes of a gzip member before compression. Its last field is that length in four bytes, so
#: below 2^24 a member ends with a zero.
MEMBER = 1 << 23
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "name string, kind string, origin string, number int, total long, page_id string, "
    "digest string, refers_to string, content binary"
)
READ = (
    "record string, page_id string, record_type string, refers_record string, "
    "payload_bytes long, payload_digest string, problem string"
)


def record_name(page_id: Column, digest: Column) -> Column:
    """A record's identifier: the same whenever it is written."""
    key = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("")), F.lit("/"), digest))
    parts = [F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def chunked(payload: bytes, size: int) -> bytes:
    """A body in HTTP chunks."""
    out = [b"%x\r\n%s\r\n" % (len(part), part) for i in range(0, len(payload), size) if (part := payload[i : i + size])]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The body that was sent in chunks; None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0 or end + 2 + size > len(body):
            return None
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """Headers and block; what ends the record is the writer's separator."""
    clean = [(k, str(v).replace("\r", "%0D").replace("\n", "%0A")) for k, v in fields if v is not None]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*clean, ("Content-Length", len(block))])
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block


def page_records(row: dict, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """All records of one page."""
    common = [
        ("WARC-Type", row["kind"]),
        ("WARC-Record-ID", row["name"]),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", row["url"]),
        ("Page-ID", row["page_id"]),
        ("WARC-Payload-Digest", f"sha1:{row['digest']}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if row["kind"] == "revisit":
        more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", row["refers_to"])]
        return [_record(common + more, head + b"\r\n")]
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(row["payload"], chunk_bytes)
    if len(block) <= segment_bytes:
        return [_record(common, block)]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_record([*common, ("WARC-Segment-Number", 1)], parts[0])]
    for number, part in enumerate(parts[1:], 2):
        fields = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"{row['name'][:-1]}-{number}>"),
            ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Segment-Origin-ID", row["name"]),
            ("WARC-Segment-Number", number),
            ("WARC-Segment-Total-Length", len(block) if number == len(parts) else None),
        ]
        out.append(_record(fields, part))
    return out


def members(record: bytes) -> list[bytes]:
    """A record with its blank lines as a gzip member, or as several where it is very long."""
    data = record + END
    return [zlib.compress(data[i : i + MEMBER], wbits=31) for i in range(0, len(data), MEMBER)]


def _render(segment_bytes: int, chunk_bytes: int):
    """Gzip members of all records, without the zero that each ends with."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                for record in page_records(row, segment_bytes, chunk_bytes):
                    for member in members(record):
                        out.append(member[:-1])
                        size += len(member)
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])
                        out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    return run


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int = LEAST_REVISIT) -> DataFrame:
    """``name, kind, url, page_id, digest, refers_to, payload`` of each page's record."""
    payload = F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b""))
    id_ = F.col(f"`{id_col}`")
    rows = pages.select(id_.alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = F.octet_length("payload") >= least
    # Pages of one digest are told apart by a second one and the length.
    same = F.concat_ws("/", "digest", F.sha2("payload", 256), F.octet_length("payload"))
    rows = rows.withColumn("same", F.when(long, same))
    groups = rows.where("same is not null").groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    groups = stored(groups.where("n > 1").drop("n").withColumnRenamed("same", "twin"), "payloads")
    # Only pages whose payload may have a twin are moved.
    near, far = rows_with(rows, "same", groups.select("twin"))
    near = near.join(groups, F.col("same") == F.col("twin"), "left")
    again = ~F.col("id").eqNullSafe(F.col("top"))
    far = far.withColumns({"twin": F.lit(None).cast("string"), "top": F.col("id")})
    fresh = F.col("top").isNull() | ~again
    return near.unionByName(far).select(
        record_name(F.col("id"), F.col("digest")).alias("name"),
        F.when(fresh, "response").otherwise("revisit").alias("kind"),
        "url",
        F.col("id").cast("string").alias("page_id"),
        "digest",
        F.when(~fresh, record_name(F.col("top"), F.col("digest"))).alias("refers_to"),
        F.when(fresh, F.col("payload")).alias("payload"),
    )


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least: int = LEAST_REVISIT,
    segment_bytes: int = 16 << 10,
    chunk_bytes: int = 4 << 10,
    file_records: int = 2000,
) -> None:
    """Write all pages as WARC files below ``path``, every record a gzip member."""
    planned = plan_records(pages, id_col, url_col, html_col, least)
    records = planned.mapInArrow(_render(segment_bytes, chunk_bytes), "member binary")
    writer = records.select(F.col("member").cast("string").alias("value")).write
    writer.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", file_records).text(path)


def walk(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open archive."""
    while True:
        line = file.readline()
        while line in (b"\r\n", b"\n"):
            line = file.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := file.readline().rstrip(b"\r\n")):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        block = file.read(int(fields["content-length"]))
        yield fields, block


def opened(raw) -> io.BufferedIOBase:
    """An archive's records: unzipped if it begins like a gzip file."""
    file = io.BufferedReader(raw, 1 << 20)
    return gzip.GzipFile(fileobj=file) if file.peek(2)[:2] == b"\x1f\x8b" else file


def stated_sha1(value: str | None) -> str | None:
    """The SHA-1 that a header states, in hex; None where it states something else."""
    kind, _, digest = (value or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if len(digest) == 32:
        try:
            return base64.b32decode(digest, casefold=True).hex()
        except ValueError:
            return None
    return digest.lower() if len(digest) == 40 else None


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All records of the archives of a task, which come as a path or as bytes."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def read(value: pa.Scalar):
        if pa.types.is_string(value.type):
            system, target = arrow_target(value.as_py())
            return system.open_input_file(target)
        return io.BytesIO(value.as_buffer())

    for batch in batches:
        for value in batch.column(0):
            rows, size = [], 0
            with read(value) as raw, opened(raw) as file:
                for fields, block in walk(file):
                    own = fields["warc-record-id"]
                    number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
                    rows.append(
                        (own, fields["warc-type"], fields.get("warc-segment-origin-id", own if number else None),
                         int(number) if number else None, int(total) if total else None, fields.get("page-id"),
                         stated_sha1(fields.get("warc-payload-digest")), fields.get("warc-refers-to"), block)
                    )
                    size += len(block)
                    if size > 1 << 20:
                        yield flush(rows)
                        rows, size = [], 0
            if rows:
                yield flush(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every WARC record below ``path``, segments as they are (columns: ``RECORD``)."""
    files = spark.read.format("binaryFile").load(path)
    first = files.select("path").first()
    try:
        arrow_target(first[0] if first else "file:///")
    except pa.ArrowException:
        return files.select("content").mapInArrow(_parse, RECORD)
    return files.select("path").mapInArrow(_parse, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records, their content in ``parts``: segments grouped by origin, in order, with
    the stated total length.

    A record that was written several times (repeated rows) comes as often as its first
    segment; its other segments are then equal.
    """
    whole = records.where("number is null").select(
        "name", "kind", "page_id", "digest", "refers_to", F.array("content").alias("parts"), F.lit(None).cast("string").alias("problem")
    )
    parts = records.where("number is not null")
    first = F.col("number") == 1
    grouped = parts.groupBy("origin").agg(
        F.max(F.when(first, F.struct("kind", "page_id", "digest", "refers_to"))).alias("head"),
        F.count(F.when(first, 1)).alias("times"),
        F.max("total").alias("total"),
        F.array_sort(F.collect_set(F.struct("number", "content"))).alias("parts"),
    )
    numbers = F.transform("parts", lambda p: p["number"])
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["content"]))
    ordered = numbers == F.sequence(F.lit(1), F.greatest(F.size("parts"), F.lit(1)))
    problem = (
        F.when(F.col("times") == 0, "no first segment")
        .when(~ordered, "segments missing")
        .when(F.col("total").isNull(), "no last segment")
        .when(length != F.col("total"), "length differs")
    )
    again = grouped.select(
        F.col("origin").alias("name"),
        "head.kind",
        "head.page_id",
        "head.digest",
        "head.refers_to",
        F.transform("parts", lambda p: p["content"]).alias("parts"),
        problem.alias("problem"),
        F.explode(F.expr("sequence(1, greatest(times, 1))")).alias("__time"),
    )
    return whole.unionByName(again.drop("__time"))


def _payloads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and digest of the payload of each whole record, framing undone."""
    for batch in batches:
        sizes, digests, problems = [], [], []
        columns = [batch.column(c) for c in ("kind", "digest", "problem", "parts")]
        for row in zip(*columns, strict=True):
            kind, stated, problem = (value.as_py() for value in row[:3])
            body = None
            if kind == "response" and not problem:
                # One record's content at a time.
                head, _, body = b"".join(row[3].as_py()).partition(b"\r\n\r\n")
                if b"transfer-encoding: chunked" in head.lower():
                    body = unchunked(body)
                    problem = None if body is not None else "chunks broken"
            digest = hashlib.sha1(body).hexdigest() if body is not None else None
            if digest and stated and digest != stated:
                problem, body, digest = "digest differs", None, None
            sizes.append(None if body is None else len(body))
            digests.append(digest)
            problems.append(problem)
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("name", "page_id", "kind", "refers_to")),
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.string()),
                pa.array(problems, pa.string()),
            ],
            names=[f.split()[0] for f in READ.split(", ")],
        )


def read_pages(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """One row per page of the archives: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to, problem``."""
    read = stored(reassemble(read_records(spark, path)).mapInArrow(_payloads, READ), "records")
    responses = read.where("record_type = 'response'")
    known = stored(
        responses.groupBy(F.col("record").alias("refers_record")).agg(
            F.max("page_id").alias("top"), F.max("payload_bytes").alias("size"), F.max("payload_digest").alias("sha1")
        ),
        "responses",
    )
    revisits = read.where("record_type = 'revisit'").join(known, "refers_record", "left")
    lost = F.when(F.col("size").isNull(), "nothing to refer to")
    page = F.col("page_id").cast(id_type).alias("page_id")
    return responses.select(
        page, "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(id_type).alias("refers_to"), "problem"
    ).unionByName(
        revisits.select(
            page,
            F.col("size").alias("payload_bytes"),
            F.col("sha1").alias("payload_digest"),
            "record_type",
            F.col("top").cast(id_type).alias("refers_to"),
            F.coalesce("problem", lost).alias("problem"),
        )
    )


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """Write all pages to archives in the shared folder, and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col, **options)
    return read_pages(spark, path, pages.schema[id_col].dataType.simpleString())
