"""WARC archives: writing captures, reading records, assembling transactions.

A capture is written as three records: the request, the response (or a revisit
of an earlier response with the same payload) and metadata; request and
metadata name the response in ``WARC-Concurrent-To``. Spark's text writer
appends the records, whose end mark (two line breaks) is its line separator, to
gzip files in a shared folder. Files are read back as a whole, one per row, and
parsed by content length; transactions are assembled by joining records through
the concurrent-to identifiers into one nested row per capture.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafac.llm.tables import written
from stratafac.session import scratch_path

#: Payloads below this many bytes are never revisited.
REVISIT_BYTES = 100
#: Captures per file and bytes of records per Arrow batch: both bound memory.
FILE_CAPTURES = 10_000
BATCH_BYTES = 4 << 20
#: Equal rows that one step of a task writes.
TWINS = 1_000

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "type string, record_id string, concurrent_to string, refers_to string, target_uri string, "
    "payload_digest string, headers map<string,string>, http string, payload binary"
)


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int = REVISIT_BYTES) -> DataFrame:
    """``id``, ``url``, ``payload``, ``digest``, ``capture`` (a name made from
    id, URL and digest; rows alike in them are numbered) and ``first``: where an
    equal payload of ``least`` bytes or more has a capture of smaller id (ties:
    of smaller name), that capture.

    Only digests are grouped; the table of repeated digests is written, so
    that Spark knows its size when it chooses how to join the payloads to it.
    """
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    name = F.concat_ws("-", F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lower(F.hex(F.xxhash64("id", "url", "digest"))))
    base = base.withColumn("capture", name)
    large = base.where(F.octet_length("payload") >= least)
    order = F.struct(F.col("id").isNull(), "id", "capture")
    repeated = large.groupBy("digest").agg(F.min_by("capture", order).alias("first"), F.count("*").alias("_n")).where("_n > 1")
    repeated = written(repeated.select(F.col("digest").alias("repeated_digest"), "first"), "warc-repeated")
    joined = _numbered(base).join(repeated, F.col("digest") == F.col("repeated_digest"), "left").drop("repeated_digest")
    return joined.withColumn("first", F.when(F.col("first") != F.col("capture"), F.col("first")))


def _numbered(base: DataFrame) -> DataFrame:
    """``base`` with names of their own for rows that share a capture's name.

    Such rows are equal, so one of them stands for all: it is kept once and
    repeated as often as it was there, in steps that other tasks can take.
    """
    twins = base.groupBy("capture").agg(F.count("*").alias("_n")).where("_n > 1")
    twins = written(twins.select(F.col("capture").alias("_twin"), "_n"), "warc-twins")
    if twins.isEmpty():
        return base
    same = F.col("capture") == F.col("_twin")
    # pre-aggregated where the rows are, however many are alike
    one = base.join(twins, same).groupBy("capture", "_n").agg(*(F.first(c).alias(c) for c in base.columns if c != "capture"))
    steps = one.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_n") - 1).cast("long"), F.lit(TWINS).cast("long"))))
    copies = steps.repartition("capture", "_step").withColumn("_k", F.explode(F.sequence(F.col("_step"), F.least(F.col("_step") + TWINS, F.col("_n")) - 1)))
    named = copies.withColumn("capture", F.when(F.col("_k") == 0, F.col("capture")).otherwise(F.concat_ws("-", "capture", F.col("_k").cast("string"))))
    return base.join(twins, same, "left_anti").unionByName(named.select(*base.columns))


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its end mark; headers that are null are left out."""
    lines = [F.concat(F.lit(f"\r\n{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string")))
    head = F.concat(F.lit(f"{VERSION}\r\nWARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, *(F.coalesce(x, F.lit("")) for x in lines))
    return F.concat(head, F.lit("\r\n\r\n"), block)


def write_archive(captures: DataFrame, path: str, date: str, file_captures: int = FILE_CAPTURES) -> None:
    """Write ``with_revisits``' rows as WARC files below ``path``.

    Record ids are made from the capture's name, so a task that runs again
    writes the same records; the page's id is in the metadata record
    (``page_id``, left out if null).
    """
    name = lambda kind, col="capture": F.concat(F.lit(f"<urn:{kind}:"), F.col(col), F.lit(">"))
    # a header must stay one line
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")
    stamp = ("WARC-Date", F.lit(date))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    again = F.col("first").isNotNull()
    response = _record(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        [
            ("WARC-Record-ID", name("response")), stamp, ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Profile", F.when(again, F.lit(REVISIT_PROFILE))),
            ("WARC-Refers-To", name("response", "first")),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(again, http).otherwise(F.concat(http, F.col("payload"))),
    )
    common = [stamp, ("WARC-Concurrent-To", name("response")), ("WARC-Target-URI", uri)]
    request = _record(
        "request",
        [("WARC-Record-ID", name("request")), *common, ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")),
    )
    metadata = _record(
        "metadata",
        [("WARC-Record-ID", name("metadata")), *common, ("Content-Type", F.lit("application/warc-fields"))],
        F.coalesce(F.concat(F.lit("page_id: "), F.col("id").cast("string"), F.lit("\r\n")), F.lit("")),
    )
    out = captures.select(F.explode(F.array(request, response, metadata)).alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 3 * file_captures).text(path)


def _inflated(data: bytes) -> Iterator[bytes]:
    """The bytes of a plain or gzip file (of any number of members), in steps."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, step = memoryview(data), 1 << 20
    engine, at = zlib.decompressobj(31), 0
    while at < len(view) or engine.unconsumed_tail:
        part = engine.unconsumed_tail or view[at : at + step]
        if not engine.unconsumed_tail:
            at += len(part)
        yield engine.decompress(part, 4 * step)
        if engine.eof:
            at -= len(engine.unused_data)
            engine = zlib.decompressobj(31)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of a file."""
    buffer, steps = bytearray(), _inflated(data)

    def fill() -> bool:
        for x in steps:
            if x:
                buffer.extend(x)
                return True
        return False

    while True:
        while buffer[:2] == b"\r\n" or (len(buffer) < 4 and fill()):
            if buffer[:2] == b"\r\n":
                del buffer[:2]
        if not buffer:
            return
        scanned = 0
        while (end := buffer.find(b"\r\n\r\n", max(0, scanned - 3))) < 0:
            scanned = len(buffer)
            if not fill():
                raise ValueError("a record's header doesn't end")
        lines = bytes(buffer[:end]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        headers: dict[str, str] = {}
        for line in lines[1:]:
            key, _, value = line.partition(":")
            headers[key.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        while len(buffer) < end + 4 + size:
            if not fill():
                raise ValueError("a record's block is cut off")
        yield headers, bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size]


_FIELDS = (("type", "warc-type"), ("record_id", "warc-record-id"), ("concurrent_to", "warc-concurrent-to"), ("refers_to", "warc-refers-to"), ("target_uri", "warc-target-uri"), ("payload_digest", "warc-payload-digest"))


def _record_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
    names = [*(f for f, _ in _FIELDS), "headers", "http", "payload"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names)

    for files in batches:
        for data in files.column(0):
            rows, held = [], 0
            for headers, block in parse_records(data.as_py()):
                http, payload = None, block
                if headers.get("content-type", "").startswith("application/http"):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    http = head.decode("utf-8", "replace")
                rows.append((*(headers.get(h) for _, h in _FIELDS), list(headers.items()), http, payload))
                held += len(block) + 500
                if held > BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the WARC files (plain or gzip) below ``path``.

    ``payload`` is the block, without the HTTP header for HTTP records
    (``http`` has it). A task holds one file and ``BATCH_BYTES`` of records.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_record_batches, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``capture_id`` and the nested ``response`` (also a
    revisit; null if it is missing), ``requests`` and ``metadata`` (arrays).

    Records join through ``concurrent_to``; one that names no other record
    starts a capture of its own. All columns of ``records`` are kept in the
    nested records.
    """
    whole = F.struct(*records.columns)
    kind = F.col("type")
    return (
        records.select(F.coalesce("concurrent_to", "record_id").alias("capture_id"), kind, whole.alias("r"))
        .groupBy("capture_id")
        .agg(
            F.first(F.when(kind.isin("response", "revisit"), F.col("r")), ignorenulls=True).alias("response"),
            F.collect_list(F.when(kind == "request", F.col("r"))).alias("requests"),
            F.collect_list(F.when(kind == "metadata", F.col("r"))).alias("metadata"),
        )
    )


def archived(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Write ``pages`` to a fresh archive in the shared folder; returns its path.

    Defined cases: a null payload is empty, a null URL leaves its header out;
    of rows that tie for a payload's smallest id one is the response; a null
    id counts as the largest; rows alike in id, URL and payload are a capture
    each; an empty table gives an archive without records.
    """
    path = scratch_path(pages.sparkSession, f"warc-{uuid.uuid4().hex}")
    write_archive(with_revisits(pages, id_col, url_col, html_col), path, date)
    return path


def capture_digests(records: DataFrame) -> DataFrame:
    """Per capture: ``page_id``, ``payload_bytes`` and ``payload_digest`` of the
    full payload, ``record_type`` and ``refers_to``.

    Whole records are assembled; size and digest are taken from the nested rows
    and written, and a revisit takes both from the response that it refers to.
    """
    fields = F.element_at("metadata", 1)["payload"].cast("string")
    page = F.regexp_extract(fields, r"(?m)^page_id: (-?\d+)\r?$", 1)
    captures = assemble(records).select(
        "capture_id",
        F.when(page != "", page).cast("long").alias("page_id"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("to"),
        F.octet_length("response.payload").cast("long").alias("size"),
        F.sha2("response.payload", 256).alias("digest"),
    )
    captures = written(captures, "warc-captures")
    targets = captures.where("record_type = 'response'").select(
        F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("size").alias("t_size"), F.col("digest").alias("t_digest")
    )
    # only revisits are joined: the others' null reference would be one hot key
    again = F.col("record_type") == "revisit"
    revisits = captures.where(again).join(targets, F.col("to") == F.col("target"), "left")
    revisits = revisits.select("page_id", F.col("t_size").alias("payload_bytes"), F.col("t_digest").alias("payload_digest"), "record_type", "refers_to")
    others = captures.where(~F.coalesce(again, F.lit(False)))
    others = others.select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return others.unionByName(revisits)
