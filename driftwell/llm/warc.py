"""WARC archives with an index of their own.

Writing comes in two passes.  Payload digests are compared first, so that of equal payloads one record holds the bytes and the
others revisit it.  Then every task writes its records, one gzip member each, into an archive under a name of its own, and
returns what the index needs: archive, offset, length, URL and digest.  The index is a Spark table; an archive that a lost
or repeated task left behind is in no index and is never read.

Reading starts from the index alone.  The selected entries are dealt out by archive and stretch of bytes and sorted by offset;
entries that lie close together are one read.  A revisit has its payload's size from the record that has its payload.

Archives of other origin have no index; ``index_archives`` scans them for one.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.scratch import Scratch, settings


@dataclass(frozen=True)
class Warc:
    """Payloads from ``least_bytes`` on are written once.  An archive ends at ``archive_bytes``.

    Entries less than ``gap_bytes`` apart are read at once, up to ``read_bytes``; a task reads from stretches of
    ``stretch_bytes`` of an archive.
    """

    least_bytes: int = 100
    archive_bytes: int = 1 << 30
    gap_bytes: int = 1 << 16
    read_bytes: int = 4 << 20
    stretch_bytes: int = 64 << 20
    level: int = 6


INDEX = "archive string, offset long, length long, url string, digest string, record_type string"
RECORDS = "archive string, offset long, record_id string, record_type string, url string, refers_to_id string, declared_digest string, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed, so that equal rows give equal records in every run.
_DATE = "2000-01-01T00:00:00Z"
_GZIP = 31


def _line(value: str) -> str:
    """A header value on one line: blanks and control characters are percent-encoded, as in a URI."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in value)


def record(record_id: str, url: str | None, digest: str, payload: bytes | None, refers_to: str | None = None) -> bytes:
    """One WARC record; without ``payload`` a revisit of the record ``refers_to``."""
    kind = "response" if payload is not None else "revisit"
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", _DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _line(url)))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if payload is None:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    body = payload or b""
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + body + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record.  ValueError if it isn't whole."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip(" \t") for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("a WARC record ends early")
    return fields, rest[:size]


def page_urn(page_id: int | None) -> str:
    """The record name of a page; a page without id gets a name that no other has."""
    return f"urn:uuid:{uuid.uuid4()}" if page_id is None else f"urn:page:{page_id}"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _writer(folder: str, cfg: Warc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows: list[tuple] = []
                for page_id, url, html, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    if out is None or at >= cfg.archive_bytes:
                        if out is not None:
                            out.close()
                        # A name for each attempt of a task: what an attempt that failed has written is in no index.
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    revisit = refers_to is not None
                    pack = zlib.compressobj(cfg.level, zlib.DEFLATED, _GZIP)
                    member = pack.compress(record(page_urn(page_id), url, digest, None if revisit else html, page_urn(refers_to) if revisit else None)) + pack.flush()
                    out.write(member)
                    rows.append((f"{folder}/{name}", at, len(member), url, digest, "revisit" if revisit else "response"))
                    at += len(member)
                yield pa.RecordBatch.from_pylist([dict(zip(("archive", "offset", "length", "url", "digest", "record_type"), r, strict=True)) for r in rows], schema=_INDEX_ARROW)
        finally:
            if out is not None:
                out.close()

    return run


_INDEX_ARROW = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())])
_RECORD_ARROW = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to_id", pa.string()), ("declared_digest", pa.string()), ("payload", pa.binary())])


def coalesced(offsets: np.ndarray, lengths: np.ndarray, gap: int, most: int) -> list[tuple[int, int]]:
    """Index ranges of sorted entries that are one read: less than ``gap`` apart and, unless a single one is longer, ``most`` bytes."""
    out, a = [], 0
    for i in range(1, len(offsets) + 1):
        if i == len(offsets) or offsets[i] - (offsets[i - 1] + lengths[i - 1]) > gap or offsets[i] + lengths[i] - offsets[a] > most:
            out.append((a, i))
            a = i
    return out


def _reader(cfg: Warc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = "", None
        for batch in batches:
            archives = np.asarray(batch.column(0).to_pylist(), object)
            offsets, lengths = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            cuts = [0, *(np.flatnonzero(archives[1:] != archives[:-1]) + 1).tolist(), len(archives)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a and archives[a] != name:
                    if source is not None:
                        source.close()
                    name = archives[a]
                    fs, path = _filesystem(name)
                    source = fs.open_input_file(path)
                for i, j in coalesced(offsets[a:b], lengths[a:b], cfg.gap_bytes, cfg.read_bytes):
                    first = int(offsets[a + i])
                    data = source.read_at(int(offsets[a + j - 1] + lengths[a + j - 1]) - first, first)
                    rows = []
                    for k in range(a + i, a + j):
                        at = int(offsets[k]) - first
                        member = data[at : at + int(lengths[k])]
                        fields, body = parsed(zlib.decompress(member, _GZIP) if member[:2] == b"\x1f\x8b" else member)
                        rows.append(_row(name, int(offsets[k]), fields, body))
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_ARROW)
        if source is not None:
            source.close()

    return run


def _row(archive: str, offset: int, fields: dict[str, str], body: bytes) -> dict:
    bare = lambda k: fields[k].strip("<>") if k in fields else None
    url = fields.get("warc-target-uri")
    return {
        "archive": archive, "offset": offset, "record_id": bare("warc-record-id"), "record_type": fields.get("warc-type"), "url": None if url is None else url.strip("<>"),
        "refers_to_id": bare("warc-refers-to"), "declared_digest": (fields.get("warc-payload-digest") or ":").partition(":")[2] or None, "payload": body,
    }


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, cfg: Warc = Warc()) -> DataFrame:
    """Writes one record for every row of ``pages`` (page_id, url, html) into archives in ``folder``, and returns the index.

    The payload is html in UTF-8, null being empty.  Of rows with equal payloads of ``least_bytes`` or more that with the
    smallest page_id is the response, and the others revisit it; rows that share this page_id are all responses.  Null ids
    come last, and where no row has an id all are responses.  A null url gives no target header; blanks and control characters
    in a url are percent-encoded there.  Other columns are ignored;
    an empty table gives an empty index.
    """
    scratch = Scratch(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    long = rows.where(F.octet_length("html") >= cfg.least_bytes)
    # Copies are summed up before the shuffle; digests that one row has need not be met again.
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    firsts = scratch.keep(firsts, "firsts")
    # Only ids and digests go to the join; a hot digest is split there, and it is a table before it meets the payloads.
    revisits = long.select("page_id", "digest").join(firsts, "digest").where(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    revisits = scratch.keep(revisits.groupBy("page_id", "digest").agg(F.first("first").alias("first")), "revisits")
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    out = rows.join(revisits.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first"), same, "left").select("page_id", "url", F.when(F.col("first").isNull(), F.col("html")).alias("html"), "digest", "first")
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="2000", spark__sql__execution__arrow__maxBytesPerBatch=str(16 << 20)):
        return scratch.keep(out.mapInArrow(_writer(folder, cfg), INDEX), "index")


def read_records(index: DataFrame, cfg: Warc = Warc()) -> DataFrame:
    """The records of the entries of ``index``, any selection of rows of one, whole and with their payloads.

    ValueError inside the task for an entry that doesn't hold a whole record.  Entries may repeat and come in any order.
    """
    stretch = F.floor(F.col("offset") / cfg.stretch_bytes)
    dealt = index.select("archive", "offset", "length", stretch.alias("stretch"))
    dealt = dealt.repartition("archive", "stretch").sortWithinPartitions("archive", "offset").select("archive", "offset", "length")
    return dealt.mapInArrow(_reader(cfg), RECORDS)


def _scan(read_bytes: int):
    def members(source) -> Iterator[tuple[int, int, bytes]]:
        """(offset, length, record) of the gzip members, or of the plain records, of one archive from its start."""
        data, base = source.read(read_bytes), 0
        packed = data[:2] == b"\x1f\x8b"
        while data:
            if packed:
                pack, out, used = zlib.decompressobj(_GZIP), [], 0
                while not pack.eof:
                    out.append(pack.decompress(data[used:]))
                    used = len(data) - len(pack.unused_data)
                    if not pack.eof:
                        more = source.read(read_bytes)
                        if not more:
                            raise ValueError("an archive ends inside a record")
                        data += more
                yield base, used, b"".join(out)
            else:
                while (end := data.find(b"\r\n\r\n")) < 0 or len(data) < end + 8 + int(parsed_length(data[:end])):
                    more = source.read(read_bytes)
                    if not more:
                        raise ValueError("an archive ends inside a record")
                    data += more
                used = end + 8 + parsed_length(data[:end])
                yield base, used, data[:used]
            base += used
            data = data[used:] or source.read(read_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = _filesystem(name)
                rows: list[dict] = []
                with fs.open_input_stream(path, compression=None) as source:
                    for at, length, data in members(source):
                        fields, _ = parsed(data)
                        row = _row(name, at, fields, b"")
                        rows.append({"archive": name, "offset": at, "length": length, "url": row["url"], "digest": row["declared_digest"], "record_type": row["record_type"]})
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_INDEX_ARROW)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX_ARROW)

    return run


def parsed_length(head: bytes) -> int:
    """Content-Length of a record's header block."""
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return int(value)
    raise ValueError("a record without Content-Length")


def index_archives(archives: DataFrame, cfg: Warc = Warc()) -> DataFrame:
    """The index of archives that were written elsewhere (column archive: their paths), plain or a gzip member a record.

    An archive is one task, as only its start is known to be the start of a record; many are read at once.
    """
    n = max(1, archives.count())
    return archives.select("archive").repartition(n, "archive").mapInArrow(_scan(cfg.read_bytes), INDEX)


def page_report(spark: SparkSession, pages: DataFrame, cfg: Warc = Warc()) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, from its record as it was read back.

    Size and digest are those of the bytes in the archive, for a revisit those of the response that has its payload.  See
    ``write_archives`` for nulls, repeated rows and empty tables.
    """
    scratch = Scratch(spark, "warc-pages")
    index = write_archives(spark, pages, scratch.path("archives"), cfg)
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="5000"):
        found = read_records(index, cfg).select(
            F.expr("try_cast(regexp_extract(record_id, '^urn:page:(-?[0-9]+)$', 1) as long)").alias("page_id"), "record_type", "declared_digest",
            F.expr("try_cast(regexp_extract(refers_to_id, '^urn:page:(-?[0-9]+)$', 1) as long)").alias("refers_to"),
            F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).alias("bytes"),
            F.when(F.col("record_type") == "response", F.sha2("payload", 256)).alias("digest"),
        )
        found = scratch.keep(found, "records")
    revisits = found.where("record_type = 'revisit'").select("page_id", "refers_to", "declared_digest")
    # The responses that are revisited, one for each digest; both sides are tables, so that a hot digest can be split.
    held = scratch.keep(found.where("record_type = 'response'").join(revisits.select(F.col("declared_digest").alias("digest")).distinct(), "digest", "left_semi").groupBy("digest").agg(F.max("bytes").alias("bytes")), "held")
    again = revisits.join(held, F.col("declared_digest") == F.col("digest")).select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    first = found.where("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(again)


#: DuckDB twin of op12_warc.
ORACLE = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END::BIGINT AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
