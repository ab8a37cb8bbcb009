"""WARC archives of pages, index first.

Writing: each task appends records to archives of its own in the shared folder and returns an index
row per record: archive, offset, length, URL, digest.  Each record is a gzip member, so its bytes can
be read alone.  An archive's name holds the attempt's number, so a task that is run again writes
another archive, and the index knows only the one whose task succeeded.

Reading: the selected index rows are sorted by archive and offset, neighbouring byte ranges are
coalesced into one read, and the records are cut out of it.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Bytes after which a task begins another archive.
MAX_ARCHIVE = 256 << 20
#: Bytes between two selected records that are read along rather than skipped; most bytes of one read;
#: bytes of an archive that one reading task gets.
GAP, MAX_READ, SLAB = 64 << 10, 8 << 20, 32 << 20

#: Tasks that read archives, at most; with more slabs than that a task gets several.
MAX_TASKS = 100_000

INDEX = "page_id string, url string, archive string, offset bigint, length bigint, digest string, record_type string, refers_to string"


def _header(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _uri(url: str | None) -> str:
    """A URL as one header value: control characters and spaces are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def _urn(page_id: str | None) -> str:
    return "<urn:nopage>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def _page(urn: str | None) -> str | None:
    return unquote(urn[len("<urn:page:") : -1]) if urn and urn.startswith("<urn:page:") else None


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record; a revisit has the HTTP header of the full payload and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return _header("response", fields, http + payload)
    fields += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return _header("revisit", fields, http)


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, work: Workspace, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """``pages`` (page_id, url, html, ...) -> the index, as a written table.  Ids may be of any type that
    a cast to text and back preserves.

    Null html is an empty payload, a null url about:blank.  Of equal payloads of at least
    ``LEAST_REVISIT`` bytes that of the smallest page_id is the response; rows that repeat that id and
    payload are responses too.  Null ids are never the smallest.
    """
    folder = work.path("archives")
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    sizes = rows.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null").drop("n")
    # The repeated digests grow with the pages, so neither side is broadcast; a digest that many
    # pages share is split between tasks by the adaptive skew join.
    repeated = work.table(sizes, "repeated")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least").cast("string")).alias("refers_to")
    marked = rows.join(repeated.hint("merge"), "digest", "left").select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), "payload", "digest", refers_to)

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        stem = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        part, out, name, at = 0, None, "", 0
        try:
            for batch in batches:
                index = []
                for page_id, url, payload, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    if out is None or at > MAX_ARCHIVE:
                        if out is not None:
                            out.close()
                        name, at, part = f"{stem}-{part:04d}.warc.gz", 0, part + 1
                        out = fs.open_output_stream(posixpath.join(root, name), compression=None)
                        info = _gzip(_header("warcinfo", [("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                        out.write(info)
                        at = len(info)
                    data = _gzip(record(page_id, url, payload, digest, refers_to, date))
                    out.write(data)
                    index.append((page_id, url, name, at, len(data), digest, "response" if refers_to is None else "revisit", refers_to))
                    at += len(data)
                types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                cols = list(zip(*index)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["page_id", "url", "archive", "offset", "length", "digest", "record_type", "refers_to"])
        finally:
            if out is not None:
                out.close()

    index = marked.mapInArrow(run, INDEX)
    return work.table(index.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")}), "index")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def _ranges(rows):
    """Coalesces (archive, offset, length) rows, sorted, into (archive, start, end, members)."""
    held = None
    for archive, offset, length in rows:
        end = offset + length
        if held and held[0] == archive and offset <= held[2] + GAP and end - held[1] <= MAX_READ:
            held[2] = max(held[2], end)
            held[3].append((offset, length))
        else:
            if held:
                yield held
            held = [archive, offset, end, [(offset, length)]]
    if held:
        yield held


def read_records(index: DataFrame, work: Workspace) -> DataFrame:
    """Reads the index's records back: (page_id, url, payload, payload_bytes, payload_digest,
    record_type, refers_to), a row per index row; further columns of the index are ignored, and an empty
    index gives an empty result.  A response's digest is computed from its payload and must be the one in
    its header; a revisit's payload is null, its size and digest are those of the full payload.  Null ids
    come back null, empty and null html as an empty payload, very long ones whole."""
    folder = work.path("archives")
    kind = index.schema["page_id"].dataType.simpleString()
    chosen = index.select("archive", F.floor(F.col("offset") / SLAB).alias("slab"), "offset", "length")
    # An index row is far smaller than its record, so the tasks are counted by slabs of the archives.
    slabs = chosen.select("archive", "slab").distinct().count()
    ordered = chosen.repartition(min(max(slabs, 1), MAX_TASKS), "archive", "slab").sortWithinPartitions("archive", "offset").select("archive", "offset", "length")

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)

        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(3)))

        name, source = None, None
        for archive, start, end, members in _ranges(rows()):
            if archive != name:
                if source is not None:
                    source.close()
                name, source = archive, fs.open_input_file(posixpath.join(root, archive))
            data = source.read_at(end - start, start)
            out = []
            for offset, length in members:
                fields, block = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
                told = fields["warc-payload-digest"].removeprefix("sha256:")
                whole = fields["warc-type"] == "response"
                if whole and (len(payload) != size or hashlib.sha256(payload).hexdigest() != told):
                    raise ValueError(f"{archive} at {offset}: the payload is not the one that was written")
                out.append((_page(fields["warc-record-id"]), fields["warc-target-uri"], payload if whole else None, size, told, fields["warc-type"], _page(fields.get("warc-refers-to"))))
            types = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if source is not None:
            source.close()

    schema = "page_id string, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to string"
    found = ordered.mapInArrow(run, schema)
    return found.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives of ``pages`` (page_id, url, html, ...) and reads every record back through the
    index: the columns and edge cases of ``read_records``, a row per page."""
    work = Workspace(pages.sparkSession, "warc")
    return read_records(write_archives(pages, work), work)


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha256(t) AS payload_digest FROM p),
f AS (SELECT payload_digest AS k, min(page_id) AS m FROM d WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN m < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m < page_id THEN m END AS refers_to
FROM d LEFT JOIN f ON k = payload_digest AND payload_bytes >= {LEAST_REVISIT}
"""
