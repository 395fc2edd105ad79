"""WARC archives (operator 12): an index first, then coalesced byte-range reads.

``write_archives`` writes a gzip member per record (so any record can be read alone) into archive
files of the shared folder, and an index table with file, offset, length, url and digest
of each record. ``read_records`` takes the rows of the index that a caller selects,
groups them by file and span of ``SPAN`` bytes, sorts each group by offset, joins ranges that lie
within ``GAP`` bytes of each other into one read, and parses the records. It never
scans an archive, and a file of any size is spread over as many tasks as it has spans.

Of records with equal payloads of ``LEAST_BYTES`` or more, the one with the smallest page_id
is a response, the others are revisits that carry its id and the HTTP headers (with
the payload's length) but no payload. Shorter payloads are always responses. Payload digests
with at least 1 / ``HEAVY`` of all pages (at most ``HEAVY`` of them) meet their pages in a
broadcast join and leave the shuffle join of the others, so a payload with a third of all
pages burdens no task.

Files are named by attempt and known through the committed index only, so a task that is
run again leaves no record twice. Every response's digest is checked when it is read.

Defined cases: null html is an empty payload; a null url has no target header; control characters
of a url are percent-encoded in the header (the index keeps the url as it is); a null page_id
comes after all others, is written as no number, and is a revisit where an equal payload has an id; rows
that repeat the page_id of their group's response are responses too; an empty
table gives no files and no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.session import shared_path

from .common import file_system, qualified, saved, ship, table

LEAST_BYTES, HEAVY = 100, 1000
SPAN, GAP, FILE_BYTES, READ_BYTES = 8 << 20, 64 << 10, 1 << 30, 64 << 20
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of their capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _member(fields: list[tuple[str, str | None]], block: bytes, level: int) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    raw = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def _uri(url: str | None) -> str | None:
    return url and "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: dict | None,
           date: str = DATE, level: int = 6) -> bytes:
    """A page's record; ``first`` (page_id, url) is the response that it revisits, if any."""
    fields = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date),
              ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("Content-Type", "application/http; msgtype=response")]
    if first:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(first["page_id"])),
                   ("WARC-Refers-To-Target-URI", _uri(first["url"])), ("WARC-Refers-To-Date", date)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return _member(fields, http.encode() + (b"" if first else payload), level)


def parse(member: bytes) -> dict:
    """The fields of a record's gzip member: WARC fields by name, ``http`` fields by name, and ``payload``."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http"] = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    fields["payload"] = payload
    return fields


def with_first(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``page_id, url, payload, digest, first`` of every row of ``pages`` (page_id, url, html); ``first``
    (page_id, url) is the response that the row revisits, else null."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    groups = saved(pages.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.when(F.length("payload") >= least_bytes, order)).alias("first"))
                   .where("n > 1 AND first.page_id IS NOT NULL").select("digest", "n", "first.page_id", "first.url")
                   .withColumn("first", F.struct("page_id", "url")).select("digest", "n", "first"), "op12-groups")
    total = pages.count()
    heavy = groups.where(F.col("n") * HEAVY >= total).select("digest", F.col("first").alias("heavy"))  # HEAVY rows at most
    light = groups.where(F.col("n") * HEAVY < total).select(F.col("digest").alias("key"), F.col("first").alias("light"))
    # a heavy page has no part in the second join: its key spreads it by its id
    own = F.when(F.col("heavy").isNull(), F.col("digest")).otherwise(F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), "url", F.lit(""))))
    both = pages.join(F.broadcast(heavy), "digest", "left").withColumn("key", own).join(light, "key", "left")
    first = F.coalesce("heavy", "light")
    return both.select("page_id", "url", "payload", "digest",
                       F.when(~F.col("page_id").eqNullSafe(first["page_id"]), first).alias("first"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, date: str = DATE, level: int = 6,
                   file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under ``folder``; returns their index (``INDEX``)."""
    ship(pages.sparkSession)
    fs, at = file_system(folder)
    fs.create_dir(at, recursive=True)
    info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:info>"), ("WARC-Date", date),
                    ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level)

    def run(batches):
        import pyarrow as pa
        fs, at = file_system(folder)
        out, name, where = None, None, 0
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()),
                            ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            index = []
            for page_id, url, payload, digest, first in zip(*(c.to_pylist() if c.type != pa.binary() else c for c in b.columns)):
                if out is None or where >= file_bytes:
                    if out is not None:
                        out.close()
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                    out.write(info)
                    where = len(info)
                packed = record(page_id, url, payload.as_py(), digest, first, date, level)
                out.write(packed)
                index.append((f"{folder}/{name}", where, len(packed), page_id, url, digest,
                              "revisit" if first else "response", first and first["page_id"]))
                where += len(packed)
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index), schema)], schema=schema)
        if out is not None:
            out.close()
    return saved(with_first(pages, least_bytes).mapInArrow(run, INDEX), "op12-index")


def _page(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def _reads(places: list[tuple[int, int]], gap: int) -> list[list[tuple[int, int]]]:
    """Sorted (offset, length) places in runs to be read at once."""
    runs: list[list[tuple[int, int]]] = []
    for offset, length in places:
        if runs and offset - sum(runs[-1][-1]) <= gap:
            runs[-1].append((offset, length))
        else:
            runs.append([(offset, length)])
    return runs


def read_records(selected: DataFrame, payloads: bool = True, span: int = SPAN, gap: int = GAP,
                 read_bytes: int = READ_BYTES) -> DataFrame:
    """``RECORDS`` of the selected rows of an index, parsed from the archives (revisits have no
    payload; with ``payloads`` false none has). Rows selected twice are read once."""
    spark = selected.sparkSession
    ship(spark)
    todo = selected.select("file", F.expr(f"offset div {span}").alias("part"), "offset", "length").distinct()
    todo = saved(todo.groupBy("file", "part").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places"),
                                                  F.sum("length").alias("bytes")), "op12-reads")
    size = todo.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    # so many tasks by name, or they would be taken together by the size of this small table
    tasks = max(1, min(size.n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size.bytes or 0) // read_bytes)))

    def run(batches):
        import pyarrow as pa
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for b in batches:
            for file, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, at = file_system(file)
                with fs.open_input_file(at) as archive:
                    for places in _reads([(p["offset"], p["length"]) for p in places], gap):
                        start = places[0][0]
                        data = archive.read_at(sum(places[-1]) - start, start)
                        for offset, length in places:
                            r = parse(data[offset - start:offset - start + length])
                            digest = r["WARC-Payload-Digest"].removeprefix("sha256:")
                            kind, payload = r["WARC-Type"], r["payload"] if r["WARC-Type"] == "response" else None
                            if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{file} at {offset}: the payload is not the one that was written")
                            rows.append((_page(r["WARC-Record-ID"]), r.get("WARC-Target-URI"), kind,
                                         _page(r["WARC-Refers-To"]) if kind == "revisit" else None,
                                         int(r["http"]["Content-Length"]), digest, payload if payloads else None))
                            held += len(payload or b"") + 500
                            if held > 16 << 20:
                                yield batch()
                                rows, held = [], 0
        if rows:
            yield batch()
    return todo.select("file", "places").repartition(tasks, "file", "places").mapInArrow(run, RECORDS)


def read_payloads(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """``page_id, payload`` of the pages of ``wanted`` (page_id) by an index: a revisit's payload is read
    from its response, each response once."""
    at = index.join(wanted.select("page_id").distinct(), "page_id", "left_semi")
    at = at.select("page_id", F.coalesce("refers_to", "page_id").alias("holder"))
    holders = index.where("record_type = 'response'").join(at.select(F.col("holder").alias("page_id")).distinct(), "page_id", "left_semi")
    found = read_records(holders).select(F.col("page_id").alias("holder"), "payload")
    return at.join(found, "holder").select("page_id", "payload")


def write_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    folder = qualified(spark, shared_path(spark, "op12-archives"))
    return read_records(write_archives(pages, folder), payloads=False).drop("payload", "url")


def op12_warc(spark, sf_dir):
    """Payload size, digest and type of every page's record, as read back from the archives."""
    return write_and_read(spark, table(spark, sf_dir, "pages"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f"""
