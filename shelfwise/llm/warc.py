"""WARC archives with an index: records are found by offset and read in coalesced byte ranges.

Writing returns the index first of all: archive, offset, length, URL and digest of each record, kept
as a table in the shared folder. Reading takes index rows, sorts them by archive and offset, joins
neighbouring ranges into one read and parses the records in it. Archives are gzip files of one
member per record, so each range can be read alone. Each task attempt writes archives of its own;
only those that the index names are ever read, so a lost executor leaves nothing wrong behind.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table
from .files import opened, own_name

#: Payloads from this size on are stored once.
REVISIT_BYTES = 100
#: An archive is closed once it has this size.
ARCHIVE_BYTES = 256 << 20
#: Ranges closer than the gap are read together, up to so many bytes at a time.
GAP_BYTES, READ_BYTES = 64 << 10, 4 << 20

DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id long, url string, digest string, archive string, offset long, length long, record_type string, refers_to long"


def record_id(page_id, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}').urn}>"


def record(page_id, url, payload: bytes, digest: str, record_type: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit has the response's HTTP head but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if record_type == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-Id: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row to archives below ``folder``; returns the index, a table there.

    Null payloads count as empty. Of equal payloads of REVISIT_BYTES or more the one with the
    smallest id is a response and the others are revisits of it; rows that repeat that smallest id
    are responses too. Null ids come after all others. An empty table gives an empty index.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("html"), F.sha2(payload, 256).alias("digest"))
    several = rows.filter(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # a table of known size: Spark broadcasts it where it is small, else splits hot payloads' rows
    rows = rows.join(materialize(several, "payloads"), "digest", "left")
    revisit = F.col("digest").isNotNull() & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.select("page_id", "url", "html", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first_id")).alias("refers_to"))

    def write(batches):
        fs, path = opened(folder)
        fs.create_dir(path, recursive=True)
        number, out, at = 0, None, 0
        for batch in batches:
            names, offsets, lengths = [], [], []
            columns = [c.to_pylist() for c in batch.columns]
            kinds = ["revisit" if x else "response" for x in columns[4]]
            for page_id, url, html, digest, kind, refers in zip(*columns[:4], kinds, columns[5]):
                if out is None:
                    name, number, at = own_name("pages", number, ".warc.gz"), number + 1, 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                data = zlib.compress(record(page_id, url, html.encode(), digest, kind, refers), 3, wbits=31)
                out.write(data)
                names.append(name)
                offsets.append(at)
                lengths.append(len(data))
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(kinds, pa.string()), batch.column(5)], [x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    return materialize(rows.mapInArrow(write, INDEX), "warc-index")


def ranges(spans: list[tuple[str, int, int]]):
    """Join sorted (archive, offset, length) spans: yields (archive, start, end, members)."""
    run: list = []
    for i, (archive, offset, length) in enumerate(spans):
        if run and (archive != run[0] or offset > run[2] + GAP_BYTES or offset + length - run[1] > READ_BYTES):
            yield tuple(run)
            run = []
        if not run:
            run = [archive, offset, offset + length, []]
        run[2] = max(run[2], offset + length)
        run[3].append(i)
    if run:
        yield tuple(run)


def read_records(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records that the index rows name, read from the archives.

    Payloads are checked against their digests; one that differs fails the job. A revisit's size and
    digest are those of the full payload, from its headers; its payload column is null.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def read(batches):
        fs, path = opened(folder)
        name, file = None, None
        for batch in batches:
            spans = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            out = []
            for archive, start, end, members in ranges(spans):
                if archive != name:
                    name, file = archive, fs.open_input_file(f"{path}/{archive}")
                file.seek(start)
                data = file.read(end - start)
                for i in members:
                    at = spans[i][1] - start
                    fields, http, payload = parse(zlib.decompress(data[at : at + spans[i][2]], wbits=31))
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
                        raise ValueError(f"{archive} at {spans[i][1]}: the payload differs from its digest")
                    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                    row = [None if page is None else int(page), fields.get("WARC-Target-URI"), int(http["Content-Length"]), digest, kind, None if refers is None else int(refers)]
                    out.append(row + [payload if kind == "response" else None] * payloads)
            if out:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in schema.split(", ")])

    places = index.select("archive", "offset", "length", F.floor(F.col("offset") / READ_BYTES).alias("stretch"))
    spark = index.sparkSession
    # a fixed number: index rows are small, but each stands for a record to be read
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    places = places.repartition(parts, "archive", "stretch").sortWithinPartitions("archive", "offset")
    return places.select("archive", "offset", "length").mapInArrow(read, schema)


def select_payloads(index: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """page_id and payload of the pages whose ids ``wanted`` lists (column page_id); revisits resolved."""
    found = index.join(wanted.select("page_id").distinct(), "page_id", "left_semi")
    source = found.select("page_id", F.coalesce("refers_to", "page_id").alias("source_id")).distinct()
    records = index.filter("record_type = 'response'").join(source.select(F.col("source_id").alias("page_id")).distinct(), "page_id", "left_semi")
    data = read_records(records, folder, payloads=True).select(F.col("page_id").alias("source_id"), "payload")
    return source.join(data, "source_id").select("page_id", "payload")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
