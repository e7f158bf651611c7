"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own. The reader deals byte ranges to tasks. A task looks for the gzip magic in its
range, takes a position as a member only if it decodes to a WARC header, owns every record that starts inside its range
(and reads on past its end to finish the last one), and skips over what a decoded member covers.

Of pages with equal payloads of at least ``least`` bytes, the one with the largest id is written as a response and the
others revisit it; equality is decided by the SHA-256 of the payload, and the archive carries the SHA-1 in base32.

Cases: null html is an empty payload; a null page id is written as an empty one, never wins over another id, and reads
back as null; rows repeated with the id that wins are one response and otherwise revisits of it; payloads of any length
are read in steps; an empty table writes no archive and reads back empty.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from branchwise.llm.common import filesystem, slices, utf8
from branchwise.session import scratch_path, stored

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES, READ_BYTES = 8 << 20, 1 << 20


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url: str, payload: bytes, refers_to, is_response: bool) -> bytes:
    """One WARC record as a gzip member. A revisit has the headers of its payload and no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if is_response else b"")
    shown = "" if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if is_response else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {shown}",
    ]
    if not is_response:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
            f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def with_roles(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int = 0) -> DataFrame:
    """(page_id, url, html, response, refers_to): what each page is written as."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    ).withColumn("sha", F.sha2(F.encode("html", "UTF-8"), 256))
    groups = rows.where(F.octet_length("html") >= least).groupBy("sha").agg(F.max("page_id").alias("top"))
    # Only rows that carry the winning id can be repeated winners; among those one is the response.
    own = rows.join(groups, "sha", "left")
    small = F.octet_length("html") < least
    is_top = F.col("page_id").eqNullSafe(F.col("top"))
    again = own.where(is_top & ~small).groupBy("sha").agg(F.count(F.lit(1)).alias("tops")).where("tops > 1")
    out = own.join(again, "sha", "left").select(
        "page_id", "url", "html", (small | (is_top & F.col("tops").isNull())).alias("response"), F.col("top").alias("refers_to"),
        F.when(is_top & F.col("tops").isNotNull(), F.col("sha")).alias("tied"),
    )
    clear, tied = out.where("tied is null"), out.where("tied is not null")
    if tied.isEmpty():
        return clear.drop("tied")
    nth = F.row_number().over(Window.partitionBy("tied").orderBy("page_id", "url"))
    return clear.unionByName(tied.withColumn("response", nth == 1)).drop("tied")


def write(roles: DataFrame, folder: str) -> DataFrame:
    """Write archives below ``folder``; returns the written (path, bytes) as a stored table.

    A task writes one file under a name of its own; only files of tasks that succeeded are in the table.
    """
    import pyarrow as pa

    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)

    def run(batches):
        fs, path = filesystem(folder)
        out, size, name = None, 0, f"part-{uuid.uuid4().hex}.warc.gz"
        for b in slices(batches):
            ids, urls, htmls = b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2))
            for page_id, url, html, response, refers_to in zip(ids, urls, htmls, b.column(3).to_pylist(), b.column(4).to_pylist()):
                out = out or fs.open_output_stream(f"{path}/{name}", compression=None)
                data = record(page_id, url, html, refers_to, response)
                out.write(data)
                size += len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size])], ["path", "bytes"])

    return stored(roles.select("page_id", "url", "html", "response", "refers_to").mapInArrow(run, "path string, bytes long"), "warc-files")


def member_at(source, at: int, size: int):
    """(decoded bytes, end) of the gzip member with a WARC record at a position, or None if there is no such member."""
    unpack, parts, head, pos = zlib.decompressobj(31), [], b"", at
    try:
        while not unpack.eof:
            if pos >= size:
                return None
            source.seek(pos)
            chunk = source.read(min(64 << 10 if pos == at else READ_BYTES, size - pos))
            pos += len(chunk)
            parts.append(unpack.decompress(chunk))
            if len(head) < 5:
                head += parts[-1][:16]
                if not b"WARC/".startswith(head[:5]) and not head.startswith(b"WARC/"):
                    return None
    except zlib.error:
        return None
    if not head.startswith(b"WARC/"):
        return None
    return b"".join(parts), pos - len(unpack.unused_data)


def records_in(source, size: int, start: int, stop: int):
    """Decoded records whose members start in [start, stop)."""
    pos = start
    while pos < stop:
        source.seek(pos)
        chunk = source.read(min(READ_BYTES, stop - pos + len(MAGIC) - 1, size - pos))
        hit = chunk.find(MAGIC)
        if hit < 0:
            pos += max(1, len(chunk) - len(MAGIC) + 1)
            continue
        if pos + hit >= stop:
            return
        got = member_at(source, pos + hit, size)
        if got is None:
            pos += hit + 1
        else:
            pos = got[1]
            yield got[0]


def parse(data: bytes) -> tuple:
    """(page_id, url, record type, payload bytes, payload digest, refers_to, payload or None) of one decoded record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.partition(": ")[::2] for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    number = lambda k: int(fields[k]) if fields.get(k, "").strip() else None
    if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a record's payload does not match its digest")
    return number("X-Page-Id"), fields["WARC-Target-URI"], kind, length, digest, number("X-Refers-To-Page-Id"), payload if kind == "response" else None


def read(files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = False) -> DataFrame:
    """Records of (path, bytes) archives, one task per byte range."""
    import pyarrow as pa

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in schema.split(", ")]
    step = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))
    # One row a file tells how many ranges there are; with that number given, no ranges are merged into one task.
    n = files.where("bytes > 0").agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0]
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(step).alias("start")).repartition(int(n or 1))

    def run(batches):
        for b in batches:
            for path, size, start in zip(*[c.to_pylist() for c in b.columns]):
                fs, p = filesystem(path)
                rows, held = [], 0
                with fs.open_input_file(p) as source:
                    for data in records_in(source, size, start, min(size, start + range_bytes)):
                        row = parse(data)
                        rows.append(row if payloads else (*row[:6], None))
                        held += len(data) if payloads else 1000
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return ranges.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = with_roles(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html")
    return read(write(roles, scratch_path(spark, "warc"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
