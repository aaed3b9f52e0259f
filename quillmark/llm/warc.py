"""WARC archives: revisit resolution by payload digest, writing, and reading back.

Headers are shuffled by payload digest; of equal payloads long enough, the record with the
smallest id stays the response and the others become revisits that name it. Archives are
gzip members, one per record, so that a record can be read from its offset. A revisit has no
payload of its own; its headers carry the full payload's digest and length.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import committed, dealt, new_place, opened, scratch, small_batches, table, written

#: Shorter payloads are always written in full.
MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 256 << 20
#: A payload shared by many records meets its original in so many places.
SALTS = 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_uri(record_id: int | None, place: str = "") -> str:
    """The name of a record; ``place`` tells apart those whose id is null or repeats."""
    return uuid.uuid5(_IDS, f"record:{record_id}{place}").urn


def resolve_revisits(records: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``records`` (record_id, uri, payload binary) with payload_bytes, payload_digest,
    record_type, refers_to, and what archives need besides: original_uri, own_name and
    original_named (the record's, or its original's, id names one record).

    Headers are written to shared storage and shuffled by digest, payloads are not: the tables
    joined to them have a known size, so small ones are broadcast. Only digests of several
    records, and ids that repeat, are in them; a digest is there once per salt.

    Rows that repeat the smallest id are all responses; a record with a null id is a response,
    and never an original. A null payload is empty. An empty table gives no rows. A payload is
    hashed whole, whatever its length. Other columns stay as they are, but for those named here.
    """
    hashed = records.withColumn("payload", F.coalesce("payload", F.lit(b"")))
    hashed = hashed.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    with scratch(records.sparkSession) as keep:
        repeats, originals = _repeats_and_originals(written(hashed.select("record_id", "uri", "payload_bytes", "payload_digest"), "warc-headers"), min_bytes)
        repeats, originals = keep(repeats), keep(originals)
    originals = originals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = hashed.withColumn("_salt", F.pmod(F.xxhash64("record_id", "uri"), F.lit(SALTS)).cast("int"))
    joined = salted.join(originals, ["payload_digest", "_salt"], "left").join(repeats.withColumn("own_name", F.lit(False)), "record_id", "left")
    revisit = F.col("record_id") > F.col("_original")  # null without an original
    return joined.withColumns(
        {
            "record_type": F.when(revisit, "revisit").otherwise("response"),
            "refers_to": F.when(revisit, F.col("_original")),
            "own_name": F.coalesce("own_name", F.col("record_id").isNotNull()),
            "payload": F.when(F.coalesce(revisit, F.lit(False)), F.lit(b"")).otherwise(F.col("payload")),
        }
    ).drop("_salt", "_original")


def _repeats_and_originals(headers: DataFrame, min_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Ids of several records; and payload_digest, _original, original_uri, original_named of
    digests of several records."""
    repeats = headers.where("record_id is not null").groupBy("record_id").count().where("count > 1").select("record_id")
    repeats = written(repeats, "warc-repeated-ids")
    first = F.min(F.when(F.col("record_id").isNotNull(), F.struct("record_id", "uri")))
    originals = headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(first.alias("o"), F.count("*").alias("n"))
    originals = originals.where("n > 1 and o is not null").select("payload_digest", F.col("o.record_id").alias("_original"), F.col("o.uri").alias("original_uri"))
    named = repeats.select(F.col("record_id").alias("_original"), F.lit(False).alias("original_named"))
    originals = originals.join(named, "_original", "left").withColumn("original_named", F.coalesce("original_named", F.lit(True)))
    return repeats, written(originals, "warc-originals")


def _header(value: str | None) -> str:
    return " ".join((value or "").split())


def record_bytes(row: dict, date: str, place: str = "") -> bytes:
    """One record, uncompressed: fresh headers, then the block. ``place`` is the record's own
    among all archives; it goes into the name of a record that its id doesn't name."""
    revisit = row["record_type"] == "revisit"
    block = b"" if revisit else row["payload"]
    head = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<{record_uri(row['record_id'], '' if row['own_name'] else f' {place}')}>",
        "WARC-Date": date,
        "WARC-Target-URI": _header(row["uri"]),
        "WARC-Payload-Digest": f"sha256:{row['payload_digest']}",
        "WARC-Payload-Length": row["payload_bytes"],
        "X-Record-Key": "" if row["record_id"] is None else row["record_id"],
        "Content-Type": "application/octet-stream",
    }
    if revisit:
        head |= {
            "WARC-Profile": PROFILE,
            "WARC-Refers-To-Target-URI": _header(row["original_uri"]),
            "X-Refers-To-Key": row["refers_to"],
        }
        if row["original_named"]:  # several records of one id: any may be meant
            head["WARC-Refers-To"] = f"<{record_uri(row['refers_to'])}>"
    else:
        head["WARC-Block-Digest"] = f"sha256:{row['payload_digest']}"
    head["Content-Length"] = len(block)
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(file) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    z, out, rest = zlib.decompressobj(31), io.BytesIO(), b""
    while True:
        if not rest and not (rest := file.read(1 << 20)):
            if out.tell():
                raise EOFError("the archive ends inside a record")
            return
        out.write(z.decompress(rest))
        rest = b""
        if z.eof:
            rest = z.unused_data
            yield out.getvalue()
            z, out = zlib.decompressobj(31), io.BytesIO()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    return fields, rest[: int(fields["Content-Length"])]


def write_archives(resolved: DataFrame, date: str = "2000-01-01T00:00:00Z", place: str | None = None) -> DataFrame:
    """Write what ``resolve_revisits`` made; the table of archives (part, seq, uri, n_records).

    A task streams its records and starts a new archive at ``ARCHIVE_BYTES``. Only archives
    of tasks that Spark committed are in the table.
    """
    place = place or new_place(resolved.sparkSession, "warc")

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        source = (row for batch in rows for row in batch.to_pylist())
        row = next(source, None)
        while row is not None:
            uri = f"{place}/{part:08d}-{seq:06d}-{TaskContext.get().taskAttemptId()}.warc.gz"
            n = size = 0
            with committed(uri) as out:
                while row is not None and size < ARCHIVE_BYTES:
                    data = _member(record_bytes(row, date, f"{part}-{seq}-{n}"))
                    out.write(data)
                    n, size, row = n + 1, size + len(data), next(source, None)
            yield pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "uri": [uri], "n_records": [n]})
            seq += 1

    columns = ["record_id", "uri", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "original_uri", "own_name", "original_named"]
    return written(small_batches(resolved.select(*columns)).mapInArrow(write, "part long, seq long, uri string, n_records long"), "warc-archives")


_READ = "record_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the archives, with its payload if asked for. The digest and the
    length of a response are taken from its block and must agree with its headers."""
    schema = _READ + (", payload binary" if payloads else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for listed in rows:
            for uri in listed.column(0).to_pylist():
                fs, path = opened(uri)
                with fs.open_input_stream(path, compression=None) as f:
                    for data in members(f):
                        head, block = parse_record(data)
                        digest, n = head["WARC-Payload-Digest"].partition(":")[2], int(head["WARC-Payload-Length"])
                        if head["WARC-Type"] == "response" and (len(block) != n or hashlib.sha256(block).hexdigest() != digest):
                            raise ValueError("a record's payload differs from its headers")
                        key, other = head.get("X-Record-Key"), head.get("X-Refers-To-Key")
                        row = (int(key) if key else None, head["WARC-Target-URI"], head["WARC-Type"], n, digest, int(other) if other else None)
                        out.append((*row, block if head["WARC-Type"] == "response" else None) if payloads else row)
                        size += len(block) if payloads else 0
                        if len(out) >= 8192 or size > 16 << 20:
                            yield batch()
                            out, size = [], 0
        if out:
            yield batch()

    n = max(1, min(archives.count(), 20_000))
    return archives.select("uri").repartition(n).mapInArrow(read, schema)


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = dealt(table(spark, sf_dir, "pages"))
    records = pages.select(F.col("page_id").alias("record_id"), F.col("url").alias("uri"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    back = read_archives(write_archives(resolve_revisits(records)))
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to FROM o
"""
