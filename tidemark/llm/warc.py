"""WARC archives with a Zstandard dictionary, written and read back.

Each archive begins with a skippable frame that holds the dictionary; every record after it is a Zstandard frame of its own,
compressed with that dictionary, so records can be cut out and archives can be joined.  The dictionary is built from the
records themselves: at most ``sample_records`` pages (those of least hash of id and url, one for each pair), of at most
``sample_bytes`` each.  A share of the hashes is filtered before the sample is taken, so what all tasks together send to the
driver is a few times the sample, however many there are.

Of records with equal payloads of at least ``min_revisit`` bytes, the one with the largest page id is a response and the
others revisit it.  Only digests and ids are grouped and joined by digest; a payload is never gathered with its copies.  Page
ids are numbers; one that is not is an error.

A null html is an empty payload, a null url is written as an empty target, repeated rows are archived each (ties: rows of the
largest id are all responses), null page ids are never the record that others revisit while another id is known.  An empty
table gives no archive and no rows.  A record of more than ``archive_bytes`` is an archive of its own; it is held whole by one
task.  Input columns other than id, url and html are not read, whatever their names.

Archives go to a folder that driver and executors share.  Every attempt of a task writes under names of its own, and the
manifest, a table written by Spark, names the archives of the attempts that were committed; readers go by the manifest, so
archives of a lost or doubled attempt are never read.  They stay as files that no manifest names until the folder is deleted.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import urllib.parse

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.worker_files import filesystem as _store
from .common import BROADCAST_ROWS, Scratch, tune

# Fixed values of the formats.
SKIPPABLE_DICTIONARY = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A field of our own: the target's bytes, where the target is quoted.
ORIGINAL = "WARC-Target-Original"
MIN_REVISIT = 1000
ARCHIVE_BYTES = 12 << 20
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1200, 16_384, 65_536
FIELDS = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


# ---------------------------------------------------------------- records


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(uri: str | None):
    number = (uri or "").strip("<>").rpartition(":")[2]
    return int(number) if number else None


def target_of(headers: dict[str, str]) -> str:
    original = headers.get(ORIGINAL.lower())
    return headers["warc-target-uri"] if original is None else base64.b64decode(original).decode()


def _header(lines: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode()


def make_record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """The bytes of a response record, or of a revisit record (headers alone) if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quoted := urllib.parse.quote(url or "", safe="%:/?#[]@!$&'()*+,;=~-._")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if quoted != (url or ""):  # a URI is read back byte for byte, whatever had to be quoted in it
        lines.insert(4, (ORIGINAL, base64.b64encode(url.encode()).decode()))
    if refers_to is not None:
        lines[2:2] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    return _header(lines) + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the records' own bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:] or b"WARC/1.1\r\n"


class ArchiveWriter:
    def __init__(self, out, dictionary: bytes, date: str, level: int = 3):
        kind = zstandard.DICT_TYPE_AUTO
        self.press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=kind), write_checksum=True)
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
        self.out, self.records = out, 0
        self.size = out.write(struct.pack("<II", SKIPPABLE_DICTIONARY, len(packed)) + packed)
        info = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
        self.add(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None)), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]) + info + b"\r\n\r\n")

    def add(self, record: bytes) -> None:
        self.size += self.out.write(self.press.compress(record))
        self.records += 1


def read_archive(raw: bytes):
    """(headers, block) of every record; the dictionary is taken from the leading frame."""
    magic, size = struct.unpack_from("<II", raw)
    if magic != SKIPPABLE_DICTIONARY:
        raise ValueError("no dictionary frame")
    dictionary = raw[8 : 8 + size]
    if dictionary[:4] == b"\x28\xb5\x2f\xfd":
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    stream = io.BufferedReader(open_.stream_reader(memoryview(raw)[8 + size :], read_across_frames=True), 1 << 16)
    while True:
        line = stream.readline()
        if not line:
            return
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length or stream.read(4) != b"\r\n\r\n":
            raise ValueError("record cut short")
        yield headers, block


# ---------------------------------------------------------------- files


def plan_records(pages: DataFrame, scratch: Scratch, *, id_col: str, url_col: str, html_col: str, min_revisit: int) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses).

    Digests that several rows share are found by ids and digests alone.  Up to ``BROADCAST_ROWS`` of them (counted) go to every
    task, and payloads do not travel at all; beyond that, rows that revisit are found by a join of ids and digests, and payloads
    travel by page, url and digest, so that the copies of one page are spread like all others.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "large": F.octet_length("payload") >= min_revisit})
    target = rows.where("large").groupBy(F.col("digest").alias("_digest")).agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 AND _first IS NOT NULL").drop("_n")
    target = scratch.write(target, "targets")
    other = ~F.col("page_id").eqNullSafe(F.col("_first"))
    same = (F.col("digest") == F.col("_digest")) & F.col("large")
    if target.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(target), same, "left").withColumn("refers_to", F.when(other, F.col("_first")))
    else:
        key = F.xxhash64("url")
        light = rows.select("page_id", key.alias("_u"), "digest", "large")
        revisits = light.join(target, same).where(other).select(F.col("page_id").alias("_p"), "_u", "_digest", F.col("_first").alias("refers_to")).distinct()
        joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_p")) & (key == F.col("_u")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.select("page_id", "url", "payload", "digest", "refers_to")


def sample_pages(pages: DataFrame, *, id_col: str, url_col: str, html_col: str, records: int, size: int) -> list:
    """At most ``records`` (page_id, url, first ``size`` bytes of the payload)."""
    key = F.xxhash64(F.col(id_col).cast("bigint"), F.col(url_col))
    source = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.substring(F.coalesce(F.col(html_col), F.lit("")), 1, size).alias("html"), key.alias("key"))
    known = source.agg(F.approx_count_distinct("key")).first()[0] or 0  # one number
    share = min(1.0, (2 * records + 100) / max(known, 1))
    few = source.where(F.col("key").cast("double") / 2.0**64 + 0.5 <= share).groupBy("key", "page_id", "url").agg(F.min("html").alias("html"))
    drawn = few.orderBy("key", "page_id", "url").limit(records).collect()
    return [(r["page_id"], r["url"], (r["html"] or "").encode()[:size]) for r in drawn]


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, sample_records: int = SAMPLE_RECORDS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Writes archives to ``folder``; returns the manifest (archive, records, bytes), also kept as ``folder``/manifest."""
    spark = pages.sparkSession
    scratch = Scratch(spark)
    records = plan_records(pages, scratch, id_col=id_col, url_col=url_col, html_col=html_col, min_revisit=min_revisit)
    drawn = sample_pages(pages, id_col=id_col, url_col=url_col, html_col=html_col, records=sample_records, size=sample_bytes)
    dictionary = build_dictionary([make_record(p, u, b, hashlib.sha1(b).hexdigest(), None, date) for p, u, b in drawn])
    shared = spark.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES
    fs, root = _store(folder)
    fs.create_dir(root, recursive=True)

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, root = _store(folder)
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        writer, sink, done = None, None, []

        def close():
            nonlocal writer
            sink.close()
            done.append((f"{name}-{len(done):04d}.warc.zst", writer.records - 1, writer.size))
            writer = None

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    sink = fs.open_output_stream(f"{root}/{name}-{len(done):04d}.warc.zst", compression=None)
                    writer = ArchiveWriter(sink, shared.value, date)
                writer.add(make_record(page_id, url, payload, digest, refers_to, date))
                if writer.size >= archive_bytes:
                    close()
        if writer is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done]) for k in range(3)], names=["archive", "records", "bytes"])

    tune(spark)
    manifest = f"{folder.rstrip('/')}/manifest"
    records.mapInArrow(run, "archive string, records bigint, bytes bigint").write.mode("overwrite").parquet(manifest)
    scratch.close()
    return spark.read.parquet(manifest)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per response or revisit record; a response whose payload does not match its digest is an error."""

    def run(batches):
        fs, root = _store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{name}") as source:
                    raw = source.read()  # about archive_bytes, or one record
                rows, size = [], 0
                for headers, block in read_archive(raw):
                    if headers["warc-type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                    digest = base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex()
                    response = headers["warc-type"] == "response"
                    if response and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
                    rows.append((page_of(headers["warc-record-id"]), target_of(headers), headers["warc-type"], length, digest, page_of(headers.get("warc-refers-to")), payload if response else None))
                    size += len(payload)
                    if size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    spark = manifest.sparkSession
    tune(spark)
    return manifest.select("archive").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "archive").mapInArrow(run, FIELDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write the pages to a folder beside the session's shared tables, and read the archives back."""
    folder = f"{Scratch(pages.sparkSession).root}/archives"
    return read_archives(write_archives(pages, folder), folder)
