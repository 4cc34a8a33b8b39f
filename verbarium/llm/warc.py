"""WARC archives in Zstandard frames with a dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, raw or as a Zstandard frame itself; then follows one
frame for each record. The reader loads the dictionary, decodes frame by frame, and validates version line, mandatory headers,
Content-Length against the block, the record's closing blank lines, and block and payload digests.

Archives lie in a shared folder. The rows of a task are sorted and rolled over at a fixed size, so a task that runs again after the loss
of an executor writes the same bytes under the same names; each file is written aside and then renamed.

Defined cases: null html is an empty payload; a null url becomes `urn:page:<id>`; a null page_id is left without one (the record then
refers by digest) and sorts last; of rows that repeat page_id and payload one is the response and the rest revisit it; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_dir, small_batches, stage

SKIPPABLE = 0x184D2A5D
ZSTD = b"\x28\xb5\x2f\xfd"
MIN_PAYLOAD = 100
#: Bytes of frames after which the next archive begins; an archive is read as one value.
ROLL = 16 << 20
#: The dictionary is trained on payloads of about this many pages, a bounded sample picked by hash; of each this many characters.
SAMPLE_PAGES, SAMPLE_CHARS, DICT_BYTES = 400, 8000, 32 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record that breaks the format."""


# -- records -----------------------------------------------------------------------------------------------------------------------


def record_id(page_id: int | None, copy: int) -> str:
    """A UUID from page and copy number: the record of a page is found without a table."""
    h = hashlib.sha256(f"{page_id}:{copy}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-4{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def build_record(page_id: int | None, copy: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"urn:page:{page_id}"
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, copy)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, 1))]
        if refers_to is not None:
            head.append(("X-Refers-To-Page-ID", str(refers_to)))
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, what: str) -> tuple[str, dict[str, str], bytes]:
    head, mark, rest = data.partition(b"\r\n\r\n")
    if not mark:
        raise WarcError(f"{what}: no end of headers")
    first, *lines = head.decode("utf-8").split("\r\n")
    out: dict[str, str] = {}
    for line in lines:
        k, colon, v = line.partition(":")
        if not colon or not k.strip():
            raise WarcError(f"{what}: bad header line {line[:80]!r}")
        out[k.strip().lower()] = v.strip()
    return first, out, rest


def parse_record(data: bytes) -> dict:
    """The fields of one record; raises WarcError unless its headers, lengths and digests hold."""
    version, head, rest = _headers(data, "record")
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"bad version line {version[:40]!r}")
    if missing := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if not head.get(k)]:
        raise WarcError(f"missing headers: {missing}")
    if not head["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    n = int(head["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {n} does not match a block of {len(rest) - 4} bytes")
    block = rest[:n]
    if (d := head.get("warc-block-digest")) and d != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise WarcError("block digest differs")
    kind = head["warc-type"]
    status, http, payload = _headers(block, "block")
    if not status.startswith("HTTP/"):
        raise WarcError("block has no HTTP status line")
    declared = int(http.get("content-length", -1))
    digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response":
        if declared != len(payload):
            raise WarcError("HTTP Content-Length differs from the payload")
        if digest != hashlib.sha256(payload).hexdigest():
            raise WarcError("payload digest differs")
    elif kind == "revisit":
        if payload or not head.get("warc-refers-to") or not head.get("warc-profile"):
            raise WarcError("a revisit needs a profile, a record it refers to, and no payload")
    else:
        raise WarcError(f"record type {kind!r}")
    page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
    return {
        "page_id": int(page) if page else None, "record_type": kind, "payload_bytes": declared, "payload_digest": digest, "refers_to": int(refers) if refers else None,
        "target_uri": head.get("warc-target-uri"), "record_id": head["warc-record-id"], "payload": payload if kind == "response" else None,
    }


# -- archives ----------------------------------------------------------------------------------------------------------------------


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary) if dictionary else b""
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def read_dictionary(data: bytes) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame and where the frames begin; an archive may also go without."""
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        (n,) = struct.unpack_from("<I", data, 4)
        if len(data) < 8 + n:
            raise WarcError("the dictionary frame is cut short")
        raw = data[8 : 8 + n]
        if raw.startswith(ZSTD):
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=64 << 20)
        return (zstandard.ZstdCompressionDict(raw) if raw else None), 8 + n
    return None, 0


def read_frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one for each frame, one at a time."""
    dictionary, at = read_dictionary(data)
    view = memoryview(data)
    engine = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        if data[at : at + 4] != ZSTD:
            raise WarcError(f"no frame at byte {at}")
        step = engine.decompressobj()
        try:
            out = [step.decompress(view[at : at + (1 << 16)])]
            at += 1 << 16
            while not step.eof:
                if at >= len(data):
                    raise WarcError("the last frame is cut short")
                out.append(step.decompress(view[at : at + (1 << 20)]))
                at += 1 << 20
        except zstandard.ZstdError as e:
            raise WarcError(str(e)) from e
        at = min(at, len(data)) - len(step.unused_data)
        yield b"".join(out)


def train(samples: list[bytes]) -> bytes:
    """A dictionary, or none where the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


# -- DataFrames --------------------------------------------------------------------------------------------------------------------


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, first_id, shared, copy: what each page's record depends on.

    Which digests are shared, and from which page on, is found on digests alone: they are grouped with a combiner, and a payload that a
    third of all pages share is one row of the grouped side of a join that Spark may split. The html is shuffled once, by page and digest,
    where rows that repeat a page are numbered.
    """
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("key")
    rows = pages.select(key, "page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    slim = rows.where(F.octet_length("html") >= MIN_PAYLOAD).select("key", "page_id", "digest")
    order = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("b"))
    first = slim.groupBy("digest").agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1").select("digest", F.col("o.b").alias("first_id"))
    shared = slim.join(first, "digest").select("key", "digest", "first_id", F.lit(True).alias("shared")).distinct()
    joined = rows.hint("merge").join(shared, ["key", "digest"], "left")
    copies = Window.partitionBy("key", "digest").orderBy("url")
    return joined.select("page_id", "url", "html", "digest", "first_id", F.coalesce("shared", F.lit(False)).alias("shared"), F.row_number().over(copies).alias("copy"))


def write_archives(records: DataFrame, path: str, dictionary: bytes, roll: int = ROLL) -> DataFrame:
    """Write the rows of plan_records() as archives `shard-*.warc.zst` below `path` (any URI that pyarrow knows); a row for each file.
    The rows of a task come sorted, so a task that runs again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        engine = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
        lead, frames, size, number = dictionary_frame(dictionary), [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal frames, size, number
            name = f"shard-{context.partitionId():06d}-{number:04d}.warc.zst"
            aside = f"{root}/.{name}.{context.taskAttemptId()}"
            with fs.open_output_stream(aside) as f:
                f.write(lead)
                for x in frames:
                    f.write(x)
            fs.move(aside, f"{root}/{name}")
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(frames)], pa.int64()), pa.array([len(lead) + size], pa.int64())], ["file", "records", "bytes"])
            frames, size, number = [], 0, number + 1
            return out

        for batch in batches:
            for r in batch.to_pylist():
                revisit = r["shared"] and (r["page_id"] != r["first_id"] or r["copy"] > 1)
                frames.append(engine.compress(build_record(r["page_id"], r["copy"], r["url"], r["html"].encode(), r["digest"], r["first_id"] if revisit else None, revisit)))
                size += len(frames[-1])
                if size >= roll:
                    yield close()
        if frames:
            yield close()

    return records.mapInArrow(run, "file string, records long, bytes long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives below `path`, validated: page_id, record_type, payload_bytes, payload_digest, refers_to,
    target_uri, record_id, payload (null for revisits). Files come through Spark's reader, from any store that it knows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a row is an archive
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.warc.zst").load(path).select("content")
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("record_id", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column("content"):
                rows = []
                for frame in read_frames(cell.as_buffer().to_pybytes()):
                    rows.append(parse_record(frame))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(run, "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, target_uri string, record_id string, payload binary")


def archive_pages(pages: DataFrame, path: str) -> DataFrame:
    """Write all pages as archives below `path`; the files written: file, records, bytes."""
    small_batches(pages.sparkSession)
    total = max(1, pages.count())
    picked = pages.where("html is not null").where(F.pmod(F.xxhash64("page_id", "url"), F.lit(total)) < 2 * SAMPLE_PAGES)
    sample = picked.select(F.substring("html", 1, SAMPLE_CHARS).alias("h")).limit(SAMPLE_PAGES)
    dictionary = train([r.h.encode() for r in sample.collect()])
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    return stage(write_archives(plan_records(pages), path, dictionary), "warc-files")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "warc")
    archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
}
