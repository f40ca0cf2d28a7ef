"""WARC archives with a Zstandard dictionary, and their reading.

A dictionary is trained on a bounded sample of the records. Every task writes archives of its own:
a leading skippable frame holds the dictionary, then each record is one frame compressed with it, so
a record can be read alone. Pages with equal payloads become one response and revisits of it.

Archives go below the shared folder through a file-system library, under names that hold the task
attempt; only files that the attempt's result names are read, so a task that is run again leaves no
record twice.

Cases: a null or empty html is an empty payload; payloads under 100 bytes are responses each;
pages that share the smallest id and the payload are all responses; rows without an id revisit the
smallest id there is, and are responses if there is none; an empty table gives an empty result;
other input columns are not looked at.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.session import cut, run_folder, runs_in_tasks

runs_in_tasks(__name__)

SHORTEST = 100
LEVEL = 6
#: Records the dictionary is trained on, bytes taken of each, and its size.
SAMPLE, SAMPLE_BYTES, DICTIONARY = 400, 16384, 65536
#: An archive is closed once it has passed this size.
ARCHIVE_BYTES = 1 << 30

DICTIONARY_FRAME = 0x184D2A5D
FIELDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def record(kind: str, number: str, url: str | None, page_id: int | None, digest: str, size: int, refers_to: int | None, block: bytes) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{number}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Bytes: {size}",
    ]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else "%20" for c in url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, html: str | None, digest: str, size: int, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    payload = (html or "").encode("utf-8", "surrogatepass") if kind == "response" else b""
    number = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{digest}")
    return record(kind, str(number), url, page_id, digest, size, refers_to, http + payload)


def skippable(data: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(data)) + data


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; too little to train on gives the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY:]


def as_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def learn_dictionary(pages: DataFrame) -> bytes:
    """From the records with the smallest hashes of id and url. Only their names are sorted, then their pages fetched."""
    named = pages.select(F.col("page_id").alias("_id"), F.col("url").alias("_url"))
    chosen = named.orderBy(F.xxhash64("_id", "_url"), "_id").limit(SAMPLE).distinct()
    rows = pages.join(F.broadcast(chosen), F.col("page_id").eqNullSafe(F.col("_id")) & F.col("url").eqNullSafe(F.col("_url")), "left_semi").limit(SAMPLE)
    rows = rows.select("page_id", "url", F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_BYTES).alias("html"))
    return dictionary([page_record(r["page_id"], r["url"], r["html"], "0" * 64, len(r["html"]), None) for r in rows.collect()])


def decided(pages: DataFrame) -> DataFrame:
    """Adds payload_bytes, payload_digest and refers_to. Only digests that occur twice are joined back."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.octet_length(html).cast("bigint").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest"))
    twice = rows.where(F.col("payload_bytes") >= SHORTEST).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    rows = rows.join(twice, "payload_digest", "left")
    return rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))).drop("_first")


def writer(folder: str, words: bytes):
    """Task function: archives of the rows it gets, one result row per archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        place, path = fs.FileSystem.from_uri(folder)
        place.create_dir(path, recursive=True)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=as_dictionary(words))
        task = TaskContext.get()
        stem, out, name, size, count, made = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}", None, "", 0, 0, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    name = f"{stem}-{len(made):05d}.warc.zst"
                    out, size, count = place.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                    size += out.write(skippable(words)) or 0
                number = lambda x: None if pd.isna(x) else int(x)
                frame = press.compress(page_record(number(row.page_id), row.url if isinstance(row.url, str) else None, row.html if isinstance(row.html, str) else None, row.payload_digest, int(row.payload_bytes), number(row.refers_to)))
                out.write(frame)
                size, count = size + len(frame), count + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    made.append((name, count, size))
                    out = None
        if out is not None:
            out.close()
            made.append((name, count, size))
        yield pd.DataFrame(made, columns=["name", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """The folder and a table (name, records, bytes) of its archives."""
    folder = folder or run_folder(pages.sparkSession, "warc")
    uri = folder if "://" in folder or folder.startswith("/") else folder.replace("file:/", "file:///", 1)
    words = learn_dictionary(pages)
    rows = decided(pages).select("page_id", "url", "html", "payload_digest", "payload_bytes", F.col("refers_to"))
    return uri, cut(rows.mapInPandas(writer(uri, words), "name string, records bigint, bytes bigint"))


def records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an uncompressed archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            field, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            head[field.strip()] = value.strip()
        block = stream.read(int(head["Content-Length"]))
        if len(block) != int(head["Content-Length"]):
            raise ValueError("a WARC record is cut off")
        yield head, block


def open_archive(raw) -> io.BufferedReader:
    """The records of an archive, uncompressed; its leading frame gives the dictionary."""
    magic, size = struct.unpack("<II", raw.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive has no dictionary frame")
    words = raw.read(size)
    return io.BufferedReader(zstandard.ZstdDecompressor(dict_data=as_dictionary(words)).stream_reader(raw, read_across_frames=True), 1 << 20)


def reader(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        place, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["name"]:
                rows = []
                with place.open_input_stream(f"{path}/{name}", compression=None) as raw:
                    for head, block in records(open_archive(raw)):
                        _, _, payload = block.partition(b"\r\n\r\n")
                        digest, size = head["WARC-Payload-Digest"].partition(":")[2], int(head["X-Payload-Bytes"])
                        if head["WARC-Type"] == "response":
                            size = len(payload)
                            if (own := hashlib.sha256(payload).hexdigest()) != digest:
                                raise ValueError(f"payload of {head['WARC-Record-ID']} has digest {own}")
                        to = head.get("X-Refers-To-Page-ID")
                        rows.append((head.get("X-Page-ID"), size, digest, head["WARC-Type"], to, payload))
                        if len(rows) >= 256:
                            yield frame(rows)
                            rows = []
                yield frame(rows)

    return run


def frame(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
    for c in ("page_id", "refers_to"):
        made[c] = pd.array([None if v is None else int(v) for v in made[c]], dtype="Int64")
    return made


def read_archives(spark: SparkSession, folder: str, archives: DataFrame) -> DataFrame:
    """Every record of the named archives, with its payload (empty for revisits)."""
    names = archives.select("name")
    spread = names.repartition(max(1, names.rdd.getNumPartitions()), "name")
    return spread.mapInPandas(reader(folder), FIELDS + ", payload binary")


def archived(pages: DataFrame) -> DataFrame:
    """Write every page, read the archives back: one row per record."""
    folder, archives = write_archives(pages)
    return read_archives(pages.sparkSession, folder, archives).drop("payload")
