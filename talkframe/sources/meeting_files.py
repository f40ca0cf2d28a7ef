"""The meeting archive as files, one per meeting and kind: ``spark.read.format("meetings")`` and its writer.

``kind`` is an option: ``transcripts`` and ``analyses`` and ``meta`` are JSON files of fixed names in a
meeting's folder, ``markdown`` is one document a meeting under its cleaned name. A reader's tasks get files
packed by size; ``ids``, a JSON list, leaves out all other meetings. A writer's tasks write into a folder of their own; the driver moves the files when
all tasks are done, so a task or a job that fails leaves nothing behind.

A file that does not parse keeps only its meeting's id. Paths may lie in any store that pyarrow knows.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from talkframe.session import runs_in_tasks
from talkframe.sources.meetings import SEGMENT_TYPE

runs_in_tasks(__name__)

FORMAT = "meetings"
SCHEMAS = {
    "transcripts": f"meeting_id string, meeting_scope string, text string, segments array<{SEGMENT_TYPE}>",
    "analyses": "meeting_id string, markdown string, speakers_degraded boolean",
    "meta": "meeting_id string, name string, original_id string, edited_id string",
    "markdown": "meeting_id string, file_name string, content string",
}
# The names of the files, of their fields, and what a missing scope means.
FILE_NAMES = {"transcripts": "transcribe.json", "analyses": "analyze.json", "meta": "meta.json"}
SCOPES = ("group", "two-party")
META_FIELDS = {"name": "name", "originalId": "original_id", "editedId": "edited_id"}

PACK_BYTES = 64 << 20
#: Bytes that opening a file counts for when files are packed.
OPEN_BYTES = 1 << 20
READ_ROWS = 64


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store a path lies in, and its place there."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    store, place = fs.FileSystem.from_uri(path if "://" in path else posixpath.abspath(path))
    return store, place.rstrip("/")


def _plain(value, kind: type):
    return value if isinstance(value, kind) else None


def _number(value) -> float | None:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def _segment(s) -> dict:
    s = s if isinstance(s, dict) else {}
    times = {k: _number(s.get(k)) for k in ("start", "end")}
    flags = {k: _plain(s.get(k), bool) for k in ("duplicate", "overlap")}
    return times | flags | {k: _plain(s.get(k), str) for k in ("text", "speaker", "source")}


def parsed(kind: str, meeting_id: str, data: bytes) -> dict:
    """The row of one file; of a file that is no such document only the id is known."""
    try:
        doc = json.loads(data)
    except ValueError:
        doc = None
    known = isinstance(doc, dict)
    doc = doc if known else {}
    if kind == "transcripts":
        segments = [_segment(s) for s in doc["segments"]] if isinstance(doc.get("segments"), list) else None
        scope = doc.get("meetingScope")
        return {"meeting_id": meeting_id, "meeting_scope": scope if scope in SCOPES else SCOPES[0], "text": _plain(doc.get("text"), str) or "", "segments": segments}
    if kind == "analyses":
        analysis = doc.get("analysis") if isinstance(doc.get("analysis"), dict) else {}
        done = analysis.get("status") == "success"
        return {"meeting_id": meeting_id, "markdown": _plain(analysis.get("markdown"), str) if done else None, "speakers_degraded": bool(_plain(doc.get("speakersDegraded"), bool))}
    return {"meeting_id": meeting_id} | {column: _plain(doc.get(name), str) for name, column in META_FIELDS.items()}


def printed(kind: str, row: dict) -> bytes:
    """The file of one row; what is null is left out."""
    if kind == "transcripts":
        doc = {"segments": [{k: v for k, v in s.items() if v is not None} for s in row["segments"] or []], "text": row["text"] or "", "meetingScope": row["meeting_scope"] or SCOPES[0]}
    elif kind == "analyses":
        doc = {"analysis": {"status": "success", "markdown": row["markdown"]}, "speakersDegraded": bool(row["speakers_degraded"])}
    else:
        doc = {name: row[column] for name, column in META_FIELDS.items() if row[column] is not None}
    return json.dumps(doc, ensure_ascii=False).encode()


@dataclass
class Files(InputPartition):
    paths: list[str]


class MeetingReader(DataSourceReader):
    def __init__(self, root: str, kind: str, schema: pa.Schema, pack_bytes: int, wanted: set[str] | None) -> None:
        self.root, self.kind, self.schema, self.pack_bytes, self.wanted = root, kind, schema, pack_bytes, wanted

    def partitions(self) -> list[Files]:
        store, root = _store(self.root)
        name = FILE_NAMES.get(self.kind)
        found = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            folder, file = posixpath.split(info.path)
            hidden = any(p.startswith("_") for p in info.path[len(root) :].split("/"))
            fits = file == name if name else file.endswith(".md")
            if info.type == fs.FileType.File and fits and not hidden and (self.wanted is None or posixpath.basename(folder) in self.wanted):
                found.append((info.path, info.size))
        packs, held, size = [], [], 0
        for path, bytes_ in sorted(found):
            if held and size + bytes_ + OPEN_BYTES > self.pack_bytes:
                packs.append(Files(held))
                held, size = [], 0
            held.append(path)
            size += bytes_ + OPEN_BYTES
        return [*packs, Files(held)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.root)
        rows = []
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                data = f.read()
            folder, file = posixpath.split(path)
            meeting = posixpath.basename(folder)
            rows.append({"meeting_id": meeting, "file_name": file, "content": data.decode()} if self.kind == "markdown" else parsed(self.kind, meeting, data))
            if len(rows) == READ_ROWS:
                yield pa.RecordBatch.from_pylist(rows, self.schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a file lies, where it belongs


class MeetingWriter(DataSourceWriter):
    def __init__(self, root: str, kind: str, overwrite: bool) -> None:
        self.root, self.kind, self.overwrite = root, kind, overwrite
        self.job = uuid.uuid4().hex

    def _work(self, root: str) -> str:
        return f"{root}/_temporary-{self.job}"

    def write(self, rows: Iterator) -> Written:
        store, root = _store(self.root)
        task = f"{self._work(root)}/{uuid.uuid4().hex}"
        files = []
        for n, row in enumerate(rows):
            values = row.asDict(recursive=True)
            name = FILE_NAMES.get(self.kind) or values["file_name"]
            data = values["content"].encode() if self.kind == "markdown" else printed(self.kind, values)
            here = f"{task}/{n}"
            if n == 0:
                store.create_dir(task, recursive=True)
            with store.open_output_stream(here) as f:
                f.write(data)
            files.append((here, f"{root}/{values['meeting_id']}/{name}"))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.root)
        places = [f for m in messages if m is not None for f in m.files]
        if self.overwrite:
            # other kinds of files of the same meetings stay
            mine = FILE_NAMES.get(self.kind)
            for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
                file = posixpath.basename(info.path)
                if info.type == fs.FileType.File and "/_temporary-" not in info.path and (file == mine if mine else file.endswith(".md")):
                    store.delete_file(info.path)
        for folder in sorted({posixpath.dirname(place) for _, place in places}):
            store.create_dir(folder, recursive=True)
        for here, place in places:
            store.move(here, place)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.root)
        if store.get_file_info(self._work(root)).type == fs.FileType.Directory:
            store.delete_dir(self._work(root))


class MeetingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _kind(self) -> str:
        kind = self.options.get("kind", "transcripts")
        if kind not in SCHEMAS:
            raise ValueError(f"kind must be one of {', '.join(SCHEMAS)}")
        return kind

    def schema(self) -> str:
        return SCHEMAS[self._kind()]

    def reader(self, schema) -> MeetingReader:
        wanted = self.options.get("ids")
        return MeetingReader(self.options["path"], self._kind(), to_arrow_schema(schema), int(self.options.get("packBytes", PACK_BYTES)), None if wanted is None else set(json.loads(wanted)))

    def writer(self, schema, overwrite: bool) -> MeetingWriter:
        return MeetingWriter(self.options["path"], self._kind(), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MeetingSource)


def read_files(spark: SparkSession, root: str, kind: str, ids: list[str] | None = None) -> DataFrame:
    """All files of a kind, or those of some meetings; no other file is opened then."""
    register(spark)
    reader = spark.read.format(FORMAT).option("kind", kind)
    return (reader if ids is None else reader.option("ids", json.dumps(ids))).load(root)


def write_files(rows: DataFrame, root: str, kind: str, mode: str = "append") -> None:
    """One file per row. Columns beyond those of the kind are dropped, absent ones are null."""
    register(rows.sparkSession)
    columns = [(f.name, f.dataType) for f in rows.sparkSession.createDataFrame([], SCHEMAS[kind]).schema]
    ready = rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in columns])
    ready.write.format(FORMAT).option("kind", kind).mode(mode).save(root)


def transcript_rows(segments: DataFrame, lines: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """A row per meeting as its file holds it: segments in order, printed text, scope."""
    each = F.struct("start", "end", "text", "speaker", "duplicate", "overlap", "source")
    held = segments.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", each.alias("s")))).alias("_s"))
    text = lines.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("line_idx", "part", "line"))).alias("_l"))
    rows = held.join(text, "meeting_id", "left")
    rows = rows.join(scopes, "meeting_id", "left") if scopes is not None else rows.withColumn("meeting_scope", F.lit(None).cast("string"))
    printed_lines = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    return rows.select("meeting_id", "meeting_scope", F.coalesce(printed_lines, F.lit("")).alias("text"), F.transform("_s", lambda x: x["s"]).alias("segments"))


def document_rows(documents: DataFrame) -> DataFrame:
    """Exported documents, line by line as ``meetings.markdown_lines`` gives them, as one row and file a meeting."""
    line = F.struct("section", "line_idx", "part", "line")
    whole = documents.groupBy("meeting_id").agg(F.first("file_name").alias("file_name"), F.array_sort(F.collect_list(line)).alias("_l"))
    content = F.concat(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit("\n"))
    return whole.select("meeting_id", "file_name", content.alias("content"))
