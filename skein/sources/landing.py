"""A landing table of pages, whose rows and cursors become visible together: ``df.write.format("skein_landing")``
and ``stream.writeStream.format("skein_landing")``, with the option ``path``.

Tasks write Parquet files that nobody sees yet. A commit makes one note, ``<path>/notes/<number>.json``, that names
the files and how far each endpoint has come (last page, its etag). Readers go by the notes, so they see all of a batch
or nothing, and a scan that goes on behind the notes' cursors (``pages.Pages``) neither loses nor repeats a page, wherever
a task, the driver or the note's writing broke off. A batch whose pages have been noted before is the repetition of one:
its files are deleted. One writer at a time; files that no note names are left by broken runs (``swept``)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: a file (none if it had no rows), and by endpoint its first and last page and the last's etag."""

    file: str | None
    rows: int
    pages: dict[str, tuple[int, int, str | None]]


class Notes:
    """The notes under a path."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.files, self.root = fs.FileSystem.from_uri(self.path)

    def all(self) -> list[dict]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/notes", allow_not_found=True))
        out = []
        for info in sorted((x for x in found if x.base_name.endswith(".json")), key=lambda x: x.base_name):
            with self.files.open_input_stream(info.path) as f:
                out.append(json.loads(f.read()))
        return out

    def cursors(self) -> dict[str, tuple[int, str | None]]:
        """How far each endpoint has come: page and etag."""
        out: dict[str, tuple[int, str | None]] = {}
        for note in self.all():
            out |= {k: tuple(v) for k, v in note["cursors"].items()}
        return out

    def commit(self, messages: list[Written | None]) -> bool:
        """Make the files of a batch visible; False if the batch was there before. Pages of which only some
        are new are an error."""
        made = [m for m in messages if m is not None and m.file]
        first, last = {}, {}
        for m in made:
            for endpoint, (low, high, etag) in m.pages.items():
                first[endpoint] = min(low, first.get(endpoint, low))
                if endpoint not in last or high > last[endpoint][0]:
                    last[endpoint] = high, etag
        before = self.cursors()
        again = {k for k, v in first.items() if v <= before.get(k, (0,))[0]}
        if again and (again != set(first) or any(last[k][0] > before[k][0] for k in again)):
            self.abort(messages)
            raise RuntimeError(f"landing.overlap: {', '.join(sorted(again))}")
        if again:
            self.abort(messages)
            return False
        if made:
            number = len(self.all()) + 1
            self.files.create_dir(f"{self.root}/notes", recursive=True)
            own = f"{self.root}/notes/.{uuid4().hex}"
            with self.files.open_output_stream(own) as f:
                f.write(json.dumps({"files": [m.file for m in made], "rows": sum(m.rows for m in made), "cursors": last}).encode())
            self.files.move(own, f"{self.root}/notes/{number:08d}.json")
        return True

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and m.file:
                self.files.delete_file(f"{self.root}/{m.file}")

    def swept(self) -> int:
        """Delete the files that no note names; only while nobody writes."""
        named = {f for note in self.all() for f in note["files"]}
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/rows", allow_not_found=True))
        gone = [x.path for x in found if f"rows/{x.base_name}" not in named]
        for path in gone:
            self.files.delete_file(path)
        return len(gone)


def _put(path: str, batches: Iterator[pa.RecordBatch]) -> Written:
    """A task's rows as one file, under a name of its own."""
    notes, name, out, n, pages = Notes(path), f"rows/{uuid4().hex}.parquet", None, 0, {}
    try:
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                notes.files.create_dir(f"{notes.root}/rows", recursive=True)
                out = pq.ParquetWriter(f"{notes.root}/{name}", b.schema, filesystem=notes.files, compression="zstd")
            out.write_batch(b)
            n += b.num_rows
            for endpoint, page, etag in zip(*(b.column(k).to_pylist() for k in ("endpoint", "page", "etag")), strict=True):
                low, high, tag = pages.get(endpoint, (page, page, etag))
                pages[endpoint] = min(low, page), max(high, page), etag if page >= high else tag
    finally:
        if out is not None:
            out.close()
    return Written(name if n else None, n, pages)


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _put(self.path, iterator)

    def commit(self, messages: list[Written | None]) -> None:
        Notes(self.path).commit(messages)

    def abort(self, messages: list[Written | None]) -> None:
        Notes(self.path).abort(messages)


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _put(self.path, iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        Notes(self.path).commit(messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        Notes(self.path).abort(messages)


class Landing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skein_landing"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("a landing is appended to")
        return Writer(self.options["path"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:  # noqa: N802
        return StreamWriter(self.options["path"])


def landed_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows that have been committed to the landing."""
    notes = Notes(path)
    files = [f"{notes.path}/{f}" for note in notes.all() for f in note["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
